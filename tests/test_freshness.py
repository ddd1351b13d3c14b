"""Inputs are read as they are now; results belong to rows and code; no machine-local folder on a cluster."""

import shutil
import subprocess
import sys
import zipfile
from pathlib import Path
from types import SimpleNamespace

import pytest

from shelfspark import session
from shelfspark.sources.tables import read_table
from shelfspark.streaming import telemetry_stream as S

ROOT = Path(__file__).resolve().parents[1]


def test_appended_files_are_seen(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    spark.range(5).write.parquet(path)
    assert read_table(spark, str(tmp_path), "events").count() == 5
    key = session.content_key(read_table(spark, str(tmp_path), "events"))
    spark.range(7).write.mode("append").parquet(path)
    assert read_table(spark, str(tmp_path), "events").count() == 12
    assert session.content_key(read_table(spark, str(tmp_path), "events")) != key


def test_content_key_ignores_order_and_files(spark):
    df = spark.range(100)
    assert session.content_key(df) == session.content_key(df.orderBy("id", ascending=False).repartition(7))


def test_fingerprint_of_a_zip_follows_the_code(tmp_path):
    def fingerprint(extra: str) -> str:
        folder = tmp_path / f"src{len(extra)}"
        shutil.copytree(ROOT / "shelfspark", folder / "shelfspark", ignore=shutil.ignore_patterns("__pycache__"))
        (folder / "shelfspark" / "constants.py").open("a").write(extra)
        archive = tmp_path / f"lib{len(extra)}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(folder.rglob("*.py")):
                z.write(f, f.relative_to(folder))
        code = "from shelfspark.session import package_fingerprint as f; print(f())"
        return subprocess.run([sys.executable, "-c", code], env={"PYTHONPATH": str(archive), "PATH": "/usr/bin:/bin"},
                              cwd=tmp_path, capture_output=True, text=True, check=True).stdout.strip()

    same = fingerprint("")
    assert same == session.package_fingerprint() and fingerprint("\nX = 1\n") != same


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_unset_checkpoint_folder_is_an_error_on_a_cluster(master):
    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


def test_stream_over_a_folder_goes_on_where_it_stopped(spark, sf_small, tmp_path):
    events = read_table(spark, sf_small, "events")
    folder = str(tmp_path / "events.parquet")
    events.limit(300).repartition(3).write.parquet(folder)
    out = str(tmp_path / "out")
    first = S.run_to_table(S.table_stream(spark, str(tmp_path), "events").select("event_id"), "ids", "append", out)
    assert first.count() == 300
    again = S.run_to_table(S.table_stream(spark, str(tmp_path), "events").select("event_id"), "ids", "append", out)
    assert again.count() == 300  # nothing new, nothing twice
    events.orderBy("event_id", ascending=False).limit(50).repartition(2).write.mode("append").parquet(folder)
    more = S.run_to_table(S.table_stream(spark, str(tmp_path), "events").select("event_id"), "ids", "append", out)
    assert more.count() == 350


def test_score_stream_equals_batch(spark, sf_small):
    from shelfspark.plans import QUERIES
    batch = QUERIES["predict_batch"](spark, sf_small)
    stream = QUERIES["score_stream"](spark, sf_small)
    rows = lambda df: sorted(map(tuple, df.select("row_id", "predicted_discount", "confidence").collect()))
    assert rows(stream) == rows(batch)
