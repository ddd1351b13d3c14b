"""The summary kept file by file equals the full run, whatever happened to the files."""

import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfspark.operators.summary import full_summary
from shelfspark.operators.summary_view import COLUMNS, refresh_summary, vacuum_summary
from shelfspark.plans.frames import enriched


def rows_of(df):
    return sorted((tuple(r) for r in df.select("section", "key", "value").collect()), key=repr)


def same(a, b):
    assert [r[:2] for r in a] == [r[:2] for r in b]
    for x, y in zip(a, b):
        assert x[2] == pytest.approx(y[2], abs=1e-9, nan_ok=True) if x[2] is not None else y[2] is None, (x, y)


@pytest.fixture(scope="module")
def catalog(spark, sf_small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows"))
    enriched(spark, sf_small).select(*COLUMNS, "order_key").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def put(df, folder, name, mode="errorifexists"):
    df.repartition(2, "order_key").drop("order_key").write.mode(mode).parquet(f"{folder}/{name}")


def test_appended_replaced_and_removed_files(spark, catalog, tmp_path):
    src, view = str(tmp_path / "cat alog"), str(tmp_path / "view")
    read = lambda: spark.read.option("recursiveFileLookup", "true").parquet(src)
    for i in range(3):
        put(catalog.where(F.col("order_key") % 4 == i), src, f"load={i}")
    one = refresh_summary(spark, src, view)
    assert (one.read, one.kept, one.dropped) == (6, 0, 0)
    same(rows_of(one.summary), rows_of(full_summary(read())))

    again = refresh_summary(spark, src, view)
    assert (again.version, again.read, again.kept) == (one.version, 0, 6)

    put(catalog.where(F.col("order_key") % 4 == 3), src, "load=3")  # appended
    two = refresh_summary(spark, src, view)
    assert (two.read, two.kept, two.dropped) == (2, 6, 0)
    same(rows_of(two.summary), rows_of(full_summary(read())))

    shutil.rmtree(f"{src}/load=0")  # removed
    put(catalog.where("order_key % 4 = 1 and rating > 3"), src, "load=1", "overwrite")  # replaced
    three = refresh_summary(spark, src, view, most_loads=1)  # and states rewritten into one load
    assert (three.read, three.kept, three.dropped) == (2, 4, 4)
    same(rows_of(three.summary), rows_of(full_summary(read())))
    assert refresh_summary(spark, src, view).version == three.version

    forced = refresh_summary(spark, src, view, force_refresh=True)
    assert forced.read == 6 and forced.version > three.version
    same(rows_of(forced.summary), rows_of(three.summary))
    assert vacuum_summary(spark, view, keep=1) > 0
    assert refresh_summary(spark, src, view).version == forced.version


def test_a_file_replaced_in_place_with_the_same_rows_but_one(spark, catalog, tmp_path):
    src, view = tmp_path / "src", str(tmp_path / "view")
    put(catalog, str(src), "a")
    refresh_summary(spark, str(src), view)
    file = max((src / "a").glob("*.parquet"), key=lambda f: f.stat().st_size)
    rows = pq.read_table(file)
    at = rows.column_names.index("actual_price")
    prices = [9_999_999.0, *rows["actual_price"].to_pylist()[1:]]
    file.with_name(f".{file.name}.crc").unlink()  # the local file system's checksum of the old bytes
    pq.write_table(rows.set_column(at, "actual_price", pa.array(prices, pa.float64())), file)
    after = refresh_summary(spark, str(src), view)
    assert (after.read, after.dropped) == (1, 1)
    same(rows_of(after.summary), rows_of(full_summary(spark.read.parquet(f"{src}/a"))))


def test_nulls_repeats_and_no_rows(spark, catalog, tmp_path):
    src, view = str(tmp_path / "src"), str(tmp_path / "view")
    part = catalog.limit(40).withColumn("sub_category", F.lit(None).cast("string"))
    put(part.withColumn("rating", F.lit(None).cast("double")), src, "a")
    put(part.withColumn("main_category", F.lit(None).cast("string")), src, "b")
    put(part, src, "c")
    put(part, src, "d")
    got = refresh_summary(spark, src, view)
    same(rows_of(got.summary), rows_of(full_summary(spark.read.parquet(*[f"{src}/{x}" for x in "abcd"]))))
    for x in "abcd":
        shutil.rmtree(f"{src}/{x}")
    none = refresh_summary(spark, src, view)
    assert none.dropped > 0
    same(rows_of(none.summary), rows_of(full_summary(catalog.limit(0))))


def test_a_failed_refresh_leaves_the_last_version(spark, catalog, tmp_path):
    src, view = str(tmp_path / "src"), str(tmp_path / "view")
    put(catalog.limit(30), src, "a")
    one = refresh_summary(spark, src, view)
    put(catalog.limit(20), src, "b")

    def broken(df):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        refresh_summary(spark, src, view, prepare=broken)
    two = refresh_summary(spark, src, view)
    assert two.version > one.version and (two.read, two.dropped) == (2, 0)
    same(rows_of(two.summary), rows_of(full_summary(spark.read.parquet(f"{src}/a", f"{src}/b"))))


def test_states_of_a_load_go_by_numbers(spark, tmp_path):
    """A file's long key is joined after its rows are added up."""
    from shelfspark.operators.summary_view import _listing

    spark.range(3).repartition(3).write.parquet(str(tmp_path / "files"))
    rows = _listing(spark, str(tmp_path / "files")).collect()
    assert len({r["code"] for r in rows}) == len({r["key"] for r in rows}) == len(rows)
