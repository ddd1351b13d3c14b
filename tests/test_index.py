"""The merge-on-read index against a dictionary of last writes."""

import random

from pyspark.sql import functions as F

from shelfspark.sinks.index import _Version, compact_index, delete_points, index_info, read_index, upsert_index, vacuum_index

SCHEMA = "id string, main_category string, score double, n long"


def state(df):
    return {r["id"]: (r["main_category"], r["score"]) for r in df.collect()}


def data_rows(spark, root):
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data").count()


def test_writes_deletes_and_compaction_equal_a_dictionary(spark, tmp_path):
    root, rng, want = str(tmp_path / "i"), random.Random(5), {}
    assert read_index(spark, root) is None and index_info(spark, root).first()["points"] == 0
    assert delete_points(spark, root, spark.createDataFrame([("1",)], "id string")) is None
    for step in range(6):
        rows = [(str(rng.randrange(300)), rng.choice("ab"), rng.random(), i) for i in range(400 if step == 0 else 15)]
        upsert_index(spark, root, spark.createDataFrame([*rows, (None, "a", 0.0, 1)], SCHEMA), "n", buckets=4, most=3)
        want |= {r[0]: r[1:3] for r in rows}
        if step % 2:
            gone = [str(rng.randrange(300)) for _ in range(5)]
            delete_points(spark, root, spark.createDataFrame([(g,) for g in gone + gone[:1]], "id string"), most=3)
            want = {k: x for k, x in want.items() if k not in gone}
        assert state(read_index(spark, root)) == want
    parts = _Version(spark, root).parts
    assert max(sum(p[1] == b for p in parts) for b in range(4)) <= 3
    old = read_index(spark, root)  # a reader keeps the version that it opened
    upsert_index(spark, root, spark.createDataFrame([("new", "a", 1.0, 0)], SCHEMA), "n", most=3)
    assert state(old) == want
    assert compact_index(spark, root, most=0) and state(read_index(spark, root)) == want | {"new": ("a", 1.0)}
    assert vacuum_index(spark, root, keep=1) > 0
    assert state(read_index(spark, root)) == want | {"new": ("a", 1.0)}
    assert data_rows(spark, root) == len(want) + 1


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path):
    root = str(tmp_path / "i")
    many = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("main_category"),
                                    F.lit(0.0).alias("score"), F.lit(0).alias("n"))
    upsert_index(spark, root, many, "n")
    upsert_index(spark, root, many.where("id in ('7', '8')").withColumn("score", F.lit(2.0)), "n")
    assert data_rows(spark, root) == 5002
    assert read_index(spark, root).agg(F.sum("score"), F.count("id")).first()[:] == (4.0, 5000)


def test_new_columns_no_rows_and_a_new_start(spark, tmp_path):
    root = str(tmp_path / "i")
    upsert_index(spark, root, spark.createDataFrame([], SCHEMA), "n")
    assert read_index(spark, root).count() == 0
    upsert_index(spark, root, spark.createDataFrame([("1", "a", 1.0, 0)], SCHEMA), "n")
    upsert_index(spark, root, spark.createDataFrame([("2", "b", 0, "x")], "id string, main_category string, n int, extra string"), "n")
    rows = {r["id"]: (r["score"], r["extra"]) for r in read_index(spark, root).collect()}
    assert rows == {"1": (1.0, None), "2": (None, "x")}
    upsert_index(spark, root, spark.createDataFrame([("9", "c", 1.0, 0)], SCHEMA), "n", recreate=True)
    assert state(read_index(spark, root)) == {"9": ("c", 1.0)}


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "i")
    upsert_index(spark, root, spark.createDataFrame([("1", "a", 1.0, 0)], SCHEMA), "n")
    spark.range(1).write.parquet(f"{root}/versions/v0000000009/parts")
    assert state(read_index(spark, root)) == {"1": ("a", 1.0)}
    upsert_index(spark, root, spark.createDataFrame([("2", "a", 3.0, 0)], SCHEMA), "n")  # and the writer goes on
    assert state(read_index(spark, root)) == {"1": ("a", 1.0), "2": ("a", 3.0)}
