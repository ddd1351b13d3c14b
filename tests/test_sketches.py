"""Merged sketches against exact values; the metric table against its parts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import sketches as K
from shelfspark.operators import telemetry as T
from shelfspark.sinks.metrics import counter_samples, gauge_samples, histogram_samples, read_metrics, write_metrics

SCHEMA = "ts timestamp, event_id long, label string, latency double"


def requests(n, seed=3):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    return [(start + timedelta(seconds=i), i, rng.choice(["a", "a", "a", "b"]), rng.lognormvariate(0, 1.5)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return [*requests(40_000), (datetime(2024, 1, 1), -1, "c", None)]


@pytest.mark.parametrize("by", [["label"], []])
def test_merged_quantiles_are_within_the_rank_error(spark, rows, by):
    ev = spark.createDataFrame(rows, SCHEMA)
    levels = [0.01, 0.25, 0.5, 0.9, 0.99]
    got = K.sketch_quantiles(K.latency_sketches(ev), by, levels).collect()
    assert len(got) == (2 if by else 1)
    for r in got:
        values = sorted(x[3] for x in rows if x[3] is not None and (not by or x[2] == r["label"]))
        assert r["n"] == len(values)
        for q, v in zip(levels, r["quantiles"]):
            below, upto = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
            assert below - K.rank_error() <= q <= upto + K.rank_error()


def test_no_rows(spark):
    ev = spark.createDataFrame([], SCHEMA)
    assert K.sketch_quantiles(K.latency_sketches(ev), ["label"], [0.5]).count() == 0
    assert K.sketch_quantiles(K.latency_sketches(ev), [], [0.5]).count() == 0


def test_distinct_counts_merge_over_loads(spark, tmp_path):
    path = str(tmp_path / "d")
    ids = lambda a, b: spark.range(a, b).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"), F.lit(None).cast("string").alias("z"))
    K.write_distinct_sketches(ids(0, 90_000), ["x", "y", "z"], path, "1")
    K.write_distinct_sketches(ids(50_000, 120_000), ["x", "y", "z"], path, "2")
    got = {r["column"]: r["distinct"] for r in K.read_distinct_sketches(spark, path).collect()}
    assert abs(got["x"] - 120_000) <= 5 * K.distinct_error() * 120_000 and (got["y"], got["z"]) == (7, 0)
    K.write_distinct_sketches(ids(0, 100), ["x", "y", "z"], path, "1")  # a load is replaced
    K.write_distinct_sketches(ids(50, 200), ["x", "y", "z"], path, "2")
    assert {r["column"]: r["distinct"] for r in K.read_distinct_sketches(spark, path).collect()}["x"] == 200


def test_metrics_merge_and_a_batch_sent_twice_counts_once(spark, rows, tmp_path):
    path = str(tmp_path / "m")
    ev = spark.createDataFrame(rows[-4000:], SCHEMA)
    for batch, part in (("0", ev.where("event_id % 2 = 0")), ("1", ev.where("event_id % 2 <> 0")), ("0", ev.where("event_id % 2 = 0"))):
        write_metrics([counter_samples(T.metric_counter_totals(part), "n", ["label"]),
                       histogram_samples(T.metric_histograms(part, buckets=(0.5, 1.0)), "s", ["label"]),
                       gauge_samples(T.metric_gauge_latest(part), "g", ["label"])], path, batch)
    got = {(r["name"], r["labels"], r["le"]): r["value"] for r in read_metrics(spark, path).collect()}
    for label in "abc":
        key = f'{{"label":"{label}"}}'
        mine = [x for x in rows[-4000:] if x[2] == label]
        values = [x[3] for x in mine if x[3] is not None]
        assert got["n", key, None] == len(mine) and got["s_count", key, None] == len(values) == got["s_bucket", key, "+Inf"]
        assert got["s_bucket", key, "0.5"] == sum(v <= 0.5 for v in values)
        assert got["s_sum", key, None] == pytest.approx(sum(values)) if values else got["s_sum", key, None] is None
        assert got["g", key, None] == max(mine)[3]
