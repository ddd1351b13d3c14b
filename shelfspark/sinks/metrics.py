"""Counters, histograms and gauges as one sample table that merges when read.

A sample is (kind, name, labels, le, value, ts); ``labels`` is JSON with its keys
in the order given.  A histogram gives ``<name>_bucket`` rows per cumulative bound,
``<name>_sum`` and ``<name>_count``.  Each batch of samples owns one folder and
replaces it, so a batch that is sent twice counts once.  Reading adds counters and
histograms up over batches and takes the latest value of a gauge.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SCHEMA = "kind string, name string, labels string, le string, value double, ts timestamp"


def _sample(kind: str, name: Column, labels: Sequence[str], value: Column, le: Column | None = None, ts: Column | None = None) -> list[Column]:
    none = F.lit(None)
    return [F.lit(kind).alias("kind"), name.alias("name"), F.to_json(F.struct(*labels)).alias("labels") if labels else F.lit("{}").alias("labels"),
            (none if le is None else le).cast("string").alias("le"), value.cast("double").alias("value"),
            (none if ts is None else ts).cast("timestamp").alias("ts")]


def counter_samples(totals: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """``metric_counter_totals`` rows as samples."""
    return totals.select(*_sample("counter", F.lit(name), labels, F.col("count")))


def histogram_samples(histograms: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """``metric_histograms`` rows (one per bound) as samples; sum and count go with the last bound."""
    last = F.col("le") == "+Inf"
    rows = F.array(
        F.struct(F.lit(f"{name}_bucket").alias("name"), F.col("le").alias("bound"), F.col("bucket_count").cast("double").alias("v")),
        F.when(last, F.struct(F.lit(f"{name}_sum").alias("name"), F.lit(None).cast("string").alias("bound"), F.col("sum").cast("double").alias("v"))),
        F.when(last, F.struct(F.lit(f"{name}_count").alias("name"), F.lit(None).cast("string").alias("bound"), F.col("count").cast("double").alias("v"))))
    flat = histograms.select(*labels, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("_r"))
    return flat.select(*_sample("histogram", F.col("_r.name"), labels, F.col("_r.v"), F.col("_r.bound")))


def gauge_samples(latest: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """``metric_gauge_latest`` rows as samples with their time."""
    return latest.select(*_sample("gauge", F.lit(name), labels, F.col("value"), ts=F.col("ts")))


def write_metrics(samples: Sequence[DataFrame], path: str, batch: str) -> str:
    """Write one batch's samples; the same batch again replaces them."""
    reduce(DataFrame.unionByName, samples).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return path


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, labels, le, value, ts) over all batches."""
    rows = spark.read.schema(SAMPLE_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    value = F.when(F.col("kind") == "gauge", F.max_by("value", "ts")).otherwise(F.sum("value"))
    return rows.groupBy("kind", "name", "labels", "le").agg(value.alias("value"), F.max("ts").alias("ts"))
