"""Mergeable sketches: latency quantiles per window and label (KLL), distinct counts per load (HyperLogLog).

A sketch is a bounded value of a row, so windows and loads merge by an aggregate
over their sketches, without the events.  ``latency_sketches`` runs on batches and
on streams (its state is one sketch per window and label).  Nulls are not counted;
a window without a latency has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KLL_K = 1000
HLL_LG_K = 14


def rank_error(k: int = KLL_K) -> float:
    """The share of all values by which a quantile's rank is off, at 99% confidence (about 2.3 / k^0.9)."""
    return 2.296 / k ** 0.9021


def distinct_error(lg_k: int = HLL_LG_K) -> float:
    """The relative standard error of a distinct count, merging included (about 1.04 / sqrt(registers))."""
    return 1.04 / 2 ** (lg_k / 2)


def latency_sketches(ev: DataFrame, size: str = "5 minutes", labels: Sequence[str] = ("label",), k: int = KLL_K) -> DataFrame:
    """(window_start, labels..., n, sketch) of each tumbling window."""
    v = F.col("latency").cast("double")
    rolled = ev.where(v.isNotNull()).groupBy(F.window("ts", size).alias("w"), *labels).agg(
        F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))
    return rolled.select(F.col("w.start").alias("window_start"), *labels, "n", "sketch")


def sketch_quantiles(sketches: DataFrame, by: Sequence, levels: Sequence[float], k: int = KLL_K) -> DataFrame:
    """(by..., n, quantiles) of the sketches merged by ``by``: labels, wider windows, or nothing for all of them."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    kept = [c for c in merged.columns if c != "_s"]
    found = [F.kll_sketch_get_quantile_double("_s", F.lit(float(q))) for q in levels]
    return merged.where(F.col("n") > 0).select(*kept, F.array(*found).alias("quantiles"))


def write_distinct_sketches(rows: DataFrame, columns: Sequence[str], path: str, load: str, lg_k: int = HLL_LG_K) -> str:
    """Store one sketch per column for ``load``; the same load again replaces them."""
    made = rows.agg(*[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(c) for c in columns])
    flat = made.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("sketch")) for c in columns])))
    flat.write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={load}")
    return path


def read_distinct_sketches(spark: SparkSession, path: str) -> DataFrame:
    """(column, distinct): the estimate over all loads."""
    stored = spark.read.schema("`column` string, sketch binary").option("recursiveFileLookup", "true").parquet(path)
    return stored.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
