"""Exact quantiles (linear interpolation between order statistics) without one task that holds a column.

1. the columns are written once, as they are;
2. split points per column (a bounded sketch, collected: one number per column
   and range) deal the values into ranges; they only balance the work, and as
   fixed numbers they are the same wherever they are used;
3. the ranges' totals (collected: one number per column and range) say which
   range holds a rank, and how many values stand before it;
4. only those ranges' values are counted and shuffled, and sorted, each range in
   its own window, and read at the ranks.

``quantiles_of_counts`` takes the same steps from values that are counted already.

The number of ranges follows ``spark.sql.shuffle.partitions``, so a range holds
about one shuffle partition's share of the values, whatever the table's size.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import materialized

# Functions of this module run in Python workers, which may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _splits(df: DataFrame, columns: Sequence[str], ranges: int) -> list[list[float]]:
    """Up to ``ranges`` - 1 rising split points of each column (none for a column without values), from one pass."""
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    near = max(1000, 10 * ranges)  # ranks are off by a tenth of a range at most
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, near).alias(f"_{i}") for i, c in enumerate(columns)])
    return [sorted(set(x or [])) for x in found.first()]


def _range_of(value: Column, splits: Sequence[float]) -> Column:
    """How many of the rising ``splits`` lie below ``value``, by halving."""
    at = F.array(*[F.lit(float(x)) for x in splits])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(splits).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(at, n + step - 1) < value, step).otherwise(0))


def _range_totals(values: DataFrame, splits: list[list[float]]) -> DataFrame:
    """(i, part, m): how many values of column number ``i`` lie in each of its ranges, in one pass over all columns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(s) + 1, np.int64) for s in splits]
        for batch in batches:
            for own, s, x in zip(totals, splits, batch.columns):
                own += np.bincount(np.searchsorted(s, x.drop_null().to_numpy(zero_copy_only=False), side="left"), minlength=len(own))
        found = [(i, part, m) for i, own in enumerate(totals) for part, m in enumerate(own.tolist()) if m]
        yield pa.RecordBatch.from_pylist([dict(zip("ipm", r)) for r in found], pa.schema([("i", pa.int32()), ("p", pa.int32()), ("m", pa.int64())]))

    counted = values.mapInArrow(count, "i int, p int, m long")
    return counted.groupBy("i", F.col("p").alias("part")).agg(F.sum("m").alias("m")).orderBy("i", "part")


def value_ranges(counts: DataFrame, key: str, value: str) -> DataFrame:
    """``counts`` with ``part``: the range of ``value`` among its key's, by split points that are fixed numbers."""
    spark = counts.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = counts.groupBy(key).agg(F.percentile_approx(value, steps, max(1000, 10 * ranges)).alias("splits")).collect()
    part = F.lit(None).cast("int")
    for r in found:  # one row per key; a null key is none
        if r[0] is not None and r[1] is not None:
            part = F.when(F.col(key) == r[0], _range_of(F.col(value), sorted(set(r[1])))).otherwise(part)
    return counts.where(F.col(key).isNotNull()).withColumn("part", part)


def exact_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float], written: bool = False) -> DataFrame:
    """(column, quantiles): the value at rank q·(n−1) for every level, interpolated; nulls are ignored.

    A column without values has no row.  ``written`` says that ``df`` is a stored
    table, which is read several times as it is.
    """
    columns = list(dict.fromkeys(columns))
    spark = df.sparkSession
    if not written:
        df = materialized(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "quantile_columns")
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = _splits(df, columns, ranges) if columns else []
    held = [(c, s) for c, s in zip(columns, splits) if s]
    empty = spark.createDataFrame([], "`column` string, part int, value double, n long")
    value = lambda c: F.col(c).cast("double")
    totals, needed = {}, empty
    if held:
        for r in _range_totals(df.select(*[value(c).alias(f"_{i}") for i, (c, _) in enumerate(held)]), [s for _, s in held]).collect():
            totals.setdefault(held[r["i"]][0], []).append((r["part"], r["m"]))
    wanted, weights = _ranks(totals, levels)
    parts = {c: sorted({p for x, p, *_ in wanted if x == c}) for c, _ in held}
    for c, s in held:
        part = F.lit(None).cast("int")
        for p in parts[c]:  # s[p - 1] < value <= s[p]
            inside = (F.lit(True) if p == 0 else value(c) > s[p - 1]) & (F.lit(True) if p == len(s) else value(c) <= s[p])
            part = F.when(inside, F.lit(p)).otherwise(part)
        of_c = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), part.alias("part"), value(c).alias("value"))
        needed = needed.union(of_c.where("part IS NOT NULL").groupBy("column", "part", "value").agg(F.count(F.lit(1)).alias("n")))
    return _read_at(needed, wanted, weights)


def quantiles_of_counts(counts: DataFrame, levels: Sequence[float]) -> DataFrame:
    """The same from a written table (column, value, n) that holds each value of a column once."""
    dealt = value_ranges(counts, "column", "value")
    totals: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in dealt.groupBy("column", "part").agg(F.sum("n").alias("m")).orderBy("column", "part").collect():
        totals[r["column"]].append((r["part"], r["m"]))
    wanted, weights = _ranks(totals, levels)
    ranks = counts.sparkSession.createDataFrame([w[:2] for w in wanted], "`column` string, part int").distinct()
    return _read_at(dealt.join(F.broadcast(ranks), ["column", "part"], "left_semi"), wanted, weights)


def _ranks(totals: dict[str, list[tuple[int, int]]], levels: Sequence[float]) -> tuple[list[tuple], list[tuple]]:
    """(column, part, rank in the part, level, upper) of the order statistics asked for, and (column, level, weight of the upper)."""
    if any(not 0.0 <= q <= 1.0 for q in levels):
        raise ValueError("levels must lie in [0, 1]")
    wanted, weights = [], []
    for c, parts in totals.items():
        n = sum(m for _, m in parts)
        for i, q in enumerate(levels):
            rank = q * (n - 1)
            weights.append((c, i, rank - math.floor(rank)))
            for upper, at in ((0, math.floor(rank)), (1, math.ceil(rank))):
                for part, m in parts:
                    if at < m:
                        wanted.append((c, part, at, i, upper))
                        break
                    at -= m
    return wanted, weights


def _read_at(needed: DataFrame, wanted: list[tuple], weights: list[tuple]) -> DataFrame:
    """(column, quantiles) from the counted values of the parts that hold a rank."""
    spark = needed.sparkSession
    ranks = spark.createDataFrame(wanted, "`column` string, part int, at long, level int, upper int")
    weights = spark.createDataFrame(weights, "`column` string, level int, w double")
    running = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = needed.withColumn("upto", F.sum("n").over(running))
    read = placed.join(F.broadcast(ranks), ["column", "part"]).where(  # columns x levels rows
        (F.col("upto") - F.col("n") <= F.col("at")) & (F.col("at") < F.col("upto")))
    both = read.groupBy("column", "level").agg(F.max(F.when(F.col("upper") == 0, F.col("value"))).alias("lo"),
                                               F.max(F.when(F.col("upper") == 1, F.col("value"))).alias("hi"))
    # as order statistics interpolate: (1 - w) * lower + w * upper, exact where both are one value
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.lit(1.0) - F.col("w")) * F.col("lo") + F.col("w") * F.col("hi"))
    each = both.join(F.broadcast(weights), ["column", "level"]).select("column", F.struct("level", one.alias("value")).alias("x"))
    return each.groupBy("column").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value"]).alias("quantiles"))


def quantile_scalar(df: DataFrame, column: str, level: float):
    """One quantile of one column as a scalar subquery column (null without values)."""
    return exact_quantiles(df, [column], [level]).select(F.max(F.get("quantiles", F.lit(0)))).scalar()
