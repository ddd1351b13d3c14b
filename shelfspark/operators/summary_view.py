"""The catalog summary kept up to date file by file.

``refresh_summary`` gives the rows of ``operators.summary.full_summary`` over a
folder of enriched catalog files, but reads only the files that it has not seen:

* each file leaves three mergeable states: ``cells`` (counts, sums, extremes and
  missing values per main category, sub-category and price tier), ``moments``
  (co-moments of every pair of correlated columns) and ``values`` (counts of each
  value of the summary's columns, for exact medians);
* a version is a list of files with the load that holds their states, and the
  summary merged from them.  Replaced and removed files are only left out of the
  list, so nothing is subtracted and every merge is of whole states;
* a file goes by its path, size and modification time; the listing is a table
  (file metadata without content), compared with the last version's by a join;
* a version is visible once it is complete; a refresh that fails leaves the last
  one in place, and its states are never named.  One refresh at a time writes.

When nothing changed, the stored summary is returned.  ``force_refresh`` reads
every file anew.  States of many loads are rewritten into one.

States grow with the files' distinct values, not with their rows or columns;
merging is aggregation with map-side combining.  The driver holds the names of
the new files and of the loads.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.constants import CORRELATION_COLUMNS, SUMMARY_NUMERIC_COLUMNS, TARGET
from shelfspark.functions.numeric import round_half_up
from shelfspark.operators.profile import _MOMENTS, STAT_NAMES, _co_moments
from shelfspark.operators.quantiles import quantiles_of_counts
from shelfspark.operators.summary import CATEGORY_KEYS, TEXT_COLUMNS
from shelfspark.session import complete_versions, delete_path, mark_complete, materialized, path_exists

# Functions of this module run inside Python workers; shipped by value, executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUPS = ("main_category", "sub_category", "price_tier")
MEASURES = tuple(dict.fromkeys([*SUMMARY_NUMERIC_COLUMNS, *TEXT_COLUMNS]))
COLUMNS = tuple(dict.fromkeys([*GROUPS, *MEASURES, *CORRELATION_COLUMNS]))
_SCHEMAS = {
    "cells": "key string, " + ", ".join(f"{g} string" for g in GROUPS) + ", n long, " + ", ".join(
        f"{c}_n long, {c}_missing long, {c}_min double, {c}_max double, {c}_sum double" for c in MEASURES),
    "moments": f"key string, {_MOMENTS}",
    "values": "key string, `column` string, value double, n long",
}
_FILES = "file string, key string, load string"


class Refresh(NamedTuple):
    """What a refresh did: the version it left, the files read, kept and dropped, and the summary's rows."""

    version: str
    read: int
    kept: int
    dropped: int
    summary: DataFrame


def refresh_summary(spark: SparkSession, source: str, root: str, force_refresh: bool = False,
                    prepare: Callable[[DataFrame], DataFrame] | None = None, most_loads: int = 16) -> Refresh:
    """The summary of the Parquet files below ``source``, states and versions below ``root``.

    Files may lie in sub-folders; values in folder names are not read as columns.
    ``prepare`` maps a file's rows to enriched ones and must keep columns it does
    not know.  An empty folder gives the summary of no rows.  Null categories and
    tiers count as values of their own, as in the full run.
    """
    source, root = source.rstrip("/"), root.rstrip("/")
    found = complete_versions(spark, f"{root}/versions")
    last = f"{root}/versions/{found[-1]}" if found else None
    before = spark.read.schema(_FILES).parquet(f"{last}/files") if last else spark.createDataFrame([], _FILES)
    listing = materialized(_listing(spark, source), "summary_files")
    known = before.limit(0) if force_refresh else before
    unread = listing.join(known, ["file", "key"], "left_anti").select("file", "code").collect()
    fresh = [r["file"] for r in unread]
    if len({r["code"] for r in unread}) < len(fresh):
        raise ValueError("two files have one code; rename one")
    kept = listing.join(known, ["file", "key"]).select("file", "key", "load")
    n_kept, n_before = kept.count(), before.count()
    dropped = n_before - before.join(listing, ["file", "key"], "left_semi").count()
    if last and not fresh and not dropped:
        return Refresh(found[-1], 0, n_kept, 0, spark.read.parquet(f"{last}/summary"))

    load = uuid.uuid4().hex[:12]
    if fresh:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(source)
        if n_kept:
            rows = rows.where(F.col("_metadata.file_path").isin(fresh))  # prunes whole files
        rows = rows.select("*", _code().alias("_key"))
        read = listing.join(known, ["file", "key"], "left_anti")
        _write_states(prepare(rows) if prepare else rows, f"{root}/states/{load}", read.select(F.col("code").alias("_key"), "key"))
    files = kept.unionByName(listing.join(known, ["file", "key"], "left_anti").select("file", "key", F.lit(load).alias("load")))
    loads = [r["load"] for r in files.select("load").distinct().collect()]
    states = {name: _live(spark, root, name, loads, files) for name in _SCHEMAS}
    if len(loads) > most_loads:
        load = uuid.uuid4().hex[:12]
        for name, state in states.items():
            state.write.parquet(f"{root}/states/{load}/{name}")
        files = files.withColumn("load", F.lit(load))
        states = {name: _live(spark, root, name, [load], files) for name in _SCHEMAS}
    version = f"v{int(found[-1][1:]) + 1 if found else 1:010d}"
    path = f"{root}/versions/{version}"
    files.write.mode("overwrite").parquet(f"{path}/files")
    summary_of_states(**states).write.mode("overwrite").parquet(f"{path}/summary")
    mark_complete(spark, path)
    return Refresh(version, len(fresh), n_kept, dropped, spark.read.parquet(f"{path}/summary"))


def vacuum_summary(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions and the states that none of them names; how many folders went."""
    root = root.rstrip("/")
    found = complete_versions(spark, f"{root}/versions")
    if keep < 1:
        raise ValueError("keep at least one version")
    kept = found[-keep:]
    named = {r["load"] for v in kept for r in
             spark.read.schema(_FILES).parquet(f"{root}/versions/{v}/files").select("load").distinct().collect()}
    old = {r["load"] for v in found[:-keep] for r in
           spark.read.schema(_FILES).parquet(f"{root}/versions/{v}/files").select("load").distinct().collect()} - named
    gone = [f"{root}/versions/{v}" for v in found[:-keep]] + [f"{root}/states/{x}" for x in sorted(old)]
    for path in gone:
        delete_path(spark, path)
    return len(gone)


def _key():
    """What one state of a file goes by: its path, size and modification time."""
    return F.concat_ws("|", "_metadata.file_path", F.col("_metadata.file_size").cast("string"),
                       F.unix_micros("_metadata.file_modification_time").cast("string"))


def _code():
    """A number for a file's key: rows and states of one load go by it instead of the long key."""
    return F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")


def _listing(spark: SparkSession, source: str) -> DataFrame:
    """(file, key, code) of the Parquet files below ``source``; their content is not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(source))
    return files.select(F.col("_metadata.file_path").alias("file"), _key().alias("key"), _code().alias("code"))


def _live(spark: SparkSession, root: str, name: str, loads: list[str], files: DataFrame) -> DataFrame:
    """The states of the listed files."""
    paths = [p for x in loads if path_exists(spark, p := f"{root}/states/{x}/{name}")]
    if not paths:
        return spark.createDataFrame([], _SCHEMAS[name])
    return spark.read.schema(_SCHEMAS[name]).parquet(*paths).join(files.select("key"), "key", "left_semi")


def _write_states(rows: DataFrame, path: str, files: DataFrame) -> None:
    """The states of ``rows`` under their files' keys; ``files`` has (_key, key), a row per file of the load."""
    keyed = rows.select("_key", *COLUMNS)

    def write(state: DataFrame, name: str) -> None:
        named = state.join(F.broadcast(files), "_key")
        named.select(*[F.col(c) for c in spark.createDataFrame([], _SCHEMAS[name]).columns]).write.parquet(f"{path}/{name}")

    spark = rows.sparkSession
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in MEASURES:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}_n"), F.count_if(x.isNull() | F.isnan(x)).alias(f"{c}_missing"),
                 F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.sum(x).alias(f"{c}_sum")]
    write(keyed.groupBy("_key", *GROUPS).agg(*aggs), "cells")
    numbers = keyed.select(*[F.col(c).cast("double").alias(c) for c in CORRELATION_COLUMNS], "_key")
    write(numbers.mapInArrow(_file_moments(len(CORRELATION_COLUMNS)), f"_key long, {_MOMENTS}"), "moments")
    values = keyed.select("_key", F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("value")) for i, c in enumerate(SUMMARY_NUMERIC_COLUMNS)])))
    counts = values.where(F.col("value").isNotNull()).groupBy("_key", "i", "value").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in SUMMARY_NUMERIC_COLUMNS])
    write(counts.withColumn("column", F.get(names, F.col("i"))), "values")


def _file_moments(k: int):
    """``_co_moments`` of each run of rows of one file; the file's code is the column after the ``k`` numbers."""
    of_run = _co_moments(k)

    def runs(batches):
        for batch in batches:
            codes = batch.column(k).dictionary_encode()
            at = codes.indices.to_numpy(zero_copy_only=False)
            if not len(at):
                continue
            starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
            for a, b in zip(starts[:-1], starts[1:]):
                yield codes.dictionary[int(at[a])].as_py(), batch.slice(int(a), int(b - a))

    def run(batches):
        for key, group in groupby(runs(batches), key=lambda x: x[0]):
            for out in of_run(b for _, b in group):
                yield pa.RecordBatch.from_arrays([pa.array([key] * out.num_rows, pa.int64()), *out.columns],
                                                 names=["_key", *out.schema.names])

    return run


# ---------------------------------------------------------------- merging


def summary_of_states(cells: DataFrame, moments: DataFrame, values: DataFrame) -> DataFrame:
    """(section, key, value) rows of the summary from the states of any set of files."""
    merged = materialized(cells.groupBy(*GROUPS).agg(*_merged()), "summary_cells")
    pairs = materialized(_merged_moments(moments), "summary_moments")
    counts = materialized(values.groupBy("column", "value").agg(F.sum("n").alias("n")), "summary_values")
    out = _counts(merged)
    for part in (_top(merged), _stats(merged, pairs, counts), _missing(merged), _tiers(merged), _categories(merged),
                 _texts(merged), _correlations(pairs)):
        out = out.unionByName(part)
    return out


def _merged() -> list:
    """Aggregates that merge cells into coarser ones of the same columns."""
    by_kind = {"n": F.sum, "missing": F.sum, "min": F.min, "max": F.max, "sum": F.sum}
    return [F.sum("n").alias("n"), *[f(f"{c}_{k}").alias(f"{c}_{k}") for c in MEASURES for k, f in by_kind.items()]]


def _rows(df: DataFrame, section: str, pairs: list) -> DataFrame:
    """One (section, key, value) row per (key, value) pair of columns."""
    return df.select(F.lit(section).alias("section"), F.inline(F.array(*[
        F.struct(k.alias("key"), v.cast("double").alias("value")) for k, v in pairs])))


def _counts(cells: DataFrame) -> DataFrame:
    names = ("total_products", "main_categories", "sub_categories")
    totals = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(names[0]), F.count_distinct("main_category").alias(names[1]),
                       F.count_distinct("sub_category").alias(names[2]))
    return _rows(totals, "counts", [(F.lit(k), F.col(k)) for k in names])


def _top(cells: DataFrame, n: int = 10) -> DataFrame:
    top = cells.groupBy("main_category").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc("main_category")).limit(n)
    return _rows(top, "top_categories", [(F.col("main_category"), F.col("n"))])


def _tiers(cells: DataFrame) -> DataFrame:
    return _rows(cells.groupBy("price_tier").agg(F.sum("n").alias("n")), "price_tiers", [(F.col("price_tier"), F.col("n"))])


def _mean(c: str):
    return F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n"))


def _stats(cells: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Extremes and means from the cells, medians from the value counts, deviations from the moments."""
    whole = cells.agg(*_merged())
    flat = whole.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(CORRELATION_COLUMNS.index(c)).alias("i"), F.col(f"{c}_min").alias("min"),
                 F.col(f"{c}_max").alias("max"), _mean(c).alias("mean"), F.col(f"{c}_n").alias("m")) for c in SUMMARY_NUMERIC_COLUMNS])))
    own = pairs.where("i = j").select("i", "vi")
    medians = quantiles_of_counts(counts, [0.5]).select("column", F.get("quantiles", F.lit(0)).alias("median"))
    std = F.when(F.isnan("mean"), F.lit(float("nan"))).when(F.col("m") > 1, F.sqrt(F.col("vi") / (F.col("m") - 1)))
    all_ = (flat.join(F.broadcast(own), "i", "left").join(F.broadcast(medians), "column", "left")  # one row per column
            .withColumn("std", std))
    return _rows(all_, "stats", [(F.concat("column", F.lit(f".{s}")), round_half_up(F.col(s))) for s in STAT_NAMES])


def _missing(cells: DataFrame) -> DataFrame:
    return _rows(cells.agg(*_merged()), "missing",
                 [(F.lit(c), F.col(f"{c}_missing")) for c in SUMMARY_NUMERIC_COLUMNS]).where("value > 0")


def _categories(cells: DataFrame) -> DataFrame:
    merged = cells.groupBy("main_category").agg(*_merged(), F.count_distinct("sub_category").alias("subs"))
    made = dict(zip(CATEGORY_KEYS, (
        F.col("n"), round_half_up(_mean("actual_price")), round_half_up(_mean(TARGET)), round_half_up(_mean("rating")),
        F.col("rating_count_sum"), F.col("subs"), round_half_up(F.col("actual_price_min")), round_half_up(F.col("actual_price_max")))))
    return _rows(merged, "categories", [(F.concat("main_category", F.lit(f".{k}")), v) for k, v in made.items()])


def _texts(cells: DataFrame) -> DataFrame:
    return _rows(cells.agg(*_merged()), "texts", [
        (F.lit(f"{c}.{k}"), round_half_up(v)) for c in TEXT_COLUMNS
        for k, v in (("min", F.col(f"{c}_min")), ("max", F.col(f"{c}_max")), ("mean", _mean(c)))])


def _merged_moments(moments: DataFrame) -> DataFrame:
    """(i, j, vi, vj, c): sums of squares and products around the overall means, in two map-side aggregates."""
    weighted = lambda m: F.sum(F.col("n") * F.col(m)) / F.sum("n")
    means = moments.groupBy("i", "j").agg(weighted("mi").alias("xi"), weighted("mj").alias("xj"))
    di, dj = F.col("mi") - F.col("xi"), F.col("mj") - F.col("xj")
    return moments.join(F.broadcast(means), ["i", "j"]).groupBy("i", "j").agg(  # one row per pair of columns
        F.sum(F.col("ci") + F.col("n") * di * di).alias("vi"), F.sum(F.col("cj") + F.col("n") * dj * dj).alias("vj"),
        F.sum(F.col("cij") + F.col("n") * di * dj).alias("c"))


def _correlations(pairs: DataFrame) -> DataFrame:
    names = pairs.sparkSession.createDataFrame(
        [(i, j, f"{a}|{b}") for i, a in enumerate(CORRELATION_COLUMNS) for j, b in enumerate(CORRELATION_COLUMNS) if i < j],
        "i int, j int, key string")
    x = F.try_divide(F.col("c"), F.sqrt("vi") * F.sqrt("vj"))
    r = F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return names.join(pairs, ["i", "j"], "left").select(F.lit("correlations").alias("section"), "key", round_half_up(r, 3).alias("value"))
