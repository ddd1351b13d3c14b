"""Dataset profile (EDA) operators.

Shape rules used throughout:

* Every section is a single aggregate pass (partial aggregation on the map
  side, a tiny final merge); several columns are profiled in the *same* pass
  and unpivoted afterwards with ``inline`` on a one-row result.
* Histograms are right-closed CASE bins; empty bins are kept by joining the
  per-bin counts (at most #bins rows) to the fixed bins table.
* Exact quantiles (linear interpolation, like pandas) come from values dealt
  into ranges (``operators.quantiles``); ``exact=False`` takes a sketch.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.constants import (
    CORRELATION_COLUMNS,
    DISCOUNT_HIST_EDGES,
    DISCOUNT_HIST_LABELS,
    PRICE_HIST_EDGES,
    PRICE_HIST_LABELS,
    RATING_HIST_EDGES,
    RATING_HIST_LABELS,
    TARGET,
)
from shelfspark.functions.bins import bins_frame, right_closed_bin
from shelfspark.functions.numeric import round_half_up
from shelfspark.operators.quantiles import exact_quantiles
from shelfspark.session import materialized

# Functions of this module run inside Python workers; shipped by value, executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STAT_NAMES = ("min", "max", "mean", "median", "std")


def _stat(c: Column, name: str) -> Column:
    if name == "min":
        return F.min(c).cast("double")
    if name == "max":
        return F.max(c).cast("double")
    if name == "mean":
        return F.avg(c)
    if name == "std":
        return F.stddev_samp(c)
    if name == "std_pop":
        return F.stddev_pop(c)
    if name == "sum":
        return F.sum(c).cast("double")
    if name == "count":
        return F.count(c).cast("double")
    raise ValueError(name)


def numeric_stats(
    df: DataFrame,
    columns: Sequence[str],
    stats: Sequence[str] = STAT_NAMES,
    percentiles: Sequence[float] = (),
    digits: int | None = 2,
    exact: bool = True,
    written: bool = False,
) -> DataFrame:
    """Long-format stats: one row per column, one column per statistic.

    All columns are aggregated in one pass over ``df`` (nulls ignored).  For exact
    quantiles (the median among them) the columns are written once (unless ``df``
    is a stored table, ``written``), so that ``df`` is computed once for all
    passes.  ``exact=False`` takes a sketch in the same pass instead.
    """
    df = df.select(*[F.col(c) for c in columns])
    levels = sorted(set(percentiles) | ({0.5} if "median" in stats else set()))
    if levels and exact and not written:
        df = materialized(df, "profile_columns")
    aggs: list[Column] = []
    for i, col in enumerate(columns):
        aggs += [_stat(F.col(col), s).alias(f"_{i}_{s}") for s in stats if s != "median"]
        if levels and not exact:
            arr = F.array(*[F.lit(q) for q in levels])
            aggs.append(F.percentile_approx(F.col(col), arr, 100000).cast("array<double>").alias(f"_{i}_q"))
        elif not aggs:
            aggs.append(F.count(F.lit(1)).alias("_n"))
    rest = [s for s in stats if s != "median"]
    rows = F.array(*[
        F.struct(F.lit(col).alias("column"), F.lit(i).alias("_i"), *[F.col(f"_{i}_{s}").alias(s) for s in rest],
                 *([F.col(f"_{i}_q").alias("quantiles")] if levels and not exact else []))
        for i, col in enumerate(columns)])
    out = df.agg(*aggs).select(F.inline(rows))
    if levels and exact:
        out = out.join(F.broadcast(exact_quantiles(df, columns, levels, written=True)), "column", "left")  # one row per column
    named = {s: F.col(s) for s in rest}
    if levels:
        named |= {f"p{int(round(q * 100))}": F.get("quantiles", F.lit(levels.index(q))) for q in percentiles}
        if "median" in stats:
            named["median"] = F.get("quantiles", F.lit(levels.index(0.5)))
    rnd = (lambda x: round_half_up(x, digits)) if digits is not None else (lambda x: x)
    names = list(stats) + [f"p{int(round(q * 100))}" for q in percentiles]
    return out.select("column", *[rnd(named[n]).alias(n) for n in names])


def histogram(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str],
              fill_null: float | None = None) -> DataFrame:
    """Counts per right-closed bin, empty bins included, in bin order.

    ``fill_null`` replaces nulls before binning (the price histogram bins
    null as 0, which then falls outside the first bin).
    """
    c = F.col(column)
    if fill_null is not None:
        c = F.coalesce(c, F.lit(fill_null))
    bin_no, _ = right_closed_bin(c, edges, labels)
    counts = (df.select(bin_no.alias("bin_no")).where(F.col("bin_no").isNotNull())
                .groupBy("bin_no").agg(F.count(F.lit(1)).alias("n")))
    bins = bins_frame(df.sparkSession, labels)
    return (bins.join(counts, "bin_no", "left")
                .select("bin_no", "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


# ---------------------------------------------------------------- sections


def dataset_info(df: DataFrame) -> DataFrame:
    """Row count, column count and column names."""
    return df.agg(F.count(F.lit(1)).alias("total_products")).select(
        "total_products",
        F.lit(len(df.columns)).cast("bigint").alias("total_features"),
        F.lit(",".join(df.columns)).alias("features"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts per value, descending (ties by value); optional top-n."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))
    return out.limit(top) if top else out


def category_distribution(df: DataFrame, top: int = 15) -> DataFrame:
    """Distinct count and top-``top`` counts for main and sub category.

    Output: level, category, n, rank, unique_count.  The per-level top-k is a
    window over the *aggregated* counts (one row per category), never over raw
    rows.
    """
    parts = []
    for level, col in (("main", "main_category"), ("sub", "sub_category")):
        counts = df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.select(F.lit(level).alias("level"), "category", "n"))
    allc = parts[0].unionByName(parts[1])
    # rank <= top becomes a WindowGroupLimit: each task keeps `top` rows per level
    w = Window.partitionBy("level").orderBy(F.desc("n"), F.asc("category"))
    ranked = allc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    uniq = allc.groupBy("level").agg(F.count(F.lit(1)).alias("unique_count"))
    return ranked.join(uniq, "level")


def price_tier_counts(df: DataFrame) -> DataFrame:
    """Count per price tier."""
    return df.groupBy("price_tier").agg(F.count(F.lit(1)).alias("n"))


def category_depth_stats(df: DataFrame) -> DataFrame:
    """Histogram by depth plus min, max and mean depth (derived from the histogram)."""
    hist = df.groupBy("category_depth").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # the histogram has one row per distinct depth
    return hist.select(
        "category_depth", "n",
        F.min("category_depth").over(whole).alias("min_depth"),
        F.max("category_depth").over(whole).alias("max_depth"),
        round_half_up(F.sum(F.col("category_depth") * F.col("n")).over(whole)
                      / F.sum("n").over(whole)).alias("mean_depth"),
    )


def price_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """min,max,mean,median,std and p25/50/75/90/99 of both prices, one pass."""
    cols = [c for c in ("actual_price", "discounted_price") if c in df.columns]
    return numeric_stats(df, cols, STAT_NAMES, (0.25, 0.5, 0.75, 0.9, 0.99), exact=exact)


def price_histogram(df: DataFrame) -> DataFrame:
    """7 right-closed price bins; null counts as 0 and so falls outside."""
    return histogram(df, "actual_price", PRICE_HIST_EDGES, PRICE_HIST_LABELS, fill_null=0.0)


def rating_stats(df: DataFrame) -> DataFrame:
    return numeric_stats(df, ["rating"])


def rating_histogram(df: DataFrame) -> DataFrame:
    """6 bins (0,1] … (4.5,5.01]; nulls and 0 fall outside."""
    return histogram(df, "rating", RATING_HIST_EDGES, RATING_HIST_LABELS)


def rating_count_stats(df: DataFrame) -> DataFrame:
    """min, max, mean, median and total of rating_count."""
    c = F.col("rating_count")
    return df.agg(
        F.min(c).cast("bigint").alias("min"),
        F.max(c).cast("bigint").alias("max"),
        round_half_up(F.avg(c)).alias("mean"),
        round_half_up(F.percentile(c, F.lit(0.5))).alias("median"),
        F.sum(c).cast("bigint").alias("total_reviews"),
    )


def discount_stats(df: DataFrame) -> DataFrame:
    return numeric_stats(df, [TARGET])


def discount_histogram(df: DataFrame) -> DataFrame:
    """10 bins (0,10] … (90,101]; discount 0 falls outside."""
    return histogram(df, TARGET, DISCOUNT_HIST_EDGES, DISCOUNT_HIST_LABELS)


def discount_by_category(df: DataFrame) -> DataFrame:
    """Mean, median and non-null count of discount per main category (null keys dropped)."""
    d = F.col(TARGET)
    return (df.where(F.col("main_category").isNotNull())
              .groupBy("main_category")
              .agg(round_half_up(F.avg(d)).alias("mean_discount"),
                   round_half_up(F.median(d)).alias("median_discount"),
                   F.count(d).alias("n")))


def text_length_stats(df: DataFrame) -> DataFrame:
    """min, max, mean, median of name and description lengths (one pass)."""
    return numeric_stats(df, ["name_length", "description_length"], ("min", "max", "mean", "median"))


def sentiment_stats(df: DataFrame, column: str = "review_sentiment") -> DataFrame:
    """min/max/mean at 3 dp and counts of positive, negative and neutral sentiment."""
    s = F.col(column)
    return df.agg(
        round_half_up(F.min(s), 3).alias("min"),
        round_half_up(F.max(s), 3).alias("max"),
        round_half_up(F.avg(s), 3).alias("mean"),
        F.count_if(s > 0).alias("positive_count"),
        F.count_if(s < 0).alias("negative_count"),
        F.count_if(s == 0).alias("neutral_count"),
    )


def _is_missing(df: DataFrame, col: str) -> Column:
    c = F.col(col)
    dtype = dict(df.dtypes)[col]
    return (c.isNull() | F.isnan(c)) if dtype in ("double", "float") else c.isNull()


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per-column missing count and % (only columns with any), plus complete rows.

    One pass: a ``count_if`` per column and one for complete rows; the
    percentages use ``try_divide`` so an empty input gives null, not an error.
    """
    columns = list(columns or df.columns)
    df = df.select(*[F.col(c) for c in columns])
    flags = [_is_missing(df, col).cast("int") for col in columns]
    # "complete" = the missing flags sum to 0; an integer sum keeps Catalyst's
    # boolean simplification from expanding a wide OR over inlined expressions.
    n_missing_in_row = flags[0]
    for f in flags[1:]:
        n_missing_in_row = n_missing_in_row + f
    aggs = [F.sum(f).cast("bigint").alias(f"_m{i}") for i, f in enumerate(flags)]
    wide = df.agg(F.count(F.lit(1)).alias("_total"), F.count_if(n_missing_in_row == 0).alias("_complete"), *aggs)
    pct = lambda x: round_half_up(F.try_divide(x.cast("double") * F.lit(100.0), F.col("_total").cast("double")))
    rows = F.array(*[F.struct(F.lit(col).alias("column"), F.col(f"_m{i}").alias("n_missing"))
                     for i, col in enumerate(columns)])
    return (wide.select("_total", "_complete", F.inline(rows))
                .where(F.col("n_missing") > 0)
                .select("column", "n_missing", pct(F.col("n_missing")).alias("pct_missing"),
                        F.col("_complete").alias("complete_rows"),
                        pct(F.col("_complete")).alias("complete_pct")))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column (all columns, zero included) with the column's type."""
    types = dict(df.dtypes)
    wide = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                              F.col(f"_n{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    return wide.select(F.inline(rows))


def correlation_matrix(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS,
                       digits: int = 3) -> DataFrame:
    """Pairwise-complete Pearson r for every column pair.

    One pass: every task adds up, per Arrow batch, the co-moments of all pairs as
    matrix products over the rows where both values are present, batch means
    taken out (batches merge by their means, so nothing cancels), and gives one
    row per pair.  These few rows merge around the pairs' overall means.  A
    constant column gives null.
    """
    cols = [c for c in columns if c in df.columns]
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    k = len(cols)
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    parts = src.mapInArrow(_co_moments(k), _MOMENTS)
    sums = parts.groupBy("i", "j").applyInArrow(_merge_moments, "i int, j int, vi double, vj double, c double")
    x = F.try_divide(F.col("c"), F.sqrt("vi") * F.sqrt("vj"))
    r = (F.when(F.col("i") == F.col("j"), F.when(F.col("vi") > 0, F.lit(1.0)))
         .otherwise(F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))))
    pairs = df.sparkSession.createDataFrame(
        [(a, b, min(i, j), max(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)],
        "column_a string, column_b string, i int, j int")
    return (pairs.join(sums.withColumn("r", r).select("i", "j", "r"), ["i", "j"], "left")
            .select("column_a", "column_b", round_half_up(F.col("r"), digits).alias("r")))


_MOMENTS = "i int, j int, n double, mi double, mj double, ci double, cj double, cij double"


def _merge_moments(t: pa.Table) -> pa.Table:
    """One pair's rows of all tasks: sums of squares and of products around the overall means."""
    n, mi, mj, ci, cj, cij = (t[c].to_numpy() for c in ("n", "mi", "mj", "ci", "cj", "cij"))
    di, dj = mi - (n * mi).sum() / n.sum(), mj - (n * mj).sum() / n.sum()
    return pa.table({"i": t["i"][:1], "j": t["j"][:1], "vi": [float((ci + n * di * di).sum())],
                     "vj": [float((cj + n * dj * dj).sum())], "c": [float((cij + n * di * dj).sum())]})


def _co_moments(k: int):
    """Per task one row per pair i <= j of ``k`` columns: rows with both, their means and centred (co-)moments."""

    def run(batches):
        n, mi, mj, ci, cj, cij = (np.zeros((k, k)) for _ in range(6))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(k)], axis=1).astype(np.float64)
            has = ~np.isnan(x)
            held = has.astype(np.float64)
            near = np.divide(np.where(has, x, 0).sum(axis=0), np.maximum(1, has.sum(axis=0)))
            x = np.where(has, x - near, 0)  # around the batch's means, so that squares stay small
            m = held.T @ held
            least = np.maximum(1, m)
            s = x.T @ held  # s[i, j]: sum of column i where j is present
            q = (x * x).T @ held
            bi, bj = s / least, s.T / least
            b_ci, b_cj, b_cij = q - s * bi, q.T - s.T * bj, x.T @ x - s * bj
            bi, bj = bi + near[:, None], bj + near[None, :]
            total = np.maximum(1, n + m)
            di, dj, w = bi - mi, bj - mj, n * m / total
            ci, cj, cij = ci + b_ci + di * di * w, cj + b_cj + dj * dj * w, cij + b_cij + di * dj * w
            mi, mj, n = mi + di * m / total, mj + dj * m / total, n + m
        i, j = np.triu_indices(k)
        keep = n[i, j] > 0
        i, j = i[keep], j[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t[i, j]) for t in (n, mi, mj, np.maximum(ci, 0), np.maximum(cj, 0), cij)]],
            names=["i", "j", "n", "mi", "mj", "ci", "cj", "cij"])

    return run


def target_correlations(df: DataFrame, target: str = TARGET,
                        columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Correlations with the target, strongest first, self excluded."""
    cm = correlation_matrix(df, columns)
    return (cm.where((F.col("column_a") == target) & (F.col("column_b") != target))
              .select(F.col("column_b").alias("feature"), "r")
              .orderBy(F.abs("r").desc_nulls_last(), "feature"))


def category_summary(df: DataFrame, category: str | None = None) -> DataFrame:
    """Per main category: count, mean price/discount/rating, total reviews,
    distinct sub-categories, price range.  With ``category``, one row — or an
    error row when the category does not exist.
    """
    src = df.where(F.col("main_category") == F.lit(category)) if category is not None else df
    out = src.groupBy("main_category").agg(
        F.count(F.lit(1)).alias("product_count"),
        round_half_up(F.avg("actual_price")).alias("avg_price"),
        round_half_up(F.avg(TARGET)).alias("avg_discount"),
        round_half_up(F.avg("rating")).alias("avg_rating"),
        F.sum("rating_count").cast("bigint").alias("total_reviews"),
        F.count_distinct("sub_category").alias("sub_categories"),
        round_half_up(F.min("actual_price")).alias("price_min"),
        round_half_up(F.max("actual_price")).alias("price_max"),
    ).withColumn("error", F.lit(None).cast("string"))
    if category is None:
        return out
    # one-category form: an aggregate without grouping always yields one row,
    # so an unknown category turns into an error row.
    chk = src.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 0).select(
        F.lit(category).alias("main_category"),
        *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes if c not in ("main_category", "error")],
        F.lit(f"Category '{category}' not found").alias("error"))
    return out.unionByName(chk)


def distinct_main_categories(df: DataFrame, approx: bool = False) -> DataFrame:
    """Number of distinct main (and sub) categories."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(fn("main_category").alias("main_categories"), fn("sub_category").alias("sub_categories"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated), max per column."""
    out = numeric_stats(df, columns, ("count", "mean", "std", "min", "max"), (0.25, 0.5, 0.75))
    return out.withColumn("count", F.col("count").cast("bigint")).select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def head_rows(df: DataFrame, n: int = 5, order_by: Sequence[str] = ("product_id",)) -> DataFrame:
    """First ``n`` rows by an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def dataset_summary(df: DataFrame, written: bool = False) -> DataFrame:
    """Catalog summary as (section, key, value) rows: counts, top-10 main
    categories, stats of the five numeric columns, missing counts.
    ``written``: ``df`` is a stored table, read as it is for every section.
    """
    from shelfspark.constants import SUMMARY_NUMERIC_COLUMNS

    cols = [c for c in SUMMARY_NUMERIC_COLUMNS if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).cast("double").alias("total_products"),
        F.count_distinct("main_category").cast("double").alias("main_categories"),
        F.count_distinct("sub_category").cast("double").alias("sub_categories"),
    )
    counts = counts.select(F.lit("counts").alias("section"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))
        for k in ("total_products", "main_categories", "sub_categories")])))
    top = (value_counts(df, "main_category", 10)
           .select(F.lit("top_categories").alias("section"), F.col("main_category").alias("key"),
                   F.col("n").cast("double").alias("value")))
    stats = numeric_stats(df, cols, digits=None, written=written)
    stats = stats.select(F.lit("stats").alias("section"), F.inline(F.array(*[
        F.struct(F.concat(F.col("column"), F.lit("."), F.lit(s)).alias("key"),
                 round_half_up(F.col(s)).alias("value")) for s in STAT_NAMES])))
    miss = missing_values(df, cols).select(F.lit("missing").alias("section"), F.col("column").alias("key"),
                                           F.col("n_missing").cast("double").alias("value"))
    return counts.unionByName(top).unionByName(stats).unionByName(miss)


def top_products(df: DataFrame, by: str = "rating", n: int = 10, category: str | None = None,
                 order: Sequence[str] = ("product_id", "order_key", "line_number", "supp_key")) -> DataFrame:
    """``n`` rows with the largest ``by`` (whitelisted metric), optional main
    category; id, name, category and metrics rounded to 2 dp."""
    from shelfspark.constants import TOP_PRODUCT_METRICS
    if by not in TOP_PRODUCT_METRICS:
        raise ValueError(f"by must be one of {TOP_PRODUCT_METRICS}")
    if not 1 <= n <= 100:
        raise ValueError("n must be within [1, 100]")
    src = df.where(F.col("main_category") == F.lit(category)) if category is not None else df
    ties = [c for c in order if c in df.columns]
    top = src.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n)
    return top.select("product_id", "product_name", "main_category",
                      *[round_half_up(c).alias(c) for c in ("rating", "actual_price", "discount_percentage")],
                      "rating_count")
