"""Data and prediction drift: reference stats, PSI, two-sample KS, MAE rise,
coefficient-of-variation score.

All tests work on a tidy ``(feature, value)`` form obtained with
``unpivot``, so any number of features runs in the same jobs.  Everything
that is brought to the driver or broadcast is bounded by the number of
features (× bins or × buckets), never by rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.constants import (
    CV_TARGET,
    DEFAULT_DRIFT_THRESHOLD,
    PREDICTION_DRIFT_MAE_RISE,
    PSI_BINS,
    PSI_DRIFT_THRESHOLD,
    PSI_EPS,
    PSI_HIGH,
    PSI_MEDIUM,
)
from shelfspark.operators.quantiles import value_ranges
from shelfspark.session import materialized


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value double) — nulls dropped."""
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return (cast.unpivot([], list(columns), "feature", "value")
                .where(F.col("value").isNotNull() & ~F.isnan("value")))


def drift_reference_stats(ref: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: mean, population std, min, max, p25, p50, p75 (linear)."""
    v = F.col("value")
    return long_form(ref, columns).groupBy("feature").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.5)).alias("p50"),
        F.percentile(v, F.lit(0.75)).alias("p75"))


# ---------------------------------------------------------------- PSI


def _edge(i: Column, first: Column, last: Column, step: Column, n_bins: int) -> Column:
    """Edge i of ``linspace(first, last, n_bins + 1)``: i·step + first, last exact."""
    return F.when(i == n_bins, last).otherwise(i.cast("double") * step + first)


def histogram_bins(value: Column, first: Column, last: Column, n_bins: int) -> Column:
    """Equal-width bin of ``value`` with edges ``linspace(first, last, n+1)``:
    bins are left-closed, the last also right-closed; outside → null.  Same
    edge arithmetic and boundary corrections as NumPy's histogram.
    """
    step = (last - first) / F.lit(float(n_bins))
    norm = F.lit(float(n_bins)) / (last - first)
    raw = F.floor((value - first) * norm).cast("int")
    idx = F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1))
    lo = _edge(idx, first, last, step, n_bins)
    hi = _edge(idx + 1, first, last, step, n_bins)
    fixed = (F.when(value < lo, idx - 1)
              .when((value >= hi) & (idx != n_bins - 1), idx + 1)
              .otherwise(idx))
    inside = (value >= first) & (value <= last)
    return F.when(inside, fixed)


def psi_drift(ref: DataFrame, cur: DataFrame, columns: Sequence[str], n_bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per feature.

    Bins: ``n_bins`` equal-width on the reference min..max (min = max widens
    to ±0.5).  Shares are (count + 0.001) / rows, where rows include current
    values outside the reference range (they are not binned).
    PSI = Σ (cur − ref)·ln(cur/ref); drift when PSI ≥ 0.2; severity high ≥ 0.25,
    medium ≥ 0.1, else low.
    """
    r = long_form(ref, columns).withColumn("side", F.lit(0))
    c = long_form(cur, columns).withColumn("side", F.lit(1))
    rng = r.groupBy("feature").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    rng = rng.select("feature",
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("first"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("last"))
    both = r.unionByName(c).join(F.broadcast(rng), "feature")  # one row per feature
    binned = both.select("feature", "side",
                         histogram_bins(F.col("value"), F.col("first"), F.col("last"), n_bins).alias("bin"))
    # one aggregate (≤ features × (bins + 1) rows): per-bin counts plus the
    # out-of-range (null bin) group; totals are derived from it, no second scan
    per_bin = (binned.groupBy("feature", "bin")
                     .agg(F.count_if(F.col("side") == 0).alias("rc"), F.count_if(F.col("side") == 1).alias("cc")))
    totals = per_bin.groupBy("feature").agg(F.sum("rc").alias("n_ref"), F.sum("cc").alias("n_cur"))
    counts = per_bin.where(F.col("bin").isNotNull())
    grid = totals.select("feature", "n_ref", "n_cur", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin",
        ((F.coalesce("rc", F.lit(0)) + F.lit(PSI_EPS)) / F.col("n_ref")).alias("rp"),
        ((F.coalesce("cc", F.lit(0)) + F.lit(PSI_EPS)) / F.col("n_cur")).alias("cp"))
    psi = full.groupBy("feature").agg(
        F.sum((F.col("cp") - F.col("rp")) * F.log(F.col("cp") / F.col("rp"))).alias("psi"))
    return psi.select(
        "feature", "psi", (F.col("psi") >= PSI_DRIFT_THRESHOLD).alias("drift_detected"),
        F.when(F.col("psi") >= PSI_HIGH, "high").when(F.col("psi") >= PSI_MEDIUM, "medium")
         .otherwise("low").alias("severity"))


# ---------------------------------------------------------------- KS


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = 8) -> Column:
    """Asymptotic two-sample p-value of D at λ = D·sqrt(nm/(n+m)), to double precision.

    λ ≥ 1: 2Σ(−1)^(k−1)·exp(−2k²λ²).  λ < 1: 1 − (√(2π)/λ)·Σ exp(−(2k−1)²π²/(8λ²)),
    the same function by its theta identity.  Either series is exact to the last
    bit within ``terms`` terms on its side of λ = 1.
    """
    lam = d * F.sqrt(n.cast("double") * m.cast("double") / (n + m).cast("double"))
    ks = F.sequence(F.lit(1), F.lit(terms))
    large = F.lit(2.0) * F.aggregate(
        ks, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * (k * k).cast("double") * lam * lam))
    odd = lambda k: (F.lit(2.0) * k.cast("double") - F.lit(1.0))
    small = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / lam * F.aggregate(
        ks, F.lit(0.0), lambda acc, k: acc + F.exp(-odd(k) * odd(k) * F.lit(math.pi ** 2 / 8) / (lam * lam)))
    p = F.when(lam <= 0.04, F.lit(1.0)).when(lam < 1, small).otherwise(large)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def ks_two_sample(ref: DataFrame, cur: DataFrame, columns: Sequence[str],
                  threshold: float | None = None) -> DataFrame:
    """Two-sample Kolmogorov–Smirnov statistic and p-value per feature.

    D = max over values x of |F_ref(x) − F_cur(x)|.  Plan:
    1. counts per (feature, value, side), written once — the data reduces to distinct values;
    2. values are range-bucketed per feature by collected split points, the same
       numbers in every use (only the bucketing uses them, D stays exact);
    3. per (feature, bucket) totals → prefix offsets over that small table;
    4. running sums inside each (feature, bucket) window, plus the offset.
    A window holds about one shuffle partition's share of the values, never a whole feature.  Drift when p < threshold (0.1).
    """
    thr = DEFAULT_DRIFT_THRESHOLD if threshold is None else threshold
    r = long_form(ref, columns).withColumn("side", F.lit(0))
    c = long_form(cur, columns).withColumn("side", F.lit(1))
    allv = r.unionByName(c)
    cnt = materialized(allv.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("n1"), F.count_if(F.col("side") == 1).alias("n2")), "ks_counts")
    sides = cnt.groupBy("feature").agg(F.sum("n1").alias("tot1"), F.sum("n2").alias("tot2"))
    b = value_ranges(cnt, "feature", "value").withColumnRenamed("part", "bucket")
    tot = b.groupBy("feature", "bucket").agg(F.sum("n1").alias("b1"), F.sum("n2").alias("b2"))
    wb = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("feature", "bucket", F.coalesce(F.sum("b1").over(wb), F.lit(0)).alias("o1"),
                      F.coalesce(F.sum("b2").over(wb), F.lit(0)).alias("o2"))
    wv = Window.partitionBy("feature", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cdf = (b.join(offs, ["feature", "bucket"]).join(F.broadcast(sides), "feature")  # one row per feature
            .select("feature", "tot1", "tot2",
                    F.abs((F.col("o1") + F.sum("n1").over(wv)) / F.col("tot1")
                          - (F.col("o2") + F.sum("n2").over(wv)) / F.col("tot2")).alias("gap")))
    d = cdf.groupBy("feature").agg(F.max("gap").alias("ks_statistic"), F.max("tot1").alias("tot1"),
                                   F.max("tot2").alias("tot2"))
    p = ks_pvalue(F.col("ks_statistic"), F.col("tot1"), F.col("tot2"))
    return d.select("feature", "ks_statistic", p.alias("p_value"), (p < F.lit(thr)).alias("drift_detected"))


def overall_drift(per_feature: DataFrame) -> DataFrame:
    """Any feature drifting → overall drift (one row)."""
    return per_feature.agg(F.max(F.col("drift_detected").cast("int")).cast("boolean").alias("overall_drift"),
                           F.count_if("drift_detected").alias("features_with_drift"))


# ---------------------------------------------------------------- model drift


def prediction_drift(scored: DataFrame, training_mae: float, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Current MAE/MSE vs the training MAE; drift when MAE rises more than 50 %."""
    err = F.col(prediction) - F.col(label)
    agg = scored.agg(F.avg(F.abs(err)).alias("current_mae"), F.avg(err * err).alias("current_mse"))
    rise = (F.col("current_mae") - F.lit(training_mae)) / F.lit(training_mae + 1e-8)
    return agg.select("current_mae", "current_mse", F.lit(float(training_mae)).alias("training_mae"),
                      (rise * 100).alias("mae_increase_pct"),
                      (rise > PREDICTION_DRIFT_MAE_RISE).alias("drift_detected"))


def cv_drift_score(scored: DataFrame, prediction: str = "prediction", threshold: float | None = None) -> DataFrame:
    """cv = pop-std / (mean + 1e-8) of predictions; score = min(|cv − 0.3|, 1)."""
    thr = DEFAULT_DRIFT_THRESHOLD if threshold is None else threshold
    p = F.col(prediction)
    agg = scored.agg((F.stddev_pop(p) / (F.avg(p) + F.lit(1e-8))).alias("cv"))
    score = F.least(F.abs(F.col("cv") - F.lit(CV_TARGET)), F.lit(1.0))
    return agg.select("cv", score.alias("drift_score"), (score > F.lit(thr)).alias("drift_detected"))


def reference_current_join(ref: DataFrame, cur: DataFrame, columns: Sequence[str], n_bins: int = PSI_BINS) -> DataFrame:
    """Reference vs current bin counts side by side per (feature, bin) (full outer)."""
    r = long_form(ref, columns)
    rng = r.groupBy("feature").agg(F.min("value").alias("first"), F.max("value").alias("last"))

    def counts(df: DataFrame, name: str) -> DataFrame:
        b = df.join(F.broadcast(rng), "feature").select(
            "feature", histogram_bins(F.col("value"), F.col("first"), F.col("last"), n_bins).alias("bin"))
        return b.where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias(name))

    return (counts(r, "ref_count").join(counts(long_form(cur, columns), "cur_count"), ["feature", "bin"], "full_outer")
            .select("feature", "bin", F.coalesce("ref_count", F.lit(0)).alias("ref_count"),
                    F.coalesce("cur_count", F.lit(0)).alias("cur_count")))
