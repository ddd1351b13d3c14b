"""Registered drift queries: lineitem shipped before 1996 is the reference,
the rest is current; plus a ×1.3 shifted copy as a sure drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.numeric import round_half_up
from shelfspark.operators import drift as D
from shelfspark.plans.registry import query
from shelfspark.plans.sql import R2
from shelfspark.sources.tables import read_table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPLIT = "1996-01-01 00:00:00"


def ref_cur(spark, sf_dir, shift: float | None = None):
    li = read_table(spark, sf_dir, "lineitem")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    ref = li.where(F.col("l_shipdate") < cut).select(*FEATURES)
    cur = li.where(F.col("l_shipdate") >= cut).select(*FEATURES)
    if shift is not None:
        cur = cur.select(*[(F.col(c) * F.lit(shift)).alias(c) for c in FEATURES])
    return ref, cur


def _lf_sql(shift: str = "") -> str:
    m = f" * {shift}" if shift else ""
    cols = ", ".join(f"cast({c} AS double) * CASE WHEN l_shipdate < TIMESTAMP '{SPLIT}' THEN 1e0 ELSE 1e0{m} END "
                     f"AS {c}" for c in FEATURES)
    return (f"src AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '{SPLIT}' THEN 0 ELSE 1 END AS side, {cols} "
            f"FROM lineitem),\n"
            f"lf AS (SELECT * FROM (UNPIVOT src ON {', '.join(FEATURES)} INTO NAME feature VALUE value) "
            f"WHERE value IS NOT NULL AND NOT isnan(value))")


def _psi_sql(shift: str = "") -> str:
    return f"""WITH {_lf_sql(shift)},
rng AS (SELECT feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5e0 ELSE min(value) END AS f,
               CASE WHEN min(value) = max(value) THEN max(value) + 0.5e0 ELSE max(value) END AS l
        FROM lf WHERE side = 0 GROUP BY feature),
b AS (SELECT lf.feature, side, value, f, l, (l - f) / 10e0 AS step,
             least(greatest(cast(floor((value - f) * (10e0 / (l - f))) AS integer), 0), 9) AS idx
      FROM lf JOIN rng ON lf.feature = rng.feature),
b3 AS (SELECT feature, side, value, f, l,
         CASE WHEN value < (CASE WHEN idx = 10 THEN l ELSE idx * step + f END) THEN idx - 1
              WHEN value >= (CASE WHEN idx + 1 = 10 THEN l ELSE (idx + 1) * step + f END) AND idx <> 9 THEN idx + 1
              ELSE idx END AS bin0 FROM b),
binned AS (SELECT feature, side, CASE WHEN value >= f AND value <= l THEN bin0 END AS bin FROM b3),
tot AS (SELECT feature, count(*) FILTER (WHERE side = 0) AS n_ref, count(*) FILTER (WHERE side = 1) AS n_cur
        FROM binned GROUP BY feature),
cnt AS (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS rc, count(*) FILTER (WHERE side = 1) AS cc
        FROM binned WHERE bin IS NOT NULL GROUP BY feature, bin),
grid AS (SELECT feature, n_ref, n_cur, unnest(range(10)) AS bin FROM tot),
fl AS (SELECT g.feature, (coalesce(rc, 0) + 0.001e0) / n_ref AS rp, (coalesce(cc, 0) + 0.001e0) / n_cur AS cp
       FROM grid g LEFT JOIN cnt c ON g.feature = c.feature AND g.bin = c.bin),
psi AS (SELECT feature, sum((cp - rp) * ln(cp / rp)) AS psi FROM fl GROUP BY feature)
SELECT feature, {R2('psi', 6)} AS psi, psi >= 0.2e0 AS drift_detected,
       CASE WHEN psi >= 0.25e0 THEN 'high' WHEN psi >= 0.1e0 THEN 'medium' ELSE 'low' END AS severity FROM psi"""


def _psi(spark, sf_dir, shift=None):
    ref, cur = ref_cur(spark, sf_dir, shift)
    out = D.psi_drift(ref, cur, FEATURES)
    return out.select("feature", round_half_up("psi", 6).alias("psi"), "drift_detected", "severity")


@query("psi_drift", oracle=_psi_sql())
def q_psi_drift(spark, sf_dir):
    return _psi(spark, sf_dir)


@query("psi_drift_shifted", oracle=_psi_sql("1.3e0"))
def q_psi_drift_shifted(spark, sf_dir):
    return _psi(spark, sf_dir, 1.3)


def _ks_sql(shift: str = "") -> str:
    lam = "d * sqrt(cast(n1t AS double) * cast(n2t AS double) / cast(n1t + n2t AS double))"
    series = (f"list_sum(list_transform(range(1, 20001), lambda k: (CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END) * "
              f"exp(-2e0 * cast(k * k AS double) * ({lam}) * ({lam}))))")
    p = f"CASE WHEN ({lam}) = 0 THEN 1e0 ELSE least(1e0, greatest(0e0, 2e0 * {series})) END"
    return f"""WITH {_lf_sql(shift)},
cnt AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS n1, count(*) FILTER (WHERE side = 1) AS n2
        FROM lf GROUP BY feature, value),
tot AS (SELECT feature, sum(n1) AS n1t, sum(n2) AS n2t FROM cnt GROUP BY feature),
cdf AS (SELECT c.feature, abs(cast(sum(n1) OVER w AS double) / cast(n1t AS double)
                          - cast(sum(n2) OVER w AS double) / cast(n2t AS double)) AS gap
        FROM cnt c JOIN tot ON c.feature = tot.feature
        WINDOW w AS (PARTITION BY c.feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dd AS (SELECT cdf.feature, max(gap) AS d, any_value(n1t) AS n1t, any_value(n2t) AS n2t
       FROM cdf JOIN tot ON cdf.feature = tot.feature GROUP BY cdf.feature),
pp AS (SELECT feature, d, {p} AS p FROM dd)
SELECT feature, {R2('d', 9)} AS ks_statistic, {R2('p', 6)} AS p_value, p < 0.1e0 AS drift_detected FROM pp"""


def _ks(spark, sf_dir, shift=None):
    ref, cur = ref_cur(spark, sf_dir, shift)
    out = D.ks_two_sample(ref, cur, FEATURES)
    return out.select("feature", round_half_up("ks_statistic", 9).alias("ks_statistic"),
                      round_half_up("p_value", 6).alias("p_value"), "drift_detected")


@query("ks_two_sample", oracle=_ks_sql())
def q_ks_two_sample(spark, sf_dir):
    return _ks(spark, sf_dir)


@query("ks_two_sample_shifted", oracle=_ks_sql("1.3e0"))
def q_ks_two_sample_shifted(spark, sf_dir):
    return _ks(spark, sf_dir, 1.3)


@query("drift_reference_stats", oracle=f"""WITH {_lf_sql()}
SELECT feature, {R2('avg(value)', 6)} AS mean, {R2('stddev_pop(value)', 6)} AS std, {R2('min(value)', 6)} AS min,
       {R2('max(value)', 6)} AS max, {R2('quantile_cont(value, 0.25)', 6)} AS p25,
       {R2('quantile_cont(value, 0.5)', 6)} AS p50, {R2('quantile_cont(value, 0.75)', 6)} AS p75
FROM lf WHERE side = 0 GROUP BY feature""")
def q_drift_reference_stats(spark, sf_dir):
    ref, _ = ref_cur(spark, sf_dir)
    s = D.drift_reference_stats(ref, FEATURES)
    return s.select("feature", *[round_half_up(c, 6).alias(c) for c in ("mean", "std", "min", "max", "p25", "p50", "p75")])


@query("reference_current_join", oracle=f"""WITH {_lf_sql()},
rng AS (SELECT feature, min(value) AS f, max(value) AS l FROM lf WHERE side = 0 GROUP BY feature),
b AS (SELECT lf.feature, side, value, f, l, (l - f) / 10e0 AS step,
             least(greatest(cast(floor((value - f) * (10e0 / (l - f))) AS integer), 0), 9) AS idx
      FROM lf JOIN rng ON lf.feature = rng.feature),
b3 AS (SELECT feature, side, value, f, l,
         CASE WHEN value < (CASE WHEN idx = 10 THEN l ELSE idx * step + f END) THEN idx - 1
              WHEN value >= (CASE WHEN idx + 1 = 10 THEN l ELSE (idx + 1) * step + f END) AND idx <> 9 THEN idx + 1
              ELSE idx END AS bin0 FROM b),
binned AS (SELECT feature, side, CASE WHEN value >= f AND value <= l THEN bin0 END AS bin FROM b3)
SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS ref_count, count(*) FILTER (WHERE side = 1) AS cur_count
FROM binned WHERE bin IS NOT NULL GROUP BY feature, bin""")
def q_reference_current_join(spark, sf_dir):
    ref, cur = ref_cur(spark, sf_dir)
    return D.reference_current_join(ref, cur, FEATURES)
