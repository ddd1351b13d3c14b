"""Operators against brute-force Python/NumPy references on small inputs."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import drift as D
from shelfspark.operators import insights as I
from shelfspark.operators import model as M
from shelfspark.operators import profile as P
from shelfspark.operators.search import semantic_search
from shelfspark.plans.frames import questions_frame
from shelfspark.sources.catalog import ROW_ORDER, catalog_view


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (4.6,), (None,)], "rating double")
    got = {r["bin"]: r["n"] for r in P.rating_histogram(df).collect()}
    assert got == {"0-1": 2, "1-2": 0, "2-3": 0, "3-4": 0, "4-4.5": 0, "4.5-5": 1}


def test_correlation_constant_and_pairwise(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 6.5, 5.0), (4.0, 8.0, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    cm = {(r["column_a"], r["column_b"]): r["r"] for r in P.correlation_matrix(df, ["a", "b", "c"]).collect()}
    x = np.array([1.0, 3.0, 4.0]); y = np.array([2.0, 6.5, 8.0])
    assert cm[("a", "b")] == round(float(np.corrcoef(x, y)[0, 1]), 3)
    assert cm[("a", "a")] == 1.0 and cm[("a", "c")] is None and cm[("c", "c")] is None
    assert all(v is None or -1 <= v <= 1 for v in cm.values())


def test_missing_values_empty_input(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert P.missing_values(df).count() == 0


def test_dedupe_keeps_first_in_row_order(spark):
    df = spark.createDataFrame([("r1", 2, 1, 1, 1, 10.0, "late"), ("r1", 1, 1, 1, 1, 10.0, "first"),
                                ("r2", 3, 1, 1, 1, 1.0, "only")],
                               "review_id string, order_key long, line_number int, part_key long, supp_key long, "
                               "actual_price double, v string")
    got = {r["review_id"]: r["v"] for r in I.dedupe_reviews(df).collect()}
    assert got == {"r1": "first", "r2": "only"}


def test_bundle_pairs_matches_brute_force(spark, sf_small):
    df = questions_frame(spark, sf_small)
    got = [(r["item_a"], r["item_b"], r["count"]) for r in I.bundle_pairs(df, k=10).collect()]
    rows = df.select("user_id", "product_name", *ROW_ORDER).toPandas()
    rows = rows.sort_values(["user_id"] + ROW_ORDER)
    cnt = Counter()
    for _, g in rows.groupby("user_id"):
        cnt.update(combinations(list(g["product_name"]), 2))
    want = sorted(cnt.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))[:10]
    assert got == [(a, b, n) for (a, b), n in want]


def test_label_encode_unseen_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    codes = M.label_codes(train, "c")
    assert {r["label"]: r["code"] for r in codes.collect()} == {"Unknown": 0, "a": 1, "b": 2}
    test = spark.createDataFrame([("a",), ("zzz",), (None,)], "c string")
    assert [r["c_code"] for r in M.label_encode(test, "c", codes).orderBy("c_code").collect()] == [0, 0, 1]


def test_standard_scale_zero_std(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r[0] for r in M.standard_scale(df, {"x": 3.0}, {"x": 0.0}).collect()] == [0.0, 0.0]


def _np_psi(ref, cur, bins=10):
    _, edges = np.histogram(ref, bins=bins)
    r, _ = np.histogram(ref, bins=edges)
    c, _ = np.histogram(cur, bins=edges)
    rp, cp = (r + 0.001) / len(ref), (c + 0.001) / len(cur)
    return float(np.sum((cp - rp) * np.log(cp / rp)))


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(10, 2, 3000).round(2)
    cur = np.concatenate([rng.normal(11, 2.5, 2000), [ref.min(), ref.max(), 100.0]]).round(2)
    r = spark.createDataFrame([(float(v),) for v in ref], "x double")
    c = spark.createDataFrame([(float(v),) for v in cur], "x double")
    got = D.psi_drift(r, c, ["x"]).first()["psi"]
    assert abs(got - _np_psi(ref, cur)) < 1e-9


def _np_ks(a, b):
    xs = np.sort(np.unique(np.concatenate([a, b])))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


def test_ks_statistic_matches_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50, 4000).astype(float)
    b = rng.integers(5, 60, 3000).astype(float)
    ra = spark.createDataFrame([(float(v),) for v in a], "x double")
    rb = spark.createDataFrame([(float(v),) for v in b], "x double")
    row = D.ks_two_sample(ra, rb, ["x"]).first()
    assert abs(row["ks_statistic"] - _np_ks(a, b)) < 1e-12
    assert 0.0 <= row["p_value"] <= 1.0 and row["drift_detected"]


def test_semantic_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 16))
    vecs = np.concatenate([c + 0.3 * rng.normal(size=(40, 16)) for c in centers])
    idx = spark.createDataFrame([(i, [float(x) for x in v], f"c{i % 3}") for i, v in enumerate(vecs)],
                                "id long, vector array<double>, main_category string")
    q = idx.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = semantic_search(q, idx, top_k=5, score_threshold=0.8, n_pivots=8, chunk=16)
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in got.collect())
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    s = u @ u.T
    want = []
    for qi in range(len(u)):
        cand = [(-s[qi, j], j) for j in range(len(u)) if s[qi, j] >= 0.8]
        for rank, (_, j) in enumerate(sorted(cand)[:5], start=1):
            want.append((qi, rank, j))
    assert got == sorted(want)


def test_semantic_search_sends_a_query_once_per_block(spark, monkeypatch):
    from shelfspark.operators import search as S
    rng = np.random.default_rng(5)
    vecs = rng.integers(-2, 3, size=(300, 8)).astype(float)  # many equal scores
    vecs[7] = 0.0
    vecs[100:160] = vecs[5]  # a cell larger than a block
    rows = [(f"v{i}", [float(x) for x in v]) for i, v in enumerate(vecs)] + [("none", None)]
    idx = spark.createDataFrame(rows, "id string, vector array<double>")
    q = idx.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    seen = []
    plain = S._candidate_blocks
    monkeypatch.setattr(S, "_candidate_blocks", lambda *a: seen.append(a[3]) or plain(*a))
    got = S.semantic_search(q, idx, top_k=7, score_threshold=0.0, chunk=32)
    blocks = {b for r in seen[0] for b in r}
    assert len(blocks) <= 300 / 32 * 2 + 2 and len(blocks) < sum(1 for r in seen[0] if len(r))  # cells share blocks
    n = np.linalg.norm(vecs, axis=1, keepdims=True)
    u = np.divide(vecs, n, out=np.zeros_like(vecs), where=n > 0)
    s = np.round(u @ u.T, 9)
    want = sorted((f"v{i}", rank, j) for i in range(300)
                  for rank, (_, j) in enumerate(sorted((-s[i, j], f"v{j}") for j in range(300) if s[i, j] >= 0)[:7], start=1))
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got.collect()) == want


def test_products_take_narrow_order_lines(spark, sf_small):
    from shelfspark.plans.text_queries import products
    plan = products(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    first = plan[plan.rindex("max_by"):]  # the aggregate next to the order lines
    assert "p_name" not in first.split("\n")[0] and "l_discount" in first


def test_catalog_view_prunes_and_pushes(spark, sf_small):
    df = catalog_view(spark, sf_small).where(F.col("order_key") < 100).select("product_id", "order_key")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,100)" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_term_counts_broadcast_stopwords(spark, sf_small):
    from shelfspark.operators.text import term_counts
    from shelfspark.sources.tables import read_table
    df = term_counts(read_table(spark, sf_small, "documents"), "doc_id", "text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("kind", ["normal", "dups", "skew"])
def test_exact_quantiles_refined(spark, kind):
    from shelfspark.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(5)
    data = {"normal": rng.normal(0, 1, 20000),
            "dups": rng.integers(0, 30, 20000).astype(float),
            "skew": np.concatenate([np.full(15000, 3.0), rng.exponential(5, 5000)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    lv = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    found = exact_quantiles(df.withColumn("y", -F.col("x")).withColumn("z", F.lit(None).cast("double")), ["x", "y", "z"], lv)
    got = {r["column"]: r["quantiles"] for r in found.collect()}
    want = df.agg(F.percentile("x", F.array(*[F.lit(q) for q in lv]))).first()[0]
    assert set(got) == {"x", "y"}
    assert got["x"] == pytest.approx(want, abs=1e-12)
    assert got["y"] == pytest.approx([-w for w in reversed([np.quantile(data, 1 - q) for q in reversed(lv)])], abs=1e-12)


def test_one_user_with_half_of_all_rows(spark):
    """Pairs of a heavy user, dealt into blocks, equal all ordered pairs."""
    from collections import Counter
    from itertools import combinations

    from shelfspark.operators.insights import ordered_pairs
    rng = np.random.default_rng(3)
    rows = [("heavy", f"p{rng.integers(12)}", i, 1, 1, 1, float(i % 3)) for i in range(150)]
    rows += [(f"u{rng.integers(20)}", f"p{rng.integers(12)}", i, 1, 1, 1, 1.0) for i in range(150)] + [(None, "p1", 1, 1, 1, 1, 1.0)]
    rows += [("u1", "p1", 7, 7, 7, 7, 7.0)] * 3
    df = spark.createDataFrame(rows, "user_id string, product_name string, order_key int, line_number int, part_key int, "
                                     "supp_key int, actual_price double")
    want = Counter()
    for u in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == u), key=lambda r: r[2:])
        want.update((a[1], b[1]) for a, b in combinations(own, 2))
    got = {(r.item_a, r.item_b): r.n for r in ordered_pairs(df, block_rows=16).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_exact_quantiles_of_many_values(spark, adaptive):
    """More different values than a sketch of split points holds exactly; with and without adaptive execution."""
    from shelfspark.operators.quantiles import exact_quantiles

    n, lv = 150_000, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(10 ** 12)) / 997.0).alias("x"), (F.col("id") % 7).alias("y"))
    data = np.array([r.x for r in df.select("x").collect()])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {r["column"]: r["quantiles"] for r in exact_quantiles(df, ["x", "y"], lv).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    order = np.sort(data)
    for q, found in zip(lv, got["x"]):
        rank = q * (n - 1)
        lo, hi, w = order[int(rank)], order[int(np.ceil(rank))], rank - int(rank)
        assert found == (lo if lo == hi else (1.0 - w) * lo + w * hi)
    assert got["y"] == [0.0, 0.0, 1.0, 3.0, 5.0, 6.0, 6.0, 6.0]


def test_correlations_merge_over_partitions_and_large_means(spark):
    """Co-moments of many tasks and batches, far from zero and with gaps, equal those of all rows at once."""
    rng = np.random.default_rng(8)
    x = 1e9 + rng.normal(size=3000)
    y = 0.6 * (x - 1e9) + rng.normal(size=3000)
    z = np.where(rng.random(3000) < 0.4, np.nan, rng.normal(size=3000) - 0.3 * y)
    rows = [(float(a), float(b), None if np.isnan(c) else float(c)) for a, b, c in zip(x, y, z)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(7)
    cm = {(r["column_a"], r["column_b"]): r["r"] for r in P.correlation_matrix(df, ["x", "y", "z"], digits=6).collect()}
    has = ~np.isnan(z)
    assert cm[("x", "y")] == pytest.approx(np.corrcoef(x - 1e9, y)[0, 1], abs=2e-6)
    assert cm[("z", "x")] == cm[("x", "z")] == pytest.approx(np.corrcoef(x[has] - 1e9, z[has])[0, 1], abs=2e-6)
    assert cm[("x", "x")] == 1.0


def test_counter_rate_with_restarts_and_edges(spark):
    """Rates by hand: a restart, samples far from an edge, a counter that starts inside the window, one sample, nulls."""
    from datetime import datetime, timedelta, timezone

    from shelfspark.operators.counters import counter_rate

    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    series = {
        "restart": [(0, 100), (60, 130), (120, 10), (180, 40), (240, 70)],   # 30 + 10 + 30 + 30
        "late": [(200, 50), (220, 60), (240, 70)],                           # starts far from the edge, ends 60 s before it
        "young": [(30, 1), (90, 4), (150, 7), (210, 10), (270, 13)],         # zero would be 20 s before the first sample
        "alone": [(10, 5)], "still": [(0, 7), (150, 7), (290, 7)],
    }
    rows = [(k, t0 + timedelta(seconds=s), float(v)) for k, x in series.items() for s, v in x]
    rows += [("restart", None, 1.0), ("late", t0, None)]
    df = spark.createDataFrame(rows, "label string, ts timestamp, value double")
    got = {r["label"]: (r["increase"], r["resets"], r["rate"]) for r in counter_rate(df).collect()}
    assert set(got) == {"restart", "late", "young", "still"}
    assert got["restart"] == (100.0, 1, pytest.approx(100 * (240 + 0 + 60) / 240 / 300))
    assert got["late"] == (20.0, 0, pytest.approx(20 * (40 + 10 + 10) / 40 / 300))
    assert got["young"] == (12.0, 0, pytest.approx(12 * (240 + 20 + 30) / 240 / 300))
    assert got["still"] == (0.0, 0, 0.0)
    assert counter_rate(df.limit(0)).collect() == []
