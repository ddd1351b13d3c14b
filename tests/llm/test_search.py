"""URL rules, exact and approximate vector search."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import hilbert_ann, pivot_search, url_rules
from shelfspark.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(found.fetchall(), key=repr)
    assert want and sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def plain_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"), ("a.com", "", "block"), ("b.a.com", "/x", "allow"), ("b.a.com", "/x/y", "block"),
    ("b.a.com", "/x", "block"), ("a-b.com", "/", "block"), ("", "/never", "block"), ("com", "/fr/", "allow"),
]
ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Example.ORG/es/", "http://example.org?x=/es/", "http://example.org#/es/",
    "http://notexample.org/es/1", "http://sub.example.org/en/17", "https://É.com/fr/x", "ftp://b.a.com/x/y/z", "http://c.b.a.com/x",
    "http://a-b.com/", "http://a.com:80/x", "http://a.com./x", "x://y/never/1", "http://a.com/://b.org/", "http://../x",
    "http://example.org/" + "long" * 5000,
]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_url_rules_equal_brute_force(spark, ranges):
    rnd = random.Random(ranges)
    urls = ODD_URLS + ["http://hot.example.org/es/same"] * 60 + [
        f"http://{'.'.join(rnd.choice(['a', 'b', 'a-b', 'example', 'www']) for _ in range(rnd.randint(0, 3)))}"
        f".{rnd.choice(['com', 'org', 'a.com'])}/{rnd.choice(['fr/', 'de/', 'x', 'x/y', 'es/', 'en/1', ''])}" for _ in range(150)]
    pages = spark.createDataFrame(
        [(i if i % 7 else None, u, "clash", "extra") for i, u in enumerate(urls)], "page_id long, url string, verdict string, other string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, rules, ranges=ranges, sample_rows=50).collect()
    want = [(i if i % 7 else None, u, *plain_verdict(u, RULES)) for i, u in enumerate(urls)]
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == sorted(want, key=repr)
    assert {r.other for r in got} == {"extra"}


def test_url_rules_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_rules.judge_urls(pages, none).collect()] == [(1, "http://a.com/", "a.com", "/", None, "allow")]
    assert url_rules.judge_urls(pages.limit(0), none).collect() == []


def vector_rows(n=300, width=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=width)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * width), (1003, [float("inf")] * width),
             (1004, [0.5, 0.25]), (None, [1.0] * width), (50, rows[3][1])]
    return [(i, v, "clash") for i, v in rows]


def usable(rows):
    return [(i, v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


@pytest.mark.parametrize("block_rows, query_rows", [(2048, 512), (37, 3)])
def test_exact_top_k_equals_brute_force(spark, block_rows, query_rows):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = pivot_search.exact_top_k(df, F.col("vec_id") % 50 == 0, k=5, pivots=4, block_rows=block_rows, query_rows=query_rows)
    ints = [(i, np.array([np.floor(256 * float(x)) for x in v] + [0] * (6 - len(v)), dtype=np.int64)) for i, v in usable(rows)]
    queries = {}
    for i, v in ints:
        if i % 50 == 0 and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    want = []
    for q, x in queries.items():
        best = sorted((-int(x @ v), i) for i, v in ints if i != q)[:5]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in pivot_search.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert pivot_search.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    big = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0])], "vec_id long, embedding array<double>")
    want = [(0, 1, 2, 256_000_000 ** 2 + 768 * 512), (0, 2, 1, 256_000_000 ** 2 + 768 * 256)]
    assert sorted(tuple(r) for r in pivot_search.exact_top_k(big, F.col("vec_id") == 0).collect()) == want


def test_hilbert_keys_visit_neighbours():
    side = np.stack(np.meshgrid(np.arange(8), np.arange(8), np.arange(8)), axis=-1).reshape(-1, 3)
    order = side[np.argsort(hilbert_ann.hilbert_keys(side, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    assert len(set(hilbert_ann.hilbert_keys(side, 3).tolist())) == 512


def test_hilbert_neighbours_of_odd_rows(spark):
    rows = [r for r in vector_rows() if r[0] != 50] + [(1005, [0.0] * 6, "clash")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, curve string")
    got = hilbert_ann.hilbert_neighbours(df, F.col("vec_id") % 20 == 0, k=20, least_window=5000).collect()
    vectors = [(i, np.array(list(v) + [0.0] * (6 - len(v)))) for i, v in usable(rows) if any(v)]
    for q, x in vectors:
        if q % 20 == 0:
            best = sorted((-float(x @ v), i) for i, v in vectors if i != q)[:20]
            own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [o[0] for o in own] == list(range(1, 21))
            assert np.allclose([o[2] for o in own], [-s for s, _ in best])
            assert {o[1] for o in own if o[2] > own[-1][2] + 1e-9} == {i for s, i in best if -s > own[-1][2] + 1e-9}
    assert hilbert_ann.hilbert_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    two = df.where("vec_id IN (0, 1)")
    assert [(r.query_id, r.rank, r.vec_id) for r in hilbert_ann.hilbert_neighbours(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1)]


def test_op6_recall(spark):
    """Windows of a share of the table reach at least 0.9 of the true neighbours on unclustered vectors."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hilbert_ann.hilbert_neighbours(df, F.col("vec_id") % 100 == 0, k=20, least_window=64, block_rows=512).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 6000, 100):
        scores = x @ x[q]
        scores[q] = -9
        recall.append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9
