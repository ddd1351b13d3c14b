"""What the larger tables asked for: sources computed once, and no rows exchanged that can be added up before."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as E
from shelfspark.operators import insights as I
from shelfspark.operators import lexicon as L
from shelfspark.operators import profile as P
from shelfspark.operators.summary import full_summary
from shelfspark.plans.frames import enriched
from shelfspark.sinks import index as X

BY_TEXT_AND_TERM = r"keys=\[\w+#\d+L?, term#"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("summary", [P.price_stats, full_summary])
def test_catalog_is_computed_once(spark, sf_small, summary):
    assert not [f for f in summary(enriched(spark, sf_small)).inputFiles() if f.endswith("lineitem.parquet")]


def test_terms_combine_before_the_exchange(spark, sf_small):
    for name in ("negative_terms", "positive_terms"):
        assert not re.search(BY_TEXT_AND_TERM, plan(E.queries()[name](spark, sf_small)))


def test_scores_exchange_a_row_per_text(spark):
    texts = spark.createDataFrame([(1, "not good, it was bad bad"), (2, ""), (3, "good good never ever so bad"), (4, None)], "k long, t string")
    lexicon = spark.createDataFrame([("good", 500000), ("bad", -250000)], "term string, weight long")
    scores = L.learned_scores(texts, lexicon, "k", "t")
    assert not re.search(BY_TEXT_AND_TERM, plan(scores))
    got = {r.k: (round(r.polarity, 9), round(r.subjectivity, 9), r.hits) for r in scores.collect()}
    # 1: not good -0.5; bad is four words after not; 3: bad is three words after never
    assert got == {1: (round((-0.5 - 0.25 - 0.25) / 3, 9), round(1 / 3, 9), 3), 2: (0.0, 0.5, 0),
                   3: (round((0.5 + 0.5 + 0.25) / 3, 9), round(1.25 / 3, 9), 3), 4: (0.0, 0.5, 0)}


def test_scope_reads_the_words_before(spark):
    text = spark.createDataFrame([("a no b c d e not not f",)], "t string")
    got = [(r.term, r.negated) for r in L.scoped_tokens(text, "t").collect()]
    assert got == [("a", False), ("b", True), ("c", True), ("d", True), ("e", False), ("f", True)]


def test_pairs_of_hot_items_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(6)}", f"p{rng.randrange(5)}", rng.randrange(30)) for _ in range(400)] + [("u1", None, 3), (None, "p1", 1)]
    rows += [("u2", "p2", 7)] * 3
    df = spark.createDataFrame(rows, "u string, i string, o int")
    want = Counter()
    for u in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == u), key=lambda r: r[2])
        for x, y in combinations(own, 2):
            if x[2] < y[2] or x == y:
                want[x[1], y[1]] += 1
    for parts in (1 << 17, 10):
        pairs = I.ordered_pairs(df, "u", "i", ["o"], block_rows=16, item_rows=parts)
        assert not re.search(r"hashpartitioning\(item_a#\d+, item_b#", plan(pairs))
        assert {(r.item_a, r.item_b): r.n for r in pairs.collect()} == dict(want)


def test_an_upsert_moves_its_rows_once(spark, tmp_path, monkeypatch):
    seen, write = [], X._write

    def noted(spark, root, rows, *rest, **more):
        seen.append((rows, more))
        return write(spark, root, rows, *rest, **more)

    monkeypatch.setattr(X, "_write", noted)
    points = spark.createDataFrame([(f"{i % 50}", float(i), i) for i in range(120)], "id string, x double, w int")
    X.upsert_index(spark, str(tmp_path / "index"), points, "w", partition_col="x")
    (rows, more), = seen
    assert more == {"placed": True} and len(re.findall(r"Exchange hashpartitioning", plan(rows))) == 1
    got = {r.id: r.x for r in X.read_index(spark, str(tmp_path / "index")).collect()}
    assert got == {f"{i % 50}": float(i) for i in range(120)}


def test_quantiles_shuffle_only_the_ranges_that_hold_a_rank(spark):
    from shelfspark.operators.quantiles import exact_quantiles

    data = np.random.default_rng(2).normal(0, 1, 5000)
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    found = exact_quantiles(df, ["x"], [0.5])
    assert "value_counts" not in "".join(found.inputFiles())
    assert found.first()["quantiles"] == pytest.approx([float(np.median(data))], abs=1e-12)
