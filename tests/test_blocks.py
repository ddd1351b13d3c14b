"""Leaf-wise boosting reads blocks of rows, and finds the leaves as by walking row by row."""

import numpy as np
from pyspark.sql import functions as F

from shelfspark.operators import boosting as B


def test_boosting_reads_blocks_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", float(a), float(b), float(a * 2 + (b > 0.3)) / 3, i % 7 == 0) for i, (a, b) in enumerate(rng.random((4000, 2)))]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double, held boolean").repartition(2)
    stored, plain = [], B._histograms

    def counted(data, *rest):
        stored.append(data.count())
        return plain(data, *rest)

    monkeypatch.setattr(B, "_histograms", counted)
    model = B.fit_boosted(df, ["a", "b"], "y", "k", "held", rounds=3, max_depth=3, refresh=2)
    assert max(stored) < 4000 / 50 and len(model.trees) == 3
    s = df.where("NOT held").agg(F.sum(F.col("y").cast("decimal(38,12)")), F.count("y")).first()
    assert model.base == float(s[0] / s[1])
    blocks = B._in_blocks(B._binned(df, ["a", "b"], model.edges, "y", "k", F.col("held")))
    got = blocks.agg(F.sum("n"), F.sum("m"), F.min("lo"), F.max("hi"), F.sum("s")).first()
    all_ = df.agg(F.min("y"), F.max("y")).first()
    assert tuple(got) == (s[1], 4000 - s[1], *all_, s[0])


def test_leaf_walk_by_table(spark):
    t = B.Tree()
    for _ in range(5):
        t.add()
    t.feature[0], t.bin[0], t.left[0], t.right[0] = 1, 3, 1, 2
    t.feature[2], t.bin[2], t.missing_left[2], t.left[2], t.right[2] = 0, 0, True, 3, 4
    bins = np.array([[9, 3], [0, 4], [1, 4], [B.MISSING, B.MISSING], [5, 0]], np.uint8)
    assert B.leaf_of(t, bins).tolist() == [1, 3, 4, 3, 1]
    assert B.leaf_of(t, bins[:0]).tolist() == []
