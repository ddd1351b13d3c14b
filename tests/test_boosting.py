"""Leaf-wise boosting equals a booster that tries every cut of every leaf on the rows themselves."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfspark.operators import boosting as B
from shelfspark.operators import model as M
from shelfspark.plans.model_queries import model_frame

SMALL = dict(rounds=4, num_leaves=7, max_depth=4, min_child=5, max_bins=16, refresh=2)


def soft(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g) if g else 0.0


def brute_trees(bins, y, keys, held, base, scale, p, rounds):
    """Predictions of ``rounds`` trees, one cut at a time: the open leaf with the best cut is split next."""
    pred = np.full(len(y), base)
    for number in range(rounds):
        seen = ~held & B.drawn_rows(keys, p.seed, number, p.subsample)
        g = np.rint((y - pred) * scale.unit).astype(np.int64)
        drawn = B.drawn_features(bins.shape[1], p.seed, number, p.colsample)

        def score(rows):
            return soft(int(g[rows].sum()) / scale.unit, p.l1) ** 2 / max(int(rows.sum()) + p.l2, 1e-300)

        def best(rows):
            found = None
            for f in drawn:
                b = bins[:, f]
                for cut in range(B.MISSING):
                    for missing_left in (False, True):
                        left = rows & np.where(b == B.MISSING, missing_left, b <= cut)
                        right = rows & ~left
                        if left.sum() < p.min_child or right.sum() < p.min_child:
                            continue
                        gain = score(left) + score(right) - score(rows)
                        if gain > 1e-12 and (found is None or gain > found[0]):
                            found = (gain, f, cut, missing_left)
            return found

        everyone = np.ones(len(y), bool)
        leaves = [((), everyone, best(seen))]
        while len(leaves) < p.num_leaves:
            open_ = [(-cut[0], path, i) for i, (path, _, cut) in enumerate(leaves) if cut and len(path) < p.max_depth]
            if not open_:
                break
            i = min(open_)[2]
            path, rows, (_, f, cut, missing_left) = leaves.pop(i)
            b = bins[:, f]
            goes = np.where(b == B.MISSING, missing_left, b <= cut)
            for side, part in ((0, rows & goes), (1, rows & ~goes)):
                deep = len(path) + 1 >= p.max_depth
                leaves.append(((*path, side), part, None if deep else best(part & seen)))
        if len(leaves) == 1:
            break
        for _, rows, _ in leaves:
            s = int(g[rows & seen].sum()) / scale.unit
            pred[rows] += p.learning_rate * soft(s, p.l1) / (int((rows & seen).sum()) + p.l2)
    return pred


def compared(spark, df, features, label, key, held=None, **params):
    model = B.fit_boosted(df, features, label, key, held, **params)
    got = df.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("_y"),
                    F.xxhash64(F.col(key).cast("string")).alias("_k"),
                    (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("_h"),
                    B.boosted_prediction(model).alias("_p")).where("_y is not null").toPandas()
    bins = B.bins_of(got[features].to_numpy(dtype=float, na_value=np.nan), model.edges)
    y, h = got["_y"].to_numpy(float), got["_h"].to_numpy(bool)
    scale = B._Scale.of(max((~h).sum(), h.sum()), y.max() - y.min())
    want = brute_trees(bins, y, got["_k"].to_numpy(), h, model.base, scale, model.params, len(model.trees))
    assert np.abs(want - got["_p"].to_numpy()).max() < 1e-9
    return model, got


def noisy(spark, rows=900, seed=5, partitions=4):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"a": rng.normal(size=rows).round(2), "b": rng.integers(0, 5, rows).astype(float),
                      "c": rng.random(rows)})
    x["y"] = np.where(x["a"] > 0, 5 * x["b"], -x["c"]) + rng.normal(size=rows) * 0.1
    x.loc[rng.random(rows) < 0.2, "c"] = np.nan
    x["id"] = [f"r{i}" for i in range(rows)]
    x["held"] = rng.random(rows) < 0.2
    return spark.createDataFrame(x).repartition(partitions)


def test_equals_brute_force_on_made_rows_with_missing_values(spark):
    model, _ = compared(spark, noisy(spark), ["a", "b", "c"], "y", "id", **SMALL)
    assert len(model.trees) == 4 and all(2 <= t.leaves <= 7 for t in model.trees)


def test_equals_brute_force_on_the_catalog(spark, sf_small):
    df = M.train_test_split(model_frame(spark, sf_small))
    prep = M.fit_features(df.where("split = 'train'"))
    rows = M.transform_features(df, prep).withColumn("held", F.col("split") != "train")
    compared(spark, rows, prep.feature_names, M.TARGET, "row_id", "held", **{**SMALL, "rounds": 3, "patience": 3})


def test_partitioning_changes_nothing(spark):
    one = B.fit_boosted(noisy(spark, partitions=1), ["a", "b", "c"], "y", "id", "held", **SMALL)
    many = B.fit_boosted(noisy(spark, partitions=13), ["a", "b", "c"], "y", "id", "held", **SMALL)
    assert one.to_json() == many.to_json()


def test_early_stop_keeps_the_best_trees_and_errors_are_true(spark):
    df = noisy(spark, 600)
    model = B.fit_boosted(df, ["a", "b", "c"], "y", "id", "held", rounds=40, patience=2, learning_rate=0.9, min_child=5)
    n = len(model.trees)
    assert 0 < n < 40 and model.errors[n - 1] == min(model.errors) and len(model.errors) <= n + 2
    e = F.col("y") - B.boosted_prediction(model)
    assert abs(df.where("held").select(F.avg(e * e)).first()[0] - model.errors[n - 1]) < 1e-6


def test_depth_and_leaves_bound_the_trees_and_the_model_is_saved(spark, tmp_path):
    model = B.fit_boosted(noisy(spark), ["a", "b", "c"], "y", "id", rounds=2, num_leaves=31, max_depth=2, min_child=1)
    assert all(t.leaves <= 4 for t in model.trees)
    again = B.BoostedModel.load(spark, model.save(spark, f"{tmp_path}/m"))
    assert again.to_json() == model.to_json()
    splits = model.importance()
    assert sum(n for n, _ in splits.values()) == sum(t.leaves - 1 for t in model.trees)


def test_odd_tables(spark):
    schema = "a double, y double, id string"
    assert B.fit_boosted(spark.createDataFrame([], schema), ["a"], "y", "id").base == 0.0
    same = spark.createDataFrame([(None, 3.0, None)] * 50 + [(float("nan"), None, "x")], schema)
    model = B.fit_boosted(same, ["a"], "y", "id", min_child=1)
    assert model.base == 3.0 and model.trees == []
    assert same.select(B.boosted_prediction(model).alias("p")).distinct().collect() == [(3.0,)]


def test_fit_deals_rows_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", float(a), float(b), float(a * 2 + (b > 0.3)), i % 7 == 0) for i, (a, b) in enumerate(rng.random((3000, 2)))]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double, held boolean")
    files, plain = [], B._histograms

    def counted(data, *rest):
        files.append(data.select(F.input_file_name()).distinct().count())
        return plain(data, *rest)

    monkeypatch.setattr(B, "_histograms", counted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions stay apart
    try:
        one = B.fit_boosted(df.coalesce(1), ["a", "b"], "y", "k", "held", rounds=3, max_depth=3)
        four = B.fit_boosted(df.repartition(4), ["a", "b"], "y", "k", "held", rounds=3, max_depth=3)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert min(files) > 1 and one.to_json() == four.to_json()
