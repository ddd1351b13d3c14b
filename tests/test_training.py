"""What training on large tables asked for: nothing is fitted, stored or shuffled twice, and the trees stay the same."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shelfspark.operators import model as M
from shelfspark.operators import quantiles as Q


def test_trees_are_kept_not_grown_again(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float((a > 0.5) * 3 + rng.normal()), i % 5 == 0) for i, (a, b) in enumerate(rng.random((800, 2)))]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "a double, b double, y double, held boolean").coalesce(1)).cache()
    fits, plain = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, *a: fits.append(self.getMaxIter()) or plain(self, data, *a))
    model = M.train_regressor(df, label="y", validation_col="held", patience=3, maxIter=12)
    n = model.getNumTrees
    assert len(fits) == len(set(fits)) and 0 < n < fits[-1] and model.getMaxIter() == n  # no second fit of n rounds
    again = plain(GBTRegressor(featuresCol="features", labelCol="y", **{**M.GBT_PARAMS, "maxIter": n}), df.where("NOT held"))
    body = lambda m: m.toDebugString.split("\n", 1)[1]
    assert body(model) == body(again) and model.treeWeights == again.treeWeights
    assert np.allclose(model.featureImportances.toArray(), again.featureImportances.toArray(), atol=1e-12)
    model.save(f"{tmp_path}/m")
    assert body(type(model).load(f"{tmp_path}/m")) == body(model)


def test_codes_are_joined_without_a_shuffle(spark):
    rows = spark.range(3_000_000).select(F.concat(F.lit("c"), F.col("id") % 3).alias("main_category"), F.col("id").cast("double").alias("x"),
                                         F.col("id").cast("string").alias("name"))
    prep = M.fit_features(rows, ["main_category"], [])
    coded = M.label_encode(rows, "main_category", prep.codes["main_category"])
    assert "BroadcastHashJoin" in coded._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2, 0.5, 1 - 2.0 ** -40, 1.0])
def test_split_by_text_is_split_by_number(spark, share):
    keys = spark.range(2000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("k"))
    both = keys.select(M.hash_below(F.col("k"), 42, share).alias("a"), (M.hash_fraction(F.col("k"), 42) < share).alias("b"))
    assert both.where("NOT a <=> b").count() == 0


def test_range_totals_count_all_columns_in_one_pass(spark):
    rows = [(float(i % 7), None if i % 5 == 0 else i / 10) for i in range(200)] + [(float("nan"), -0.0)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    splits = [[1.0, 3.0, 5.5], [0.0, 4.2]]
    want = {(i, part): m for i, c in enumerate("ab") for part, m in
            df.where(F.col(c).isNotNull()).groupBy(Q._range_of(F.col(c), splits[i])).count().collect()}
    found = Q._range_totals(df, splits)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r["i"], r["part"]): r["m"] for r in found.collect()} == want


def test_split_rows_are_not_stored_again_for_their_quantiles(spark, monkeypatch):
    df = spark.createDataFrame([("a", float(i), float(i % 5)) for i in range(40)], "main_category string, x double, z double")
    stored = []
    monkeypatch.setattr(Q, "materialized", lambda d, name: stored.append(name) or d)
    prep = M.fit_features(df, ["main_category"], ["x", "z"], written=True)
    assert stored == [] and prep.medians == {"x": 19.5, "z": 2.0}


def test_contributions_are_sorted_in_their_batch(spark):
    from shelfspark.operators import explain as X
    names = ["b", "a", "z", "Ä", "c"]
    rng = np.random.default_rng(2)
    phi = np.round(rng.normal(size=(300, 5)), 1)
    phi[5], phi[6, 2], phi[7] = 0.0, np.nan, [-0.0, 0.0, 1.0, -1.0, np.nan]
    df = spark.createDataFrame([(i, [(n, float(v)) for n, v in zip(names, row)]) for i, row in enumerate(phi)],
                               "i int, c array<struct<feature_name:string,shap_value:double>>")
    want = {r["i"]: [x["feature_name"] for x in r["s"]] for r in df.select("i", X.sort_contributions(F.col("c")).alias("s")).collect()}
    got = X.sort_contributions(phi, names)
    assert {i: [names[j] for j in row] for i, row in enumerate(got.tolist())} == want


def test_local_contributions_need_no_sort_per_row(spark, sf_small):
    import __spark_entry__ as E
    plan = E.queries()["sort_contributions"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and "array_sort" not in plan
