"""Model: additivity of contributions, saved-model round trip, clipped predictions."""

from pyspark.sql import functions as F

from shelfspark.operators import model as M
from shelfspark.operators.explain import shap_local
from shelfspark.plans.model_queries import get_model, model_frame


def test_shap_additivity_and_tree_walk(spark, sf_small):
    model, prep, _, path = get_model(spark, sf_small)
    feats = M.transform_features(model_frame(spark, sf_small).dropDuplicates(["row_id"]), prep)
    loc = shap_local(feats, model, f"{path}/model", prep.feature_names)
    total = F.aggregate(F.transform("contributions", lambda c: c["shap_value"]), F.lit(0.0), lambda a, b: a + b)
    err = loc.select(F.max(F.abs(F.col("base_value") + total - F.col("raw_prediction")))).first()[0]
    assert err < 1e-9
    spark_pred = model.setPredictionCol("p").transform(feats).select("row_id", "p")
    diff = (loc.join(spark_pred, "row_id")
               .select(F.max(F.abs(F.col("p") - F.col("raw_prediction")))).first()[0])
    assert diff < 1e-9


def test_store_round_trip_and_clip(spark, sf_small):
    model, prep, metrics, path = get_model(spark, sf_small)
    store = M.ModelStore(spark, path.rsplit("/", 1)[0])
    m2, p2, met2, path2 = store.load(path)
    df = model_frame(spark, sf_small).dropDuplicates(["row_id"])
    a = M.predict_batch(model, prep, df).select("row_id", "predicted_discount")
    b = M.predict_batch(m2, p2, df).select("row_id", F.col("predicted_discount").alias("b"))
    assert a.join(b, "row_id").where(F.col("predicted_discount") != F.col("b")).count() == 0
    rng = a.agg(F.min("predicted_discount"), F.max("predicted_discount")).first()
    assert 0.0 <= rng[0] <= rng[1] <= 100.0
    assert set(metrics) >= {"rmse", "mae", "r2", "mape"} and met2["rmse"] == metrics["rmse"]


def test_split_is_deterministic(spark, sf_small):
    df = model_frame(spark, sf_small)
    a = M.train_test_split(df).select("row_id", "split")
    b = M.train_test_split(df.repartition(7)).select("row_id", F.col("split").alias("s2"))
    assert a.join(b, "row_id").where(F.col("split") != F.col("s2")).count() == 0


def test_training_reads_the_catalog_once(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(str(i), f"c{i % 3}", "s", "budget", float(i % 17), 1.0 + i % 4, i % 50, 0.5, 1.0, 9.0, 30.0, 0.1, float(i % 60))
         for i in range(600)],
        "row_id string, main_category string, sub_category string, price_tier string, actual_price double, rating double, "
        "rating_count long, rating_count_log double, category_depth double, name_length double, description_length double, "
        "review_sentiment double, discount_percentage double")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    monkeypatch.setattr(M, "TRAIN_ROWS", 200)
    model, _, metrics = M.fit_and_evaluate(rows.mapInArrow(counted, rows.schema), maxIter=2)
    assert reads.value == 600 and model.getNumTrees >= 1 and metrics["n"] > 0


def test_contributions_sort_without_a_comparator(spark):
    from shelfspark.operators.explain import sort_contributions
    rows = [("b", -0.5), ("a", 0.5), ("z", 2.0), ("c", 0.0), ("d", -3.0)]
    df = spark.createDataFrame([(rows,)], "c array<struct<feature_name:string,shap_value:double>>")
    out = df.select(sort_contributions(F.col("c")).alias("s"))
    assert [(x["feature_name"], x["shap_value"]) for x in out.first()["s"]] == [
        ("d", -3.0), ("z", 2.0), ("a", 0.5), ("b", -0.5), ("c", 0.0)]
    assert "ELSE 0" not in out._jdf.queryExecution().optimizedPlan().toString()
