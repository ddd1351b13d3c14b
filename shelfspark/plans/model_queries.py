"""Registered model queries: features, split, training, scoring, metrics,
explanations and model drift.  The model is trained once per data folder and
saved with :class:`ModelStore`; later queries load it."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shelfspark.constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from shelfspark.functions.numeric import round_half_up
from shelfspark.operators import model as M
from shelfspark.operators import quality as Q
from shelfspark.operators.boosting import BoostedModel, boosted_prediction, fit_boosted
from shelfspark.operators.drift import cv_drift_score, prediction_drift
from shelfspark.operators.enrich import enrich_catalog, fill_missing
from shelfspark.operators.text import sentiment_scores
from shelfspark.plans.registry import query
from shelfspark.plans.sql import R2, with_ctes
from shelfspark.plans.text_queries import _SENT_CTES
from shelfspark.session import content_key, materialized, path_exists, shared_dir
from shelfspark.sources.catalog import catalog_view, product_texts
from shelfspark.sources.tables import read_table


def model_frame(spark, sf_dir, lineitem=None):
    """Every catalog row with every model feature; ``row_id`` names the row.

    Sentiment is scored once per text and joined to the parts, before the order lines.
    """
    scores = sentiment_scores(product_texts(spark, sf_dir), "part_key", "review_content")
    per_part = scores.select("part_key", F.col("polarity").alias("review_sentiment"))
    cat = enrich_catalog(catalog_view(spark, sf_dir, texts=True, part_features=per_part, lineitem=lineitem))
    return cat.withColumns({
        "review_sentiment": F.coalesce("review_sentiment", F.lit(0.0)),
        "row_id": F.concat_ws("-", "order_key", "line_number", "part_key", "supp_key")})


def get_model(spark, sf_dir):
    """(model, prep, metrics, path) from the shared store, trained if it has none for these rows and this code."""
    inputs = [read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                           "l_extendedprice", "l_discount"),
              read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"),
              read_table(spark, sf_dir, "documents").select("doc_id", "text")]
    store = M.ModelStore(spark, M.default_store_root(spark, content_key(*inputs)))
    if store.latest() is None:
        store.save(*M.fit_and_evaluate(model_frame(spark, sf_dir)))
    return store.load()


_MF_CTE = _SENT_CTES.strip() + """,
mf AS (SELECT e.*, concat_ws('-', order_key, line_number, part_key, supp_key) AS row_id,
              coalesce(s.polarity, 0e0) AS review_sentiment
       FROM enriched e LEFT JOIN sent s ON s.doc_id = e.part_key),
sp AS (SELECT *, CASE WHEN cast('0x' || substr(md5(row_id || '#42'), 1, 8) AS bigint) / 4294967296e0 < 0.2e0 THEN 'test'
                      WHEN cast('0x' || substr(md5(row_id || '#43'), 1, 8) AS bigint) / 4294967296e0 < 0.1e0
                      THEN 'validation' ELSE 'train' END AS split FROM mf)"""


def _model_sql(body: str, extra: str = "") -> str:
    return with_ctes(_MF_CTE + ("," + extra if extra else ""), body)


@query("label_encode", oracle=_model_sql(
    "SELECT label, cast(row_number() OVER (ORDER BY label) - 1 AS integer) AS code FROM "
    "(SELECT DISTINCT coalesce(main_category, 'Unknown') AS label FROM mf)"))
def q_label_encode(spark, sf_dir):
    return M.label_codes(model_frame(spark, sf_dir), "main_category")


@query("label_code_join", oracle=_model_sql(
    "SELECT row_id, coalesce(c.code, 0) AS main_category_code FROM mf l LEFT JOIN codes c "
    "ON coalesce(l.main_category, 'Unknown') = c.label",
    "codes AS (SELECT label, cast(row_number() OVER (ORDER BY label) - 1 AS integer) AS code FROM "
    "(SELECT DISTINCT coalesce(sub_category, 'Unknown') AS label FROM mf))"))
def q_label_code_join(spark, sf_dir):
    """Main categories encoded with the *sub*-category code table: unseen labels → 0."""
    df = model_frame(spark, sf_dir)
    codes = M.label_codes(df, "sub_category")
    return M.label_encode(df, "main_category", codes, "main_category_code").select("row_id", "main_category_code")


@query("median_impute", oracle=_model_sql(
    f"SELECT row_id, {R2('coalesce(rating, (SELECT quantile_cont(rating, 0.5) FROM mf))', 6)} AS rating FROM mf"))
def q_median_impute(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return M.median_impute(df, ["rating"], mode="batch").select("row_id", round_half_up("rating", 6).alias("rating"))


@query("standard_scale", oracle=_model_sql(
    f"SELECT row_id, {R2('(actual_price - m) / CASE WHEN s = 0 THEN 1e0 ELSE s END', 6)} AS actual_price "
    "FROM mf, (SELECT avg(actual_price) AS m, stddev_pop(actual_price) AS s FROM mf)"))
def q_standard_scale(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    st = df.agg(F.avg("actual_price").alias("m"), F.stddev_pop("actual_price").alias("s")).first()
    out = M.standard_scale(df, {"actual_price": st["m"]}, {"actual_price": st["s"]})
    return out.select("row_id", round_half_up("actual_price", 6).alias("actual_price"))


@query("train_test_split", oracle=_model_sql("SELECT row_id, split FROM sp"))
def q_train_test_split(spark, sf_dir):
    return M.train_test_split(model_frame(spark, sf_dir)).select("row_id", "split")


def _features_sql() -> str:
    codes = ", ".join(
        f"c_{c} AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT "
        f"coalesce({c}, 'Unknown') AS label FROM sp WHERE split = 'train'))" for c in CATEGORICAL_FEATURES)
    medians = "med AS (SELECT " + ", ".join(
        f"coalesce(quantile_cont(cast({c} AS double), 0.5), 0e0) AS {c}" for c in NUMERIC_FEATURES) + " FROM sp WHERE split = 'train')"
    filled = lambda c: f"coalesce(cast(sp.{c} AS double), med.{c})"
    moments = "st AS (SELECT " + ", ".join(
        f"avg({filled(c)}) AS m_{c}, stddev_pop({filled(c)}) AS s_{c}" for c in NUMERIC_FEATURES) + \
        " FROM sp, med WHERE split = 'train')"
    columns = [f"cast(coalesce(c_{c}.code, 0) AS double) AS {c}_encoded" for c in CATEGORICAL_FEATURES]
    columns += [R2(f"({filled(c)} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1e0 ELSE s_{c} END", 6) + f" AS {c}"
                for c in NUMERIC_FEATURES]
    joins = " ".join(f"LEFT JOIN c_{c} ON coalesce(sp.{c}, 'Unknown') = c_{c}.label" for c in CATEGORICAL_FEATURES)
    return _model_sql(f"SELECT row_id, {', '.join(columns)} FROM sp CROSS JOIN med CROSS JOIN st {joins}",
                      f"{codes}, {medians}, {moments}")


@query("assemble_features", oracle=_features_sql())
def q_assemble_features(spark, sf_dir):
    """Every row's feature vector, by the state fitted on the training rows."""
    df = model_frame(spark, sf_dir)
    prep = M.fit_features(M.train_test_split(df).where("split = 'train'"))
    x = vector_to_array("features")
    n = len(prep.categorical)
    return M.transform_features(df, prep).select("row_id", *[
        (F.get(x, F.lit(i)) if i < n else round_half_up(F.get(x, F.lit(i)), 6)).alias(name)
        for i, name in enumerate(prep.feature_names)])


def _scored(spark, sf_dir):
    model, prep, _, _ = get_model(spark, sf_dir)
    return M.predict_batch(model, prep, M.train_test_split(model_frame(spark, sf_dir)))


@query("train_regressor")
def q_train_regressor(spark, sf_dir):
    """The trained model's error and size on each split."""
    model, _, _, _ = get_model(spark, sf_dir)
    e = F.col("discount_percentage") - F.col("prediction")
    return _scored(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.lit(int(model.getNumTrees)).alias("n_trees"))


def get_boosted(spark, sf_dir):
    """The leaf-wise model and its prepared rows; fitted if the shared folder has none for these rows and this code."""
    df = M.train_test_split(model_frame(spark, sf_dir)).select(
        "row_id", "split", M.TARGET, *CATEGORICAL_FEATURES, *NUMERIC_FEATURES)
    df = materialized(df.repartition("row_id"), "split_rows")  # read by every step of the fit, the texts are not
    prep = M.fit_features(df.where("split = 'train'"), written=True)
    rows = M.transform_features(df, prep)
    used = rows.select("row_id", "split", M.TARGET, *prep.feature_names)
    path = shared_dir(spark, "boosted", content_key(used))
    if not path_exists(spark, f"{path}/_SUCCESS"):
        own = used.where("split <> 'test'").withColumn("held", F.col("split") == "validation")
        fit_boosted(own, prep.feature_names, M.TARGET, "row_id", "held").save(spark, path)
    return BoostedModel.load(spark, path), used


@query("train_leafwise")
def q_train_leafwise(spark, sf_dir):
    """Leaf-wise boosted trees with L1/L2, row and feature sampling: error and size on each split."""
    model, rows = get_boosted(spark, sf_dir)
    e = F.col(M.TARGET) - boosted_prediction(model)
    return rows.select("split", e.alias("e")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.lit(len(model.trees)).alias("n_trees"), F.lit(sum(t.leaves for t in model.trees)).alias("n_leaves"))


@query("predict_leafwise")
def q_predict_leafwise(spark, sf_dir):
    model, rows = get_boosted(spark, sf_dir)
    clipped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), boosted_prediction(model)))
    return rows.select("row_id", round_half_up(clipped, 2).alias("predicted_discount"))


@query("leafwise_importance")
def q_leafwise_importance(spark, sf_dir):
    """Splits and summed gain per feature."""
    model, _ = get_boosted(spark, sf_dir)
    return spark.createDataFrame([(f, n, g) for f, (n, g) in model.importance().items()],
                                 "feature string, splits long, gain double")


@query("sink_model", oracle=_model_sql("SELECT split, count(*) AS n, 0e0 AS largest_difference FROM sp GROUP BY split"))
def q_sink_model(spark, sf_dir):
    """The model saved as a new version and loaded again: rows scored by both and the largest difference."""
    model, prep, metrics, path = get_model(spark, sf_dir)
    store = M.ModelStore(spark, M.default_store_root(spark, f"copy-{uuid.uuid4().hex[:12]}"))
    again, prep2, _, _ = store.load(store.save(model, prep, metrics))
    df = M.train_test_split(model_frame(spark, sf_dir))
    one = M.predict_batch(model, prep, df).select("*", F.col("raw_prediction").alias("first_prediction")).drop(
        "features", "raw_prediction", "prediction", "predicted_discount", "confidence",
        *[f"{c}_encoded" for c in prep.categorical])
    two = M.predict_batch(again, prep2, df).select("row_id", "split", "raw_prediction")
    first = one.groupBy("row_id", "split").agg(F.sum("first_prediction").alias("a"), F.count(F.lit(1)).alias("n"))
    second = two.groupBy("row_id", "split").agg(F.sum("raw_prediction").alias("b"))
    return first.join(second, ["row_id", "split"], "full").groupBy("split").agg(
        F.sum("n").alias("n"), round_half_up(F.max(F.abs(F.col("a") - F.col("b"))), 9).alias("largest_difference"))


@query("predict_batch")
def q_predict_batch(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_id", "predicted_discount", "confidence")


# A predictor that SQL can repeat: the mean discount of the main category over the training rows.
_MEAN_CTE = """,
bm AS (SELECT main_category, avg(discount_percentage) AS prediction FROM sp WHERE split = 'train' GROUP BY 1),
bs AS (SELECT sp.*, coalesce(bm.prediction, (SELECT avg(discount_percentage) FROM sp WHERE split = 'train')) AS prediction
       FROM sp LEFT JOIN bm ON sp.main_category = bm.main_category)"""


def category_mean_baseline(split_frame):
    """The split frame with the category-mean prediction of its training rows."""
    train = split_frame.where("split = 'train'")
    means = train.groupBy("main_category").agg(F.avg("discount_percentage").alias("prediction"))
    overall = train.select(F.avg("discount_percentage")).scalar()
    return split_frame.join(means, "main_category", "left").withColumn("prediction", F.coalesce("prediction", overall))


_METRICS_SQL = (f"SELECT {R2('sqrt(avg(e * e))', 6)} AS rmse, {R2('avg(abs(e))', 6)} AS mae, "
                f"{R2('1e0 - avg(e * e) / var_pop(discount_percentage)', 6)} AS r2, "
                f"{R2('avg(abs(e / (discount_percentage + 1e-8))) * 100e0 / 1e8', 6)} AS mape_e8, count(*) AS n "
                "FROM (SELECT *, discount_percentage - prediction AS e FROM bs WHERE split = 'test')")


@query("evaluate_regression", oracle=_model_sql(_METRICS_SQL, _MEAN_CTE.strip().lstrip(",")))
def q_evaluate_regression(spark, sf_dir):
    """Metrics of the category-mean baseline on the test rows (mape in units of 1e8: zero labels divide by 1e-8)."""
    scored = category_mean_baseline(M.train_test_split(model_frame(spark, sf_dir)))
    m = M.evaluate_regression(scored.where("split = 'test'"))
    return m.select(*[round_half_up(c, 6).alias(c) for c in ("rmse", "mae", "r2")],
                    round_half_up(F.col("mape") / F.lit(1e8), 6).alias("mape_e8"), "n")


@query("evaluate_model")
def q_evaluate_model(spark, sf_dir):
    """Metrics of the trained model on the test rows only."""
    return M.evaluate_regression(_scored(spark, sf_dir).where("split = 'test'"))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    model, prep, _, _ = get_model(spark, sf_dir)
    return M.feature_importance(spark, model, prep.feature_names)


@query("top_features")
def q_top_features(spark, sf_dir):
    model, prep, _, _ = get_model(spark, sf_dir)
    return M.top_features(M.feature_importance(spark, model, prep.feature_names))


@query("model_status")
def q_model_status(spark, sf_dir):
    """The stored model and its error on the test rows as they are now."""
    model, _, _, _ = get_model(spark, sf_dir)
    return M.evaluate_regression(_scored(spark, sf_dir).where("split = 'test'")).select(
        F.lit(True).alias("loaded"), "rmse", "mae", "r2", "mape", F.lit(int(model.getNumTrees)).alias("n_trees"))


# Drift of predictions: order lines shipped before the cut are the reference, the later ones current; the
# predictor is the reference's mean discount per line number and returned flag.
_DRIFT_CTE = """WITH li AS (SELECT round(l_discount * 700e0, 0) AS label, l_linenumber, l_returnflag, l_quantity,
         l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AS ref FROM lineitem),
pm AS (SELECT l_linenumber, l_returnflag, avg(label) AS prediction FROM li WHERE ref GROUP BY 1, 2),
ds AS (SELECT li.*, coalesce(pm.prediction, (SELECT avg(label) FROM li WHERE ref)) AS prediction FROM li
       LEFT JOIN pm ON li.l_linenumber = pm.l_linenumber AND li.l_returnflag = pm.l_returnflag),
base AS (SELECT avg(abs(prediction - label)) AS mae FROM ds WHERE ref),
"""


def dated_predictions(spark, sf_dir):
    """(reference, current) order lines with label and prediction."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.round(F.col("l_discount") * F.lit(700.0), 0).alias("label"), "l_linenumber", "l_returnflag", "l_quantity",
        (F.col("l_shipdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).alias("ref"))
    means = li.where("ref").groupBy("l_linenumber", "l_returnflag").agg(F.avg("label").alias("prediction"))
    overall = li.where("ref").select(F.avg("label")).scalar()
    scored = li.join(means, ["l_linenumber", "l_returnflag"], "left").withColumn("prediction", F.coalesce("prediction", overall))
    return scored.where("ref"), scored.where("NOT ref")


def _drift_sql(label: str) -> str:
    rise = "(m - mae) / (mae + 1e-8)"
    return (_DRIFT_CTE + f"cur AS (SELECT avg(abs(prediction - ({label}))) AS m, avg((prediction - ({label})) ** 2) AS q "
            f"FROM ds WHERE NOT ref) SELECT {R2('m', 6)} AS current_mae, {R2('q', 6)} AS current_mse, "
            f"{R2('mae', 6)} AS training_mae, {R2(f'{rise} * 100e0', 6)} AS mae_increase_pct, {rise} > 0.5e0 AS drift_detected "
            "FROM cur, base")


def _prediction_drift(spark, sf_dir, label):
    ref, cur = dated_predictions(spark, sf_dir)
    mae = ref.agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    out = prediction_drift(cur.withColumn("label", label), mae)
    return out.select(*[round_half_up(c, 6).alias(c) for c in out.columns[:-1]], "drift_detected")


@query("prediction_drift", oracle=_drift_sql("label"))
def q_prediction_drift(spark, sf_dir):
    """Error on later order lines against the error on the lines the predictor was fitted on."""
    return _prediction_drift(spark, sf_dir, F.col("label"))


@query("prediction_drift_shifted", oracle=_drift_sql("label * 3e0"))
def q_prediction_drift_shifted(spark, sf_dir):
    """The same with labels that have tripled: a sure drift."""
    return _prediction_drift(spark, sf_dir, F.col("label") * 3)


_CV_SQL = ("cv AS (SELECT stddev_pop(prediction) / (avg(prediction) + 1e-8) AS cv, count(*) AS n FROM ds WHERE NOT ref), "
           "sc AS (SELECT cv, n, least(abs(cv - 0.3e0), 1e0) AS drift_score FROM cv) ")


@query("cv_drift_score", oracle=_DRIFT_CTE + _CV_SQL + f"SELECT {R2('cv', 6)} AS cv, {R2('drift_score', 6)} AS drift_score, "
       "drift_score > 0.1e0 AS drift_detected FROM sc")
def q_cv_drift_score(spark, sf_dir):
    out = cv_drift_score(dated_predictions(spark, sf_dir)[1])
    return out.select(round_half_up("cv", 6).alias("cv"), round_half_up("drift_score", 6).alias("drift_score"), "drift_detected")


@query("retrain_decision", oracle=_DRIFT_CTE + _CV_SQL + """SELECT
    CASE WHEN n < 100 THEN 'skip' WHEN drift_score > 0.1e0 THEN 'retrain' ELSE 'keep' END AS decision, n AS rows FROM sc""")
def q_retrain_decision(spark, sf_dir):
    """The decision on the current order lines by the cv rule, for a data folder that has a model."""
    _, _, _, path = get_model(spark, sf_dir)
    store = M.ModelStore(spark, path.rsplit("/", 1)[0])
    current = dated_predictions(spark, sf_dir)[1]
    drift = cv_drift_score(current)
    counted = current.agg(F.count(F.lit(1)).alias("rows"))
    r = counted.crossJoin(drift.select("drift_detected")).first()  # one row each
    decision, _ = M.retrain_decision(r["rows"], store.latest() is not None, bool(r["drift_detected"]))
    return counted.select(F.lit(decision).alias("decision"), "rows")


_CONF = ("greatest(0.3e0, (CASE WHEN actual_price < 10 OR actual_price > 100000 THEN 0.8e0 ELSE 1e0 END)"
         " * (CASE WHEN rating < 1 OR rating > 5 THEN 0.7e0 ELSE 1e0 END)"
         " * (CASE WHEN rating_count < 5 THEN 0.8e0 ELSE 1e0 END))")


@query("confidence_score", oracle=_model_sql(f"SELECT row_id, {R2(_CONF)} AS confidence FROM mf"))
def q_confidence_score(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return df.select("row_id", M.confidence_score(F.col("actual_price"), F.col("rating"),
                                                      F.col("rating_count")).alias("confidence"))


@query("scoring_defaults", oracle=_model_sql(f"""SELECT row_id, main_category AS category, main_category,
    main_category AS sub_category,
    CASE WHEN coalesce(actual_price, 0e0) > 0e0 AND coalesce(actual_price, 0e0) <= 500e0 THEN 'budget'
         WHEN coalesce(actual_price, 0e0) > 500e0 AND coalesce(actual_price, 0e0) <= 2000e0 THEN 'mid'
         WHEN coalesce(actual_price, 0e0) > 2000e0 AND coalesce(actual_price, 0e0) <= 10000e0 THEN 'premium'
         WHEN coalesce(actual_price, 0e0) > 10000e0 THEN 'luxury' ELSE 'unknown' END AS price_tier,
    3e0 AS category_depth, 50e0 AS name_length, 200e0 AS description_length,
    {R2('ln(1e0 + cast(coalesce(rating_count, 0) AS double))', 6)} AS rating_count_log, 0.5e0 AS review_sentiment
    FROM mf"""))
def q_scoring_defaults(spark, sf_dir):
    req = model_frame(spark, sf_dir).select("row_id", F.col("main_category").alias("category"),
                                            "actual_price", "rating", "rating_count")
    out = M.scoring_defaults(req)
    return out.select("row_id", "category", "main_category", "sub_category", "price_tier", "category_depth",
                      "name_length", "description_length", round_half_up("rating_count_log", 6).alias("rating_count_log"),
                      "review_sentiment")


@query("score_batch_requests")
def q_score_batch_requests(spark, sf_dir):
    """Sparse request rows scored with defaults (the single-request endpoint as a batch)."""
    model, prep, _, _ = get_model(spark, sf_dir)
    req = model_frame(spark, sf_dir).select("row_id", F.col("main_category").alias("category"),
                                            "actual_price", "rating", "rating_count")
    return M.predict_batch(model, prep, M.scoring_defaults(req)).select("row_id", "predicted_discount", "confidence")


# ---------------------------------------------------------------- validation & missing values


@query("validate_prediction_rows", oracle=with_ctes("r AS (SELECT product_id, main_category AS category, "
    "actual_price, rating, rating_count FROM enriched)", """SELECT product_id,
    category IS NOT NULL AND coalesce(actual_price > 0, false) AND coalesce(rating BETWEEN 0 AND 5, false)
      AND coalesce(rating_count >= 0, false) AS valid,
    cast(len(list_filter([CASE WHEN category IS NULL THEN 'x' END,
                          CASE WHEN NOT coalesce(actual_price > 0, false) THEN 'x' END,
                          CASE WHEN NOT coalesce(rating BETWEEN 0 AND 5, false) THEN 'x' END,
                          CASE WHEN NOT coalesce(rating_count >= 0, false) THEN 'x' END],
                         lambda v: v IS NOT NULL)) AS integer) AS n_reasons FROM r"""))
def q_validate_prediction_rows(spark, sf_dir):
    from shelfspark.plans.frames import enriched
    req = enriched(spark, sf_dir).select("product_id", F.col("main_category").alias("category"),
                                         "actual_price", "rating", "rating_count")
    v = Q.validate_prediction_rows(req)
    return v.select("product_id", "valid", F.size("reasons").alias("n_reasons"))


@query("validate_question_rows", oracle="""SELECT conv_id, turn,
    coalesce(length(text) BETWEEN 3 AND 1000, false) AND (turn % 25) BETWEEN 1 AND 20 AS valid
    FROM conversations WHERE role = 'user'""")
def q_validate_question_rows(spark, sf_dir):
    """User turns as questions; ``top_k`` taken as turn mod 25 so both bounds are exercised."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    q = conv.select("conv_id", "turn", F.col("text").alias("question"),
                    (F.col("turn") % 25).cast("int").alias("top_k"),
                    F.lit(None).cast("double").alias("filter_min_price"),
                    F.lit(None).cast("double").alias("filter_max_price"),
                    F.lit(None).cast("double").alias("filter_min_rating"))
    return Q.validate_question_rows(q).select("conv_id", "turn", "valid")


@query("validate_output_rows", oracle=_model_sql(f"""SELECT row_id,
    {R2(_CONF)} BETWEEN 0 AND 1 AND coalesce(rating / 4e0 BETWEEN 0 AND 1, false) AS valid FROM mf"""))
def q_validate_output_rows(spark, sf_dir):
    """Confidence, and a quarter of the rating as relevance (null or above 1 is invalid)."""
    df = model_frame(spark, sf_dir).select(
        "row_id", M.confidence_score(F.col("actual_price"), F.col("rating"), F.col("rating_count")).alias("confidence"),
        (F.col("rating") / 4.0).alias("relevance"))
    return Q.validate_output_rows(df, relevance="relevance").select("row_id", "valid")


@query("drop_missing_target", oracle=with_ctes("x AS (SELECT 1)",
    "SELECT count(*) AS n FROM catalog WHERE rating IS NOT NULL"))
def q_drop_missing_target(spark, sf_dir):
    """Rows kept when ``rating`` is the target (it has nulls)."""
    return Q.drop_missing_target(catalog_view(spark, sf_dir), "rating").agg(F.count(F.lit(1)).alias("n"))


@query("drop_missing_critical", oracle=with_ctes("x AS (SELECT 1)", """SELECT count(*) AS n FROM catalog
    WHERE order_key % 53 <> 0 AND line_number % 5 <> 0"""))
def q_drop_missing_critical(spark, sf_dir):
    """Rows left when some lines have no price and others no discount."""
    raw = catalog_view(spark, sf_dir).withColumns({
        "actual_price": F.when(F.col("order_key") % 53 != 0, F.col("actual_price")),
        "discount_percentage": F.when(F.col("line_number") % 5 != 0, F.col("discount_percentage"))})
    return enrich_catalog(raw).agg(F.count(F.lit(1)).alias("n"))


@query("fill_missing", oracle=with_ctes("x AS (SELECT 1)", """SELECT main_category,
    cast(sum(coalesce(rating_count, 0)) AS bigint) AS rating_count, count(*) AS n FROM enriched GROUP BY 1"""))
def q_fill_missing(spark, sf_dir):
    df = fill_missing(enrich_catalog(catalog_view(spark, sf_dir)))
    return df.groupBy("main_category").agg(F.sum("rating_count").cast("bigint").alias("rating_count"),
                                           F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- explanations


def _local(spark, sf_dir):
    from shelfspark.operators.explain import shap_local
    model, prep, _, path = get_model(spark, sf_dir)
    feats = M.transform_features(model_frame(spark, sf_dir), prep)
    return shap_local(feats, model, f"{path}/model", prep.feature_names)


@query("shap_local")
def q_shap_local(spark, sf_dir):
    """Per-row contributions; base + Σ contributions = raw score."""
    return _local(spark, sf_dir)


@query("sort_contributions")
def q_sort_contributions(spark, sf_dir):
    loc = _local(spark, sf_dir)
    return loc.select("row_id", F.posexplode("contributions").alias("pos", "c")).select(
        "row_id", (F.col("pos") + 1).alias("rank"), F.col("c.feature_name").alias("feature_name"),
        F.col("c.shap_value").alias("shap_value"))


@query("shap_global")
def q_shap_global(spark, sf_dir):
    from shelfspark.operators.explain import shap_global
    return shap_global(_local(spark, sf_dir))


@query("explanation_summary")
def q_explanation_summary(spark, sf_dir):
    from shelfspark.operators.explain import explanation_summary
    return explanation_summary(_local(spark, sf_dir)).select("row_id", "summary")


@query("score_stream")
def q_score_stream(spark, sf_dir):
    """Order lines arriving as a file stream, joined to the static parts, enriched by the batch rules
    and scored with the saved model (stateless, append mode)."""
    from shelfspark.streaming.telemetry_stream import run_to_table, table_stream
    model, prep, _, _ = get_model(spark, sf_dir)
    frame = model_frame(spark, sf_dir, lineitem=table_stream(spark, sf_dir, "lineitem"))
    scored = M.predict_batch(model, prep, frame)
    return run_to_table(scored.select("row_id", "predicted_discount", "confidence"), "score_stream", mode="append")
