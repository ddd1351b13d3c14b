"""Discount model: feature preparation, split, gradient-boosted trees,
prediction with confidence, evaluation, persistence and retraining.

Scale notes
* Fitted state is small: a (label, code) table per categorical column
  (joined, so Spark picks broadcast or shuffle by its measured size) and a
  handful of scalars per numeric column (bounded by the number of features).
* The split is a hash of the row's key and a seed — deterministic whatever
  the partitioning, unlike ``randomSplit``.
* Training is Spark ML ``GBTRegressor`` (distributed histogram aggregation);
  the driver only holds the trees.
"""

from __future__ import annotations

import datetime as _dt
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import SparkContext, StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.constants import (
    CATEGORICAL_FEATURES,
    MIN_ROWS_FOR_RETRAIN,
    NUMERIC_FEATURES,
    SCORING_DEFAULTS,
    TARGET,
)
from shelfspark.functions.bins import price_tier
from shelfspark.functions.numeric import round_half_up
from shelfspark.operators.quantiles import exact_quantiles, quantile_scalar
from shelfspark.session import materialized

# ---------------------------------------------------------------- features


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): sorted distinct labels (null → ``Unknown``) numbered 0..n-1.

    The window runs over the *distinct* labels only (one row per category).
    """
    labels = df.select(F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias("label")).distinct()
    from pyspark.sql import Window
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, column: str, codes: DataFrame, out: str | None = None) -> DataFrame:
    """Left join to the code table; unseen labels (and an absent column) → 0."""
    out = out or f"{column}_code"
    if column not in df.columns:
        return df.withColumn(out, F.lit(0))
    keyed = df.withColumn("_lbl", F.coalesce(F.col(column).cast("string"), F.lit("Unknown")))
    m = codes.select(F.col("label").alias("_lbl"), F.col("code").alias(out))
    return keyed.join(m, "_lbl", "left").withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("_lbl")


@dataclass
class FeaturePrep:
    """Fitted preprocessing state."""

    categorical: list[str]
    numeric: list[str]
    codes: dict[str, DataFrame] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)

    @property
    def feature_names(self) -> list[str]:
        return [f"{c}_encoded" for c in self.categorical] + list(self.numeric)

    def info(self) -> dict:
        return {"categorical": self.categorical, "numeric": self.numeric, "n_features": len(self.feature_names),
                "medians": self.medians, "means": self.means, "stds": self.stds}


def fit_features(df: DataFrame, categorical: Sequence[str] = CATEGORICAL_FEATURES,
                 numeric: Sequence[str] = NUMERIC_FEATURES, written: bool = False) -> FeaturePrep:
    """Fit label codes, medians, and population mean/std of the imputed values.

    ``written``: ``df`` is a stored table, its columns need not be stored again.
    """
    cat = [c for c in categorical if c in df.columns]
    num = [c for c in numeric if c in df.columns]
    prep = FeaturePrep(cat, num)
    prep.codes = {c: label_codes(df, c).cache() for c in cat}
    for codes in prep.codes.values():
        codes.count()  # a table of unknown size would be joined by shuffling every row
    if num:
        med = {r["column"]: r["quantiles"][0] for r in exact_quantiles(df, num, [0.5], written).collect()}  # one row per column
        prep.medians = {c: float(med.get(c) or 0.0) for c in num}
        imp = impute(df, prep.medians)
        st = imp.agg(*[F.avg(c).alias(f"m_{c}") for c in num], *[F.stddev_pop(c).alias(f"s_{c}") for c in num]).first()
        prep.means = {c: float(st[f"m_{c}"] or 0.0) for c in num}
        prep.stds = {c: float(st[f"s_{c}"] or 0.0) for c in num}
    return prep


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Numeric nulls → the given medians (all-null column → 0)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in medians.items()})


def median_impute(df: DataFrame, columns: Sequence[str], prep: FeaturePrep | None = None,
                  mode: str = "fit") -> DataFrame:
    """``fit``: fitted medians; ``batch``: medians of ``df`` itself (scalar
    subqueries, no join)."""
    if mode == "fit":
        if prep is None:
            raise ValueError("fit mode needs a fitted FeaturePrep")
        return impute(df, {c: prep.medians.get(c, 0.0) for c in columns})
    subs = {c: F.coalesce(quantile_scalar(df, c, 0.5), F.lit(0.0)) for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), subs[c]) for c in columns})


def standard_scale(df: DataFrame, means: dict[str, float], stds: dict[str, float]) -> DataFrame:
    """(x − mean) / population std; a zero std divides by 1."""
    return df.withColumns({c: (F.col(c) - F.lit(means[c])) / F.lit(stds[c] if stds[c] != 0 else 1.0)
                           for c in means})


def transform_features(df: DataFrame, prep: FeaturePrep, mode: str = "fit",
                       out: str = "features") -> DataFrame:
    """Codes, imputation, scaling, then one vector column (codes first)."""
    for c in prep.categorical:
        df = label_encode(df, c, prep.codes[c], f"{c}_encoded")
    missing = [c for c in prep.numeric if c not in df.columns]
    if missing:
        df = df.withColumns({c: F.lit(None).cast("double") for c in missing})
    df = median_impute(df, prep.numeric, prep, mode)
    df = standard_scale(df, {c: prep.means[c] for c in prep.numeric}, {c: prep.stds[c] for c in prep.numeric})
    return VectorAssembler(inputCols=prep.feature_names, outputCol=out, handleInvalid="keep").transform(df)


# ---------------------------------------------------------------- split


def hash_fraction(key: Column, seed: int) -> Column:
    """Uniform [0, 1) from the first 32 bits of ``md5(key#seed)``; independent of partitioning and engine."""
    text = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def hash_below(key: Column, seed: int, share: float) -> Column:
    """``hash_fraction(key, seed) < share`` from the digest's text: hex digits of one length sort like their numbers."""
    first = math.ceil(share * 2.0 ** 32)
    if not 0 <= first < 1 << 32:
        return hash_fraction(key, seed) < share
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))) < F.lit(f"{first:08x}")


def train_test_split(df: DataFrame, key: str = "row_id", test_size: float = 0.2, seed: int = 42,
                     validation_size: float = 0.1) -> DataFrame:
    """Adds ``split`` ∈ {train, validation, test}; validation is carved from train."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    below = lambda salt, share: hash_below(F.col(key), salt, share)
    return df.withColumn("split", F.when(below(seed, test_size), "test")
                         .when(below(seed + 1, validation_size), "validation").otherwise("train"))


# ---------------------------------------------------------------- model


GBT_PARAMS = dict(maxIter=100, stepSize=0.1, maxDepth=6, minInstancesPerNode=20, subsamplingRate=0.8,
                  featureSubsetStrategy="0.8", seed=42, maxBins=32)
PATIENCE = 10
TRAIN_ROWS = 1 << 19  # rows of a training partition


def best_round(errors: Sequence[float], patience: int = PATIENCE) -> int:
    """Number of trees at the lowest validation error before ``patience`` rounds without a lower one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def train_regressor(train: DataFrame, features: str = "features", label: str = TARGET,
                    validation_col: str | None = "is_validation", patience: int = PATIENCE,
                    **params) -> GBTRegressionModel:
    """Gradient-boosted regression trees, as many as the validation error asks for.

    Trees are fitted on the rows that are not for validation.  The number of
    rounds doubles (the same seed grows the same first trees) until the error on
    the validation rows has not fallen for ``patience`` rounds, or ``maxIter`` is
    reached; the lowest error then picks the number of trees, and those are kept.
    """
    p = dict(GBT_PARAMS)
    p.update(params)
    gbt = GBTRegressor(featuresCol=features, labelCol=label, **p)
    if not validation_col or validation_col not in train.columns:
        return gbt.fit(train)
    own, held = train.where(~F.col(validation_col)), train.where(F.col(validation_col))
    most = gbt.getMaxIter()
    if held.isEmpty():
        return gbt.fit(own)
    rounds = min(most, 2 * patience)
    while True:
        model = gbt.setMaxIter(rounds).fit(own)
        best = best_round(model.evaluateEachIteration(held, "squared"), patience)
        if rounds == most or best + patience <= rounds:
            break
        rounds = min(most, 2 * rounds)
    return model if best == rounds else first_trees(model, best)


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` trees: what a fit of ``n`` rounds with its seed would grow, without growing them again."""
    java = model._java_obj
    gateway = SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    return model._copyValues(GBTRegressionModel(cut))._set(maxIter=n)


def confidence_score(price: Column, rating: Column, count: Column) -> Column:
    """1.0 × 0.8 if price < 10 or > 100000 × 0.7 if rating ∉ [1, 5] × 0.8 if count < 5; floor 0.3; 2 dp."""
    c = (F.when((price < 10) | (price > 100000), F.lit(0.8)).otherwise(F.lit(1.0))
         * F.when((rating < 1) | (rating > 5), F.lit(0.7)).otherwise(F.lit(1.0))
         * F.when(count < 5, F.lit(0.8)).otherwise(F.lit(1.0)))
    return round_half_up(F.greatest(F.lit(0.3), c), 2)


def predict_batch(model: GBTRegressionModel, prep: FeaturePrep, df: DataFrame, mode: str = "fit") -> DataFrame:
    """Raw prediction, ``prediction`` clipped to [0, 100], ``predicted_discount``
    rounded to 2 dp, and ``confidence``."""
    feats = transform_features(df, prep, mode)
    out = model.setPredictionCol("raw_prediction").transform(feats)
    clipped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("raw_prediction")))
    cnt = F.col("rating_count") if "rating_count" in df.columns else F.lit(0)
    return (out.withColumn("prediction", clipped)
               .withColumn("predicted_discount", round_half_up(clipped, 2))
               .withColumn("confidence", confidence_score(F.col("actual_price"), F.col("rating"), cnt)))


def scoring_defaults(requests: DataFrame) -> DataFrame:
    """Sparse request rows (category, actual_price, rating, rating_count) →
    full feature rows: sub = main category, tier by price, fixed defaults."""
    return requests.select(
        "*",
        F.col("category").alias("main_category"),
        F.col("category").alias("sub_category"),
        price_tier(F.col("actual_price")).alias("price_tier"),
        F.lit(SCORING_DEFAULTS["category_depth"]).cast("double").alias("category_depth"),
        F.lit(SCORING_DEFAULTS["name_length"]).cast("double").alias("name_length"),
        F.lit(SCORING_DEFAULTS["description_length"]).cast("double").alias("description_length"),
        F.log1p(F.coalesce(F.col("rating_count"), F.lit(0)).cast("double")).alias("rating_count_log"),
        F.lit(SCORING_DEFAULTS["review_sentiment"]).alias("review_sentiment"),
    )


def evaluate_regression(scored: DataFrame, label: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """rmse, mae, r2, mape (= mean |(y − p)/(y + 1e-8)| · 100) in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction)
    e = y - p
    agg = scored.agg(F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("mae"),
                     F.var_pop(y).alias("_var"),
                     (F.avg(F.abs(e / (y + F.lit(1e-8)))) * F.lit(100.0)).alias("mape"),
                     F.count(F.lit(1)).alias("n"))
    return agg.select(F.sqrt("_mse").alias("rmse"), "mae",
                      (F.lit(1.0) - F.try_divide(F.col("_mse"), F.col("_var"))).alias("r2"), "mape", "n")


def feature_importance(spark: SparkSession, model: GBTRegressionModel, names: Sequence[str]) -> DataFrame:
    """(feature, importance) from the fitted trees (normalised gain)."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")


def top_features(importance: DataFrame, n: int = 3) -> DataFrame:
    """Top-n feature names and a name → importance (4 dp) map."""
    top = F.slice(F.sort_array(F.collect_list(F.struct(F.col("importance"), F.col("feature"))), asc=False), 1, n)
    return importance.agg(top.alias("_t")).select(
        F.transform("_t", lambda s: s["feature"]).alias("top_features"),
        F.map_from_entries(F.transform("_t", lambda s: F.struct(s["feature"], round_half_up(s["importance"], 4))))
         .alias("importance"))


# ---------------------------------------------------------------- persistence


class ModelStore:
    """Model + fitted prep + feature names + metrics saved together.

    ``root`` is a folder in shared storage; each save writes a new UTC-stamped
    version folder, so readers never see a half-written model.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _versions(self) -> list[str]:
        jvm = self.spark._jvm  # listing through Hadoop FS works for any scheme
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_COMPLETE"))]
        return sorted(done)

    def latest(self) -> str | None:
        v = self._versions()
        return f"{self.root}/{v[-1]}" if v else None

    def save(self, model: GBTRegressionModel, prep: FeaturePrep, metrics: dict) -> str:
        stamp = _dt.datetime.now(_dt.timezone.utc).strftime("v%Y%m%dT%H%M%S%f")
        path = f"{self.root}/{stamp}"
        model.write().overwrite().save(f"{path}/model")
        for c, df in prep.codes.items():
            df.write.mode("overwrite").parquet(f"{path}/codes/{c}")
        meta = {"prep": prep.info(), "feature_names": prep.feature_names, "metrics": metrics}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/meta")
        self.spark.createDataFrame([("ok",)], "v string").coalesce(1).write.mode("overwrite").text(f"{path}/_COMPLETE")
        return path

    def load(self, path: str | None = None) -> tuple[GBTRegressionModel, FeaturePrep, dict, str]:
        path = path or self.latest()
        if path is None:
            raise FileNotFoundError(f"no saved model under {self.root}")
        model = GBTRegressionModel.load(f"{path}/model")
        meta = json.loads(self.spark.read.text(f"{path}/meta").first()[0])
        info = meta["prep"]
        prep = FeaturePrep(info["categorical"], info["numeric"], medians=info["medians"], means=info["means"],
                           stds=info["stds"])
        prep.codes = {c: self.spark.read.parquet(f"{path}/codes/{c}") for c in prep.categorical}
        return model, prep, meta["metrics"], path


def fit_and_evaluate(df: DataFrame, key: str = "row_id", **params) -> tuple[GBTRegressionModel, FeaturePrep, dict]:
    """Split → fit prep on train only → train with validation rows → test metrics.

    The split rows are written once: codes, medians, moments, training and test read
    that table, not the catalog and its texts again.  Training rows are dealt by key
    into partitions of about ``TRAIN_ROWS``, so tasks are neither few nor many.
    """
    used = [c for c in (key, *CATEGORICAL_FEATURES, *NUMERIC_FEATURES, TARGET) if c in df.columns]
    split = materialized(train_test_split(df, key).select(*dict.fromkeys(used), "split"), "split_rows")
    train_part = split.where(F.col("split") != "test")
    prep = fit_features(train_part.where(F.col("split") == "train"), written=True)
    dealt = math.ceil(train_part.count() / TRAIN_ROWS)
    if dealt > 1:
        train_part = train_part.repartition(dealt, key)
    train = transform_features(train_part, prep).select("features", TARGET, (F.col("split") == "validation").alias("is_validation"))
    train = train.persist(StorageLevel.DISK_ONLY)  # read a few times a fit; memory is left to the fit's own rows, read per tree level
    model = train_regressor(train, **params)
    train.unpersist()
    test = predict_batch(model, prep, split.where(F.col("split") == "test"))
    m = evaluate_regression(test).first().asDict()
    metrics = {k: (float(v) if v is not None else None) for k, v in m.items()}
    metrics["n_trees"] = float(model.getNumTrees)
    return model, prep, metrics


def retrain_decision(new_rows: int, has_model: bool, drift: bool) -> tuple[str, str]:
    """(decision, reason): skip below 100 rows; train without a model; retrain on drift; else keep."""
    if new_rows < MIN_ROWS_FOR_RETRAIN:
        return "skip", f"only {new_rows} rows (< {MIN_ROWS_FOR_RETRAIN})"
    if not has_model:
        return "train", "no model"
    if drift:
        return "retrain", "drift detected"
    return "keep", "no drift"


def retrain_if_needed(store: ModelStore, frame: DataFrame, drift: bool, rows: int | None = None) -> tuple[str, str, str | None]:
    """Decide on ``frame``, and when the decision asks for it train on it and save a new version: (decision, reason, path)."""
    n = frame.count() if rows is None else rows
    decision, reason = retrain_decision(n, store.latest() is not None, drift)
    if decision in ("train", "retrain"):
        return decision, reason, store.save(*fit_and_evaluate(frame))
    return decision, reason, store.latest()


def default_store_root(spark: SparkSession, name: str) -> str:
    from shelfspark.session import shared_dir
    return shared_dir(spark, "models", name)

