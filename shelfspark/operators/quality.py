"""Data-quality operators: duplicates and row validation.

Validation never raises per row: each rule yields a reason string or null,
``array_compact`` keeps the reasons, and the input splits into valid and
rejected frames (``valid`` flag + ``reasons`` array), all in one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key column (a null key counts as one group)."""
    aggs = []
    for i, k in enumerate(keys):
        has_null = F.when(F.count_if(F.col(k).isNull()) > 0, F.lit(1)).otherwise(F.lit(0))
        aggs.append((F.count(F.lit(1)) - F.count_distinct(k) - has_null).alias(f"_d{i}"))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("key_column"), F.col(f"_d{i}").cast("bigint").alias("duplicates"))
                     for i, k in enumerate(keys)])
    return wide.select(F.inline(rows))


def _check(rules: list[tuple[Column, str]]) -> Column:
    """Array of failed-rule messages (a rule fails when its condition is not true)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(msg)) for cond, msg in rules]))


def with_reasons(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    reasons = _check(rules)
    return df.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def validate_prediction_rows(df: DataFrame) -> DataFrame:
    """Scoring request rules: category present, price > 0, 0 ≤ rating ≤ 5, count ≥ 0."""
    return with_reasons(df, [
        (F.col("category").isNotNull(), "category is required"),
        (F.col("actual_price") > 0, "actual_price must be > 0"),
        (F.col("rating").between(0, 5), "rating must be within [0, 5]"),
        (F.col("rating_count") >= 0, "rating_count must be >= 0"),
    ])


def validate_question_rows(df: DataFrame) -> DataFrame:
    """Question request rules: 3..1000 chars, prices ≥ 0, rating 0..5, top_k 1..20."""
    opt = lambda c, cond: F.col(c).isNull() | cond  # noqa: E731 - optional fields
    return with_reasons(df, [
        (F.length("question").between(3, 1000), "question must have 3 to 1000 characters"),
        (opt("filter_min_price", F.col("filter_min_price") >= 0), "filter_min_price must be >= 0"),
        (opt("filter_max_price", F.col("filter_max_price") >= 0), "filter_max_price must be >= 0"),
        (opt("filter_min_rating", F.col("filter_min_rating").between(0, 5)), "filter_min_rating must be within [0, 5]"),
        (opt("top_k", F.col("top_k").between(1, 20)), "top_k must be within [1, 20]"),
    ])


def validate_output_rows(df: DataFrame, confidence: str = "confidence", relevance: str | None = None) -> DataFrame:
    """Output rules: confidence (and relevance) within [0, 1]."""
    rules = [(F.col(confidence).between(0, 1), f"{confidence} must be within [0, 1]")]
    if relevance:
        rules.append((F.col(relevance).between(0, 1), f"{relevance} must be within [0, 1]"))
    return with_reasons(df, rules)


def check_arguments(test_size: float | None = None, n: int | None = None, metric: str | None = None,
                    metrics: Sequence[str] = ()) -> None:
    """Driver-side argument checks (raise ``ValueError``)."""
    if test_size is not None and not (0.1 <= test_size <= 0.5):
        raise ValueError("test_size must be within [0.1, 0.5]")
    if n is not None and not (1 <= n <= 100):
        raise ValueError("n must be within [1, 100]")
    if metric is not None and metrics and metric not in metrics:
        raise ValueError(f"metric must be one of {list(metrics)}")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons)."""
    return df.where("valid").drop("valid", "reasons"), df.where("NOT valid")


def drop_missing_target(df: DataFrame, target: str = "discount_percentage") -> DataFrame:
    """Drop rows with a null target; error if the target column is absent."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.na.drop(subset=[target])
