"""The whole catalog summary: every profile section as (section, key, value) rows.

A plan over the catalog's columns, written when it is called; write the result to keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import CORRELATION_COLUMNS, SUMMARY_NUMERIC_COLUMNS
from shelfspark.functions.numeric import round_half_up
from shelfspark.operators.profile import category_summary, correlation_matrix, dataset_summary, value_counts
from shelfspark.session import materialized

TEXT_COLUMNS = ("name_length", "description_length", "review_text_count")
CATEGORY_KEYS = ("product_count", "avg_price", "avg_discount", "avg_rating", "total_reviews", "sub_categories",
                 "price_min", "price_max")


def full_summary(df: DataFrame) -> DataFrame:
    """Dataset counts, top categories, column stats, missing values, price tiers, categories, texts and correlations.

    The columns that the sections read are written once; every section reads that table.
    """
    used = dict.fromkeys(["main_category", "sub_category", "price_tier", *SUMMARY_NUMERIC_COLUMNS, *TEXT_COLUMNS, *CORRELATION_COLUMNS])
    df = materialized(df.select(*[c for c in used if c in df.columns]), "summary_rows")
    tiers = value_counts(df, "price_tier").select(
        F.lit("price_tiers").alias("section"), F.col("price_tier").alias("key"), F.col("n").cast("double").alias("value"))
    categories = category_summary(df).select(F.lit("categories").alias("section"), F.inline(F.array(*[
        F.struct(F.concat("main_category", F.lit(f".{k}")).alias("key"), F.col(k).cast("double").alias("value"))
        for k in CATEGORY_KEYS])))
    lengths = df.agg(*[f(c).cast("double").alias(f"{c}.{k}") for c in TEXT_COLUMNS
                       for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    texts = lengths.select(F.lit("texts").alias("section"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), round_half_up(F.col(f"`{k}`")).alias("value")) for k in lengths.columns])))
    matrix = correlation_matrix(df)
    correlations = matrix.where(_first_of_pair()).select(
        F.lit("correlations").alias("section"), F.concat("column_a", F.lit("|"), "column_b").alias("key"), F.col("r").alias("value"))
    out = dataset_summary(df, written=True)
    for part in (tiers, categories, texts, correlations):
        out = out.unionByName(part)
    return out


def _first_of_pair() -> Column:
    place = F.create_map(*[x for i, c in enumerate(CORRELATION_COLUMNS) for x in (F.lit(c), F.lit(i))])
    return F.element_at(place, F.col("column_a")) < F.element_at(place, F.col("column_b"))
