"""Catalog cleaning and enrichment — the load chain as one projection.

Every step is a native expression; missing optional columns get the
reference defaults so later operators need no presence checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.bins import price_tier
from shelfspark.functions.numeric import round_half_up
from shelfspark.functions.cleaning import (
    clean_discount,
    clean_price,
    clean_rating,
    clean_rating_count,
    count_segments,
    strip_ws,
    text_length,
)
from shelfspark.sources.catalog import alias_columns, normalize_names

CRITICAL_COLUMNS = ("actual_price", "discount_percentage")


def clean_raw_catalog(df: DataFrame) -> DataFrame:
    """Text export → typed columns: normalise names, resolve aliases, clean values."""
    df = alias_columns(normalize_names(df))
    cleaners = {
        "actual_price": clean_price,
        "discounted_price": clean_price,
        "discount_percentage": clean_discount,
        "rating": clean_rating,
        "rating_count": clean_rating_count,
    }
    return df.withColumns({c: fn(F.col(c)) for c, fn in cleaners.items() if c in df.columns})


def derive_discount(df: DataFrame) -> DataFrame:
    """If no discount column but both prices: ``round((a-d)/a*100, 2)`` (a=0 → null)."""
    if "discount_percentage" in df.columns:
        return df
    if not {"actual_price", "discounted_price"} <= set(df.columns):
        return df
    a, d = F.col("actual_price"), F.col("discounted_price")
    return df.withColumn("discount_percentage", round_half_up(F.try_divide(a - d, a) * F.lit(100.0), 2))


def category_parts(c: Column) -> tuple[Column, Column, Column]:
    """``'A|B|C'`` → (main, sub, depth); sub falls back to main; null/empty → Unknown, Unknown, 0."""
    parts = F.split(c, r"\|", -1)
    empty = c.isNull() | (c == "")
    main = F.when(empty, F.lit("Unknown")).otherwise(strip_ws(F.element_at(parts, 1)))
    sub = (F.when(empty, F.lit("Unknown"))
            .when(F.size(parts) > 1, strip_ws(F.element_at(parts, 2)))
            .otherwise(main))
    depth = F.when(empty, F.lit(0)).otherwise(F.size(parts)).cast("int")
    return main, sub, depth


def parse_category(df: DataFrame, source: str = "category") -> DataFrame:
    """Add main_category, sub_category, category_depth from a ``|`` path."""
    if source not in df.columns:
        return df.withColumns({"main_category": F.lit("Unknown"), "sub_category": F.lit("Unknown"),
                               "category_depth": F.lit(0)})
    main, sub, depth = category_parts(F.col(source))
    return df.withColumns({"main_category": main, "sub_category": sub, "category_depth": depth})


def enrich_catalog(df: DataFrame, drop_missing: bool = True) -> DataFrame:
    """Derived columns of the load chain, then drop rows missing critical values.

    Adds main/sub category and depth, name/description lengths, review text
    count, price tier and log1p(rating_count).  Precomputed
    ``description_length``/``review_text_count`` columns (from per-product text)
    are kept as they are.
    """
    df = derive_discount(df)
    df = parse_category(df)
    cols = set(df.columns)
    new: dict[str, Column] = {
        "name_length": text_length("product_name") if "product_name" in cols else F.lit(0).cast("bigint"),
    }
    if "description_length" in cols:
        new["description_length"] = F.coalesce(F.col("description_length"), F.lit(0)).cast("bigint")
    else:
        new["description_length"] = (text_length("about_product") if "about_product" in cols
                                      else F.lit(0).cast("bigint"))
    if "review_text_count" in cols:
        new["review_text_count"] = F.coalesce(F.col("review_text_count"), F.lit(0)).cast("bigint")
    else:
        new["review_text_count"] = (count_segments("review_content") if "review_content" in cols
                                    else F.lit(0).cast("bigint"))
    new["price_tier"] = price_tier("actual_price") if "actual_price" in cols else F.lit("unknown")
    new["rating_count_log"] = (F.log1p(F.coalesce(F.col("rating_count"), F.lit(0)).cast("double"))
                               if "rating_count" in cols else F.lit(0.0))
    df = df.withColumns(new)
    return drop_missing_critical(df) if drop_missing else df


def drop_missing_critical(df: DataFrame) -> DataFrame:
    """Drop rows null in actual_price or discount_percentage (those present)."""
    subset = [c for c in CRITICAL_COLUMNS if c in df.columns]
    return df.na.drop(subset=subset) if subset else df


def fill_missing(df: DataFrame) -> DataFrame:
    """rating_count null → 0; categoricals null → ``Unknown``."""
    fills: dict[str, object] = {}
    if "rating_count" in df.columns:
        fills["rating_count"] = 0
    for c in ("main_category", "sub_category", "price_tier"):
        if c in df.columns:
            fills[c] = "Unknown"
    return df.na.fill(fills) if fills else df
