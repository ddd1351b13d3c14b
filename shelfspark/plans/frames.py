"""Named input frames shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.operators.enrich import enrich_catalog
from shelfspark.operators.insights import notebook_frame
from shelfspark.sources.catalog import ROW_ORDER, catalog_view


def enriched(spark: SparkSession, sf_dir: str, users: bool = False) -> DataFrame:
    """Cleaned + enriched catalog with per-product text features.

    A plan, not a table: every query reads the columns and joins it needs.
    """
    return enrich_catalog(catalog_view(spark, sf_dir, users=users, texts=True))


def questions_frame(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Input of the business questions: one row per review, rating_count filled.

    ``columns`` are those a question reads, all where none is named: reviews are
    told apart with these and the row order alone, and users are joined where asked for.
    """
    users = not columns or bool({"user_id", "user_name"} & set(columns))
    rows = catalog_view(spark, sf_dir, users=users)
    if columns:
        rows = rows.select(*dict.fromkeys(["review_id", "rating_count", *ROW_ORDER, *columns]))
    return notebook_frame(rows)
