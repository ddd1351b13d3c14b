"""Registered source and scalar-cleaning queries.

The raw export text is derived from the tables (``raw_catalog``), written as
CSV below the shared checkpoint folder and read back through the CSV source,
so the cleaners run on real text through a real reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import cleaning as C
from shelfspark.functions.numeric import round_half_up
from shelfspark.operators.enrich import clean_raw_catalog, derive_discount, enrich_catalog, parse_category
from shelfspark.plans.registry import query
from shelfspark.plans.sql import R2, with_ctes
from shelfspark.session import shared_dir
from shelfspark.sources.catalog import (
    alias_columns,
    catalog_view,
    normalize_names,
    raw_catalog,
    read_catalog_csv,
    write_catalog_csv,
)

RAW_SQL = """raw AS (SELECT product_id AS "Product_ID", product_name AS "Product Name", category AS "Category",
  CASE WHEN order_key % 2 = 0 THEN '$' ELSE '₹' END || format('{:,}', cast(floor(discounted_price) AS bigint))
    AS "Discounted-Price",
  CASE WHEN order_key % 53 = 0 THEN 'not a price'
       ELSE '₹' || format('{:,}', cast(floor(actual_price) AS bigint)) END AS "Actual Price",
  CASE WHEN order_key % 61 = 0 THEN 'Save ' ELSE '' END || cast(cast(discount_percentage AS bigint) AS varchar) || '%'
    AS "Discount",
  CASE WHEN order_key % 43 = 0 THEN '|' ELSE cast(rating AS varchar) || ' out of 5 stars' END AS "Rating",
  CASE WHEN rating_count IS NULL THEN NULL ELSE format('{:,}', rating_count) || ' ratings' END AS "Rating Count",
  user_id AS "UserID", user_name AS "User Name", review_id AS "Review_ID"
FROM catalog)"""

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _price_sql(c: str) -> str:
    s = f"regexp_replace({c}, '[₹$,]', '', 'g')"
    return f"CASE WHEN regexp_matches({s}, '{NUM_RE}') THEN TRY_CAST(trim({s}) AS DOUBLE) END"


def _first_num_sql(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE)"


def _count_sql(c: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(regexp_replace({c}, '[,\\s]', '', 'g'), '(\\d+)', 1), '') AS BIGINT)"


def raw_frame(spark, sf_dir):
    """Export text of the rows as they are now, round-tripped through CSV in the shared folder."""
    path = shared_dir(spark, "raw_catalog_csv", unique=True)
    return read_catalog_csv(spark, write_catalog_csv(raw_catalog(spark, sf_dir), path))


CLEAN_COLS = ["product_id", "product_name", "category", "discounted_price", "actual_price", "discount_percentage",
              "rating", "rating_count", "user_id", "user_name", "review_id"]


@query("src_catalog_csv", oracle=with_ctes(RAW_SQL, f"""SELECT "Product_ID" AS product_id,
    "Product Name" AS product_name, "Category" AS category, {_price_sql('"Discounted-Price"')} AS discounted_price,
    {_price_sql('"Actual Price"')} AS actual_price, {_first_num_sql('"Discount"')} AS discount_percentage,
    {_first_num_sql('"Rating"')} AS rating, {_count_sql('"Rating Count"')} AS rating_count,
    "UserID" AS user_id, "User Name" AS user_name, "Review_ID" AS review_id FROM raw"""))
def q_src_catalog_csv(spark, sf_dir):
    return clean_raw_catalog(raw_frame(spark, sf_dir)).select(*CLEAN_COLS)


def _cleaner(raw_col: str, fn, alias: str):
    def q(spark, sf_dir):
        df = raw_frame(spark, sf_dir)
        return df.select(F.col(f"`{raw_col}`").alias("raw"), fn(F.col(f"`{raw_col}`")).alias(alias))
    return q


query("clean_price", oracle=with_ctes(RAW_SQL, f'SELECT "Actual Price" AS raw, {_price_sql(chr(34) + "Actual Price" + chr(34))} AS value FROM raw'))(
    _cleaner("Actual Price", C.clean_price, "value"))
query("clean_rating", oracle=with_ctes(RAW_SQL, f'SELECT "Rating" AS raw, {_first_num_sql(chr(34) + "Rating" + chr(34))} AS value FROM raw'))(
    _cleaner("Rating", C.clean_rating, "value"))
query("clean_rating_count", oracle=with_ctes(RAW_SQL, f'SELECT "Rating Count" AS raw, {_count_sql(chr(34) + "Rating Count" + chr(34))} AS value FROM raw'))(
    _cleaner("Rating Count", C.clean_rating_count, "value"))
query("clean_discount", oracle=with_ctes(RAW_SQL, f'SELECT "Discount" AS raw, {_first_num_sql(chr(34) + "Discount" + chr(34))} AS value FROM raw'))(
    _cleaner("Discount", C.clean_discount, "value"))
query("strip_non_numeric", oracle=with_ctes(RAW_SQL, """SELECT "Discounted-Price" AS raw,
    TRY_CAST(nullif(regexp_replace("Discounted-Price", '[^0-9.]', '', 'g'), '') AS DOUBLE) AS value FROM raw"""))(
    _cleaner("Discounted-Price", C.strip_non_numeric, "value"))
query("strip_percent", oracle=with_ctes(RAW_SQL, f"""SELECT "Discount" AS raw,
    CASE WHEN regexp_matches(replace("Discount", '%', ''), '{NUM_RE}')
         THEN TRY_CAST(trim(replace("Discount", '%', '')) AS DOUBLE) END AS value FROM raw"""))(
    _cleaner("Discount", C.strip_percent, "value"))


@query("coerce_numeric", oracle=with_ctes(RAW_SQL, f"""SELECT "Product_ID" AS raw,
    CASE WHEN regexp_matches("Product_ID", '{NUM_RE}') THEN TRY_CAST(trim("Product_ID") AS DOUBLE) END AS value,
    coalesce(CASE WHEN regexp_matches("User Name", '{NUM_RE}') THEN TRY_CAST(trim("User Name") AS DOUBLE) END, 0e0)
      AS name_value FROM raw"""))
def q_coerce_numeric(spark, sf_dir):
    df = raw_frame(spark, sf_dir)
    return df.select(F.col("Product_ID").alias("raw"), C.coerce_numeric(F.col("Product_ID")).alias("value"),
                     C.coerce_numeric(F.col("`User Name`"), 0.0).alias("name_value"))


@query("derive_discount", oracle=with_ctes(RAW_SQL + f""",
c AS (SELECT {_price_sql('"Actual Price"')} AS a, {_price_sql('"Discounted-Price"')} AS d FROM raw)""",
    f"SELECT a, d, {R2('CASE WHEN a = 0 THEN NULL ELSE (a - d) / a END * 100e0')} AS discount_percentage FROM c"))
def q_derive_discount(spark, sf_dir):
    df = clean_raw_catalog(raw_frame(spark, sf_dir)).drop("discount_percentage")
    return derive_discount(df).select(F.col("actual_price").alias("a"), F.col("discounted_price").alias("d"),
                                      "discount_percentage")


@query("parse_category", oracle=with_ctes("x AS (SELECT 1)",
    "SELECT DISTINCT category, main_category, sub_category, category_depth FROM enriched"))
def q_parse_category(spark, sf_dir):
    df = parse_category(catalog_view(spark, sf_dir).select("category"))
    return df.select("category", "main_category", "sub_category", "category_depth").distinct()


@query("price_tier", oracle=with_ctes("x AS (SELECT 1)", "SELECT actual_price, price_tier FROM enriched"))
def q_price_tier(spark, sf_dir):
    from shelfspark.functions.bins import price_tier
    return catalog_view(spark, sf_dir).select("actual_price", price_tier("actual_price").alias("price_tier"))


@query("log1p_count", oracle=with_ctes("x AS (SELECT 1)",
    f"SELECT DISTINCT rating_count, {R2('rating_count_log', 6)} AS rating_count_log FROM enriched"))
def q_log1p_count(spark, sf_dir):
    df = enrich_catalog(catalog_view(spark, sf_dir))
    return df.select("rating_count", round_half_up("rating_count_log", 6).alias("rating_count_log")).distinct()


_ENRICHED_OUT = ["product_id", "product_name", "category", "actual_price", "discount_percentage", "discounted_price",
                 "rating", "rating_count", "review_id", "main_category", "sub_category", "category_depth",
                 "name_length", "description_length", "review_text_count", "price_tier"]


@query("enrich_catalog", oracle=with_ctes("x AS (SELECT 1)",
    f"SELECT {', '.join(_ENRICHED_OUT)}, {R2('rating_count_log', 6)} AS rating_count_log FROM enriched"))
def q_enrich_catalog(spark, sf_dir):
    df = enrich_catalog(catalog_view(spark, sf_dir, texts=True))
    return df.select(*_ENRICHED_OUT, round_half_up("rating_count_log", 6).alias("rating_count_log"))


def _columns_sql(names: list[tuple[str, str]]) -> str:
    return with_ctes(RAW_SQL, " UNION ALL ".join(
        f"SELECT cast({i} AS integer) AS position, '{new}' AS column_name, count({old}) AS n_non_null FROM raw"
        for i, (old, new) in enumerate(names)))


_RAW_HEADERS = ["Product_ID", "Product Name", "Category", "Discounted-Price", "Actual Price", "Discount", "Rating",
                "Rating Count", "UserID", "User Name", "Review_ID"]
_NORMALIZED = [h.lower().replace(" ", "_").replace("-", "_") for h in _RAW_HEADERS]
_ALIASED = ["product_id", "product_name", "category", "discounted_price", "actual_price", "discount_percentage",
            "rating", "rating_count", "user_id", "user_name", "review_id"]


def _column_counts(df):
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                              F.count(F.col(f"`{c}`")).alias("n_non_null")) for i, c in enumerate(df.columns)])
    return df.agg(rows.alias("_r")).select(F.inline("_r"))


@query("src_normalize_names", oracle=_columns_sql([(f'"{h}"', n) for h, n in zip(_RAW_HEADERS, _NORMALIZED)]))
def q_src_normalize_names(spark, sf_dir):
    return _column_counts(normalize_names(raw_frame(spark, sf_dir)))


@query("src_alias_columns", oracle=_columns_sql([(f'"{h}"', n) for h, n in zip(_RAW_HEADERS, _ALIASED)]))
def q_src_alias_columns(spark, sf_dir):
    return _column_counts(alias_columns(normalize_names(raw_frame(spark, sf_dir))))
