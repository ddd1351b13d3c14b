"""Catalog sources.

* ``catalog_view`` — the sales/catalog table derived from the star schema
  (one row per order line, like one review line of a product export).
* ``raw_catalog`` / ``write_catalog_csv`` / ``read_catalog_csv`` — the same rows
  as raw export text (currency symbols, thousands separators, ``%`` and
  "out of 5 stars" suffixes, junk values) for the CSV source and the cleaners.
* ``normalize_names`` / ``alias_columns`` — header normalisation and the
  first-alias-wins rename map.

Joins: lineitem ⋈ part always; orders and customer only when user columns are
asked for, so questions that never touch users never pay those two shuffles.
Per-product text features are computed once per document and joined to
``part`` *before* the lineitem join, so the text work does not grow with the
number of order lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.constants import COLUMN_ALIASES
from shelfspark.functions.cleaning import count_segments
from shelfspark.sources.tables import read_table

# Row order used wherever the reference relies on file order ("keep first",
# ordered pairs): order key, line number, part key, supplier key, price.
ROW_ORDER = ["order_key", "line_number", "part_key", "supp_key", "actual_price"]


def product_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-product description/review text: ``documents.text`` keyed by ``doc_id = part key``."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("part_key"),
        F.col("text").alias("about_product"),
        F.col("text").alias("review_content"),
    )


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric text features per product, computed once per document."""
    return product_texts(spark, sf_dir).select(
        "part_key",
        F.length("about_product").cast("bigint").alias("description_length"),
        count_segments("review_content").alias("review_text_count"),
    )


def catalog_view(
    spark: SparkSession,
    sf_dir: str,
    users: bool = False,
    texts: bool = False,
    part_features: DataFrame | None = None,
    lineitem: DataFrame | None = None,
) -> DataFrame:
    """Catalog rows with numeric prices (no cleaning needed).

    Columns: product_id, product_name, category, actual_price,
    discount_percentage, discounted_price, rating, rating_count, review_id,
    row-order keys (order_key, line_number, part_key, supp_key) and, on request,
    user_id/user_name, description_length/review_text_count, plus any
    ``part_features`` columns (keyed by ``part_key``).  ``lineitem`` may be a
    stream of order lines instead of the table.
    """
    li = (read_table(spark, sf_dir, "lineitem") if lineitem is None else lineitem).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey"), "p_name", "p_type", "p_brand", "p_size")
    if texts:
        tf = text_features(spark, sf_dir)
        part = part.join(tf, part.p_partkey == tf.part_key, "left").drop("part_key")
    if part_features is not None:
        pf = part_features.withColumnRenamed("part_key", "_pf_key")
        part = part.join(pf, part.p_partkey == pf._pf_key, "left").drop("_pf_key")

    df = li.join(part, li.l_partkey == part.p_partkey, "inner")
    if users:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        df = (df.join(orders, df.l_orderkey == orders.o_orderkey, "left")
                .join(cust, F.col("o_custkey") == cust.c_custkey, "left"))

    actual = F.col("l_extendedprice") / F.lit(10.0)
    discount = F.round(F.col("l_discount") * F.lit(700.0), 0)
    size_mod = F.col("p_size") % 3
    cols: list[Column] = [
        F.col("l_partkey").cast("string").alias("product_id"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("l_partkey").cast("string")).alias("product_name"),
        F.when(size_mod == 0, F.col("p_type"))
         .when(size_mod == 1, F.concat_ws("|", "p_type", "p_brand"))
         .otherwise(F.concat_ws("|", "p_type", "p_brand", "p_name")).alias("category"),
        actual.alias("actual_price"),
        discount.alias("discount_percentage"),
        (actual * (F.lit(1.0) - discount / F.lit(100.0))).alias("discounted_price"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(1.0) + ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 3) % 41).cast("double")
                    / F.lit(10.0)).alias("rating"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(None).cast("bigint"))
         .otherwise((F.col("l_orderkey") * 13 + F.col("l_partkey")) % 50000).cast("bigint").alias("rating_count"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("review_id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
    ]
    if users:
        cols += [F.col("o_custkey").cast("string").alias("user_id"), F.col("c_name").alias("user_name")]
    if texts:
        cols += [F.col("description_length"), F.col("review_text_count")]
    if part_features is not None:
        cols += [F.col(c) for c in part_features.columns if c != "part_key"]
    return df.select(*cols)


# ---------------------------------------------------------------- raw export text

RAW_HEADERS = {
    # canonical name -> header as a messy export would spell it
    "product_id": "Product_ID",
    "product_name": "Product Name",
    "category": "Category",
    "discounted_price": "Discounted-Price",
    "actual_price": "Actual Price",
    "discount_percentage": "Discount",
    "rating": "Rating",
    "rating_count": "Rating Count",
    "user_id": "UserID",
    "user_name": "User Name",
    "review_id": "Review_ID",
}


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows as export text, with deliberate junk for the cleaners.

    actual_price: ``₹1,099`` (``not a price`` on order keys divisible by 53);
    discounted_price: ``$1,023`` or ``₹1,023``; discount: ``64%`` or ``Save 64%``;
    rating: ``4.2 out of 5 stars`` or ``|``; rating_count: ``24,269 ratings``.
    """
    c = catalog_view(spark, sf_dir, users=True)
    ok = F.col("order_key")
    fmt_int = lambda x: F.format_number(F.floor(x).cast("bigint"), 0)
    disc_txt = F.concat(F.col("discount_percentage").cast("bigint").cast("string"), F.lit("%"))
    return c.select(
        F.col("product_id").alias(RAW_HEADERS["product_id"]),
        F.col("product_name").alias(RAW_HEADERS["product_name"]),
        F.col("category").alias(RAW_HEADERS["category"]),
        F.when(ok % 2 == 0, F.concat(F.lit("$"), fmt_int(F.col("discounted_price"))))
         .otherwise(F.concat(F.lit("₹"), fmt_int(F.col("discounted_price"))))
         .alias(RAW_HEADERS["discounted_price"]),
        F.when(ok % 53 == 0, F.lit("not a price"))
         .otherwise(F.concat(F.lit("₹"), fmt_int(F.col("actual_price"))))
         .alias(RAW_HEADERS["actual_price"]),
        F.when(ok % 61 == 0, F.concat(F.lit("Save "), disc_txt)).otherwise(disc_txt)
         .alias(RAW_HEADERS["discount_percentage"]),
        F.when(ok % 43 == 0, F.lit("|"))
         .otherwise(F.concat(F.col("rating").cast("string"), F.lit(" out of 5 stars")))
         .alias(RAW_HEADERS["rating"]),
        F.concat(F.format_number(F.col("rating_count"), 0), F.lit(" ratings")).alias(RAW_HEADERS["rating_count"]),
        F.col("user_id").alias(RAW_HEADERS["user_id"]),
        F.col("user_name").alias(RAW_HEADERS["user_name"]),
        F.col("review_id").alias(RAW_HEADERS["review_id"]),
    )


def write_catalog_csv(df: DataFrame, path: str) -> str:
    """Write export text as header CSV (quoted, ``"`` escaped by doubling)."""
    (df.write.mode("overwrite")
       .option("header", True).option("quote", '"').option("escape", '"')
       .csv(path))
    return path


def read_catalog_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read a catalog export with every column as text; a missing path raises.

    ``multi_line`` handles quoted newlines but makes each file one task;
    keep it off for large splittable exports.
    """
    return (spark.read
            .option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("inferSchema", False)
            .csv(path))


def normalize_names(df: DataFrame) -> DataFrame:
    """lower-case; spaces and dashes → underscores."""
    mapping = {c: c.lower().replace(" ", "_").replace("-", "_") for c in df.columns}
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k != v})


def alias_columns(df: DataFrame) -> DataFrame:
    """For each canonical name the first alias present is renamed to it."""
    present = set(df.columns)
    renames: dict[str, str] = {}
    for canonical, alternatives in COLUMN_ALIASES.items():
        for alt in alternatives:
            if alt in present:
                if alt != canonical:
                    renames[alt] = canonical
                break
    # A renamed column replaces an existing column of the target name.
    clashes = [t for s, t in renames.items() if t in present and t not in renames]
    if clashes:
        df = df.drop(*clashes)
    return df.withColumnsRenamed(renames) if renames else df
