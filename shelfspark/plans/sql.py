"""Shared DuckDB SQL fragments for the oracles.

The oracle side re-derives every value in plain SQL from the raw tables; it
shares no code with the Spark side.  ``R2(x)`` rounds like
``functions.numeric.round_half_up`` so tie handling is engine independent.
"""

from __future__ import annotations


def R2(x: str, digits: int = 2) -> str:  # noqa: N802 - reads like SQL
    scale = f"1e{digits}"
    return f"(cast(floor(({x}) * {scale} + 0.5e0 + 1e-7) as double) / {scale})"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


CATALOG_CTE = """
catalog AS (
  SELECT cast(l_partkey AS varchar)                                AS product_id,
         concat(p_name, ' #', cast(l_partkey AS varchar))          AS product_name,
         CASE WHEN p_size % 3 = 0 THEN p_type
              WHEN p_size % 3 = 1 THEN concat(p_type, '|', p_brand)
              ELSE concat(p_type, '|', p_brand, '|', p_name) END   AS category,
         l_extendedprice / 10e0                                    AS actual_price,
         round(l_discount * 700e0, 0) + 0e0                        AS discount_percentage,
         (l_extendedprice / 10e0) * (1e0 - round(l_discount * 700e0, 0) / 100e0) AS discounted_price,
         CASE WHEN l_orderkey % 50 = 0 THEN NULL
              ELSE 1e0 + cast((l_partkey * 7 + l_linenumber * 3) % 41 AS double) / 10e0 END AS rating,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL
              ELSE cast((l_orderkey * 13 + l_partkey) % 50000 AS bigint) END AS rating_count,
         concat(cast(l_orderkey AS varchar), '-', cast(l_linenumber AS varchar)) AS review_id,
         l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part_key, l_suppkey AS supp_key,
         cast(o_custkey AS varchar) AS user_id, c_name AS user_name,
         cast(length(d.text) AS bigint) AS description_length_raw,
         d.text AS doc_text
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN documents d ON d.doc_id = p_partkey
)"""

ENRICHED_CTE = CATALOG_CTE + """,
enriched AS (
  SELECT *,
         CASE WHEN category IS NULL OR category = '' THEN 'Unknown'
              ELSE """ + _strip("split_part(category, '|', 1)") + """ END AS main_category,
         CASE WHEN category IS NULL OR category = '' THEN 'Unknown'
              WHEN len(string_split(category, '|')) > 1 THEN """ + _strip("split_part(category, '|', 2)") + """
              ELSE """ + _strip("split_part(category, '|', 1)") + """ END AS sub_category,
         CASE WHEN category IS NULL OR category = '' THEN 0
              ELSE cast(len(string_split(category, '|')) AS integer) END AS category_depth,
         cast(coalesce(length(product_name), 0) AS bigint) AS name_length,
         coalesce(description_length_raw, 0) AS description_length,
         CASE WHEN doc_text IS NULL OR doc_text = '' THEN 0
              ELSE cast(len(list_filter(string_split(doc_text, ','), lambda x: regexp_matches(x, '\\S'))) AS bigint)
         END AS review_text_count,
         CASE WHEN coalesce(actual_price, 0e0) > 0e0 AND coalesce(actual_price, 0e0) <= 500e0 THEN 'budget'
              WHEN coalesce(actual_price, 0e0) > 500e0 AND coalesce(actual_price, 0e0) <= 2000e0 THEN 'mid'
              WHEN coalesce(actual_price, 0e0) > 2000e0 AND coalesce(actual_price, 0e0) <= 10000e0 THEN 'premium'
              WHEN coalesce(actual_price, 0e0) > 10000e0 THEN 'luxury'
              ELSE 'unknown' END AS price_tier,
         ln(1e0 + cast(coalesce(rating_count, 0) AS double)) AS rating_count_log
  FROM catalog
  WHERE actual_price IS NOT NULL AND discount_percentage IS NOT NULL
)"""


def with_enriched(body: str) -> str:
    """``WITH catalog AS (...), enriched AS (...) <body>``."""
    return "WITH " + ENRICHED_CTE + "\n" + body


def with_ctes(extra: str, body: str) -> str:
    """Enriched CTEs plus more CTEs (``extra`` starts with the next name)."""
    return "WITH " + ENRICHED_CTE + ",\n" + extra + "\n" + body
