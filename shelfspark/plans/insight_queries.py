"""Registered business-question queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.numeric import round_half_up
from shelfspark.operators import insights as I
from shelfspark.plans.frames import questions_frame
from shelfspark.plans.registry import query
from shelfspark.plans.sql import R2, with_ctes

NB_CTE = """nb AS (
  SELECT * REPLACE (coalesce(rating_count, 0) AS rating_count) FROM catalog
  QUALIFY row_number() OVER (PARTITION BY review_id
                             ORDER BY order_key, line_number, part_key, supp_key, actual_price) = 1)"""


def nb(body: str, extra: str = "") -> str:
    return with_ctes(NB_CTE + (",\n" + extra if extra else ""), body)


def _topk_sql(key, metric_sql, alias, k=10, asc=False, where=""):
    order = "ASC" if asc else "DESC"
    w = f"WHERE {where} " if where else ""
    return nb(f"SELECT {key}, {metric_sql} AS {alias} FROM nb {w}GROUP BY {key} "
              f"ORDER BY {alias} {order} NULLS LAST, {key} LIMIT {k}")


@query("top_revenue_products", oracle=_topk_sql("product_name", R2("sum(discounted_price)"), "revenue"))
def q_top_revenue_products(spark, sf_dir):
    return I.top_revenue_products(questions_frame(spark, sf_dir))


@query("top_rated_count_products",
       oracle=_topk_sql("product_name", "cast(sum(rating_count) AS bigint)", "total_rating_count"))
def q_top_rated_count_products(spark, sf_dir):
    return I.top_rated_count_products(questions_frame(spark, sf_dir))


@query("high_rating_low_revenue", oracle=_topk_sql(
    "product_name", R2("sum(discounted_price)"), "revenue", asc=True, where="rating >= 4.5e0"))
def q_high_rating_low_revenue(spark, sf_dir):
    return I.high_rating_low_revenue(questions_frame(spark, sf_dir))


_BANDS = [("excellent", "rating >= 4.5e0", 4.5, None), ("good", "rating >= 4e0", 4.0, None),
          ("poor", "rating <= 2e0", None, 2.0)]


@query("filter_rating_band", oracle=nb(" UNION ALL ".join(
    f"SELECT '{name}' AS band, count(*) AS n, {R2('avg(rating)')} AS avg_rating, {R2('sum(discounted_price)')} AS revenue "
    f"FROM nb WHERE {cond}" for name, cond, _, _ in _BANDS)))
def q_filter_rating_band(spark, sf_dir):
    """Rows, mean rating and revenue of the rating bands ≥ 4.5, ≥ 4 and ≤ 2."""
    df = questions_frame(spark, sf_dir)
    parts = [I.rating_band(df, low, high).agg(F.count(F.lit(1)).alias("n"), round_half_up(F.avg("rating")).alias("avg_rating"),
                                              round_half_up(F.sum("discounted_price")).alias("revenue"))
             .select(F.lit(name).alias("band"), "*") for name, _, low, high in _BANDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("high_discount_low_revenue", oracle=_topk_sql(
    "product_name", R2("sum(discounted_price)"), "revenue", asc=True, where="discount_percentage > 50e0"))
def q_high_discount_low_revenue(spark, sf_dir):
    return I.high_discount_low_revenue(questions_frame(spark, sf_dir))


@query("revenue_by_category", oracle=nb(f"""
(SELECT category, {R2('sum(discounted_price)')} AS revenue, 'best' AS side FROM nb GROUP BY category
 ORDER BY revenue DESC NULLS LAST, category LIMIT 10)
UNION ALL
(SELECT category, {R2('sum(discounted_price)')} AS revenue, 'worst' AS side FROM nb GROUP BY category
 ORDER BY revenue ASC NULLS LAST, category LIMIT 10)"""))
def q_revenue_by_category(spark, sf_dir):
    return I.revenue_by_category(questions_frame(spark, sf_dir))


@query("avg_discount_by_category", oracle=_topk_sql("category", R2("avg(discount_percentage)"), "avg_discount"))
def q_avg_discount_by_category(spark, sf_dir):
    return I.avg_discount_by_category(questions_frame(spark, sf_dir))


_NB_BINS = [0, 10, 20, 30, 40, 50, 60, 100]
_NB_LABELS = ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50-60%", "60-100%"]


@query("revenue_by_discount_bin", oracle=nb(
    f"""SELECT cast(bins.bin_no AS integer) AS bin_no, bins.bin, {R2('coalesce(s.rev, 0e0)')} AS revenue
    FROM bins LEFT JOIN s ON bins.bin_no = s.bin_no""",
    extra="bins AS (" + " UNION ALL ".join(f"SELECT {i} AS bin_no, '{b}' AS bin" for i, b in enumerate(_NB_LABELS))
    + "), s AS (SELECT bin_no, sum(discounted_price) AS rev FROM (SELECT discounted_price, CASE "
    + " ".join(f"WHEN discount_percentage > {_NB_BINS[i]}e0 AND discount_percentage <= {_NB_BINS[i + 1]}e0 THEN {i}"
               for i in range(len(_NB_LABELS)))
    + " END AS bin_no FROM nb) WHERE bin_no IS NOT NULL GROUP BY bin_no)"))
def q_revenue_by_discount_bin(spark, sf_dir):
    return I.revenue_by_discount_bin(questions_frame(spark, sf_dir))


@query("price_vs_discounted", oracle=nb(f"""
SELECT product_name, {R2('avg(actual_price)')} AS avg_actual_price, {R2('avg(discounted_price)')} AS avg_discounted_price
FROM nb GROUP BY product_name ORDER BY avg_actual_price DESC NULLS LAST, product_name LIMIT 15"""))
def q_price_vs_discounted(spark, sf_dir):
    return I.price_vs_discounted(questions_frame(spark, sf_dir))


@query("price_reduction_candidates", oracle=nb(f"""
SELECT product_name, {R2('a')} AS avg_actual_price, {R2('r')} AS revenue, {R2('a / (r + 1e0)', 6)} AS score
FROM (SELECT product_name, avg(actual_price) AS a, sum(discounted_price) AS r FROM nb GROUP BY product_name)
ORDER BY score DESC NULLS LAST, product_name LIMIT 10"""))
def q_price_reduction_candidates(spark, sf_dir):
    return I.price_reduction_candidates(questions_frame(spark, sf_dir))


@query("top_customers_spend", oracle=_topk_sql("user_name", R2("sum(discounted_price)"), "spend"))
def q_top_customers_spend(spark, sf_dir):
    return I.top_customers_spend(questions_frame(spark, sf_dir))


@query("top_reviewers", oracle=_topk_sql("user_name", "count(review_id)", "reviews"))
def q_top_reviewers(spark, sf_dir):
    return I.top_reviewers(questions_frame(spark, sf_dir))


@query("avg_rating_product", oracle=_topk_sql("product_name", R2("avg(rating)"), "avg_rating"))
def q_avg_rating_product(spark, sf_dir):
    return I.avg_rating_product(questions_frame(spark, sf_dir))


@query("avg_rating_category", oracle=_topk_sql("category", R2("avg(rating)"), "avg_rating"))
def q_avg_rating_category(spark, sf_dir):
    return I.avg_rating_category(questions_frame(spark, sf_dir))


@query("repeat_purchases", oracle=nb("""
SELECT user_name, cast(sum(n) AS bigint) AS repeat_count
FROM (SELECT user_name, product_id, count(*) AS n FROM nb GROUP BY 1, 2 HAVING count(*) > 1)
GROUP BY user_name ORDER BY repeat_count DESC NULLS LAST, user_name LIMIT 10"""))
def q_repeat_purchases(spark, sf_dir):
    return I.repeat_purchases(questions_frame(spark, sf_dir))


@query("negative_products", oracle=_topk_sql("product_name", "count(rating)", "negative_reviews",
                                             where="rating <= 2e0"))
def q_negative_products(spark, sf_dir):
    return I.negative_products(questions_frame(spark, sf_dir))


@query("positive_products", oracle=_topk_sql("product_name", "count(rating)", "positive_reviews",
                                             where="rating >= 4e0"))
def q_positive_products(spark, sf_dir):
    return I.positive_products(questions_frame(spark, sf_dir))


@query("low_conversion", oracle=nb(f"""
SELECT product_name, {R2('r')} AS revenue, cast(c AS bigint) AS rating_count,
       {R2('r / (cast(c AS double) + 1e0)', 6)} AS conversion
FROM (SELECT product_name, sum(discounted_price) AS r, sum(rating_count) AS c FROM nb GROUP BY product_name)
ORDER BY conversion ASC NULLS LAST, product_name LIMIT 10"""))
def q_low_conversion(spark, sf_dir):
    return I.low_conversion(questions_frame(spark, sf_dir))


@query("ad_priority", oracle=_topk_sql(
    "product_name", R2("avg(discounted_price / (cast(coalesce(rating_count, 0) AS double) + 1e0))", 6), "ad_score"))
def q_ad_priority(spark, sf_dir):
    return I.ad_priority(questions_frame(spark, sf_dir))


@query("stock_risk", oracle=nb(f"""
SELECT product_name, {R2('revenue')} AS revenue, rating_count FROM ps
WHERE revenue < (SELECT quantile_cont(revenue, 0.25) FROM ps)
  AND cast(rating_count AS double) > (SELECT quantile_cont(cast(rating_count AS double), 0.75) FROM ps)
ORDER BY rating_count DESC NULLS LAST, product_name LIMIT 10""",
    extra="ps AS (SELECT product_name, sum(discounted_price) AS revenue, cast(sum(rating_count) AS bigint) "
          "AS rating_count FROM nb GROUP BY product_name)"))
def q_stock_risk(spark, sf_dir):
    return I.stock_risk(questions_frame(spark, sf_dir))


@query("bundle_pairs", oracle=nb("""
SELECT concat(a, ' + ', b) AS product_pair, a AS item_a, b AS item_b, count(*) AS count
FROM (SELECT x.product_name AS a, y.product_name AS b
      FROM r x JOIN r y ON x.user_id = y.user_id AND x.pos < y.pos)
GROUP BY a, b ORDER BY count DESC, a, b LIMIT 10""",
    extra="r AS (SELECT user_id, product_name, row_number() OVER (PARTITION BY user_id ORDER BY order_key, "
          "line_number, part_key, supp_key, actual_price) AS pos FROM nb WHERE user_id IS NOT NULL)"))
def q_bundle_pairs(spark, sf_dir):
    return I.bundle_pairs(questions_frame(spark, sf_dir, "user_id", "product_name"))


@query("pair_self_join", oracle=nb("""
SELECT a AS item_a, b AS item_b, count(*) AS n
FROM (SELECT x.product_name AS a, y.product_name AS b
      FROM r x JOIN r y ON x.user_id = y.user_id AND x.pos < y.pos)
GROUP BY a, b""",
    extra="r AS (SELECT user_id, product_name, row_number() OVER (PARTITION BY user_id ORDER BY order_key, "
          "line_number, part_key, supp_key, actual_price) AS pos FROM nb WHERE user_id IS NOT NULL)"))
def q_pair_self_join(spark, sf_dir):
    """All ordered item pairs with their counts."""
    return I.ordered_pairs(questions_frame(spark, sf_dir, "user_id", "product_name"))
