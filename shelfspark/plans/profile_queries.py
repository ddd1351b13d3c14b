"""Registered profile (EDA) queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.constants import CORRELATION_COLUMNS
from shelfspark.operators import profile as P
from shelfspark.operators.insights import dedupe_reviews
from shelfspark.plans.frames import enriched
from shelfspark.plans.registry import query
from shelfspark.plans.sql import R2, with_ctes, with_enriched
from shelfspark.session import shared_dir
from shelfspark.sources.catalog import catalog_view

# enriched catalog (users=True) column -> Spark type, for the schema-driven oracles
ENRICHED_TYPES = {
    "product_id": "string", "product_name": "string", "category": "string",
    "actual_price": "double", "discount_percentage": "double", "discounted_price": "double",
    "rating": "double", "rating_count": "bigint", "review_id": "string",
    "order_key": "bigint", "line_number": "int", "part_key": "bigint", "supp_key": "bigint",
    "user_id": "string", "user_name": "string",
    "description_length": "bigint", "review_text_count": "bigint",
    "main_category": "string", "sub_category": "string", "category_depth": "int",
    "name_length": "bigint", "price_tier": "string", "rating_count_log": "double",
}
CATALOG_COLUMNS = ["product_id", "product_name", "category", "actual_price", "discount_percentage",
                   "discounted_price", "rating", "rating_count", "review_id", "order_key", "line_number",
                   "part_key", "supp_key", "user_id", "user_name"]


def _stats_sql(cols, stats=("min", "max", "mean", "median", "std"), pcts=(), src="enriched", digits=2):
    fn = {"min": "min({c})", "max": "max({c})", "mean": "avg({c})", "median": "quantile_cont({c}, 0.5)",
          "std": "stddev_samp({c})"}
    parts = []
    for c in cols:
        sel = [f"'{c}' AS \"column\""]
        sel += [f"{R2('cast(' + fn[s].format(c=c) + ' AS double)', digits)} AS {s}" for s in stats]
        sel += [f"{R2(f'quantile_cont({c}, {q})', digits)} AS p{int(round(q * 100))}" for q in pcts]
        parts.append(f"SELECT {', '.join(sel)} FROM {src}")
    return "\nUNION ALL\n".join(parts)


def _hist_sql(expr, edges, labels, src="enriched"):
    cases = " ".join(f"WHEN x > {float(edges[i])}e0 AND x <= {float(edges[i + 1])}e0 THEN {i}"
                     if edges[i + 1] != float("inf") else f"WHEN x > {float(edges[i])}e0 THEN {i}"
                     for i in range(len(labels)))
    bins = " UNION ALL ".join(f"SELECT {i} AS bin_no, '{lab}' AS bin" for i, lab in enumerate(labels))
    return (f"bins AS ({bins}), b AS (SELECT CASE {cases} END AS bin_no FROM (SELECT {expr} AS x FROM {src})),"
            f" cnt AS (SELECT bin_no, count(*) AS n FROM b WHERE bin_no IS NOT NULL GROUP BY bin_no)",
            "SELECT cast(bins.bin_no AS integer) AS bin_no, bins.bin, cast(coalesce(cnt.n, 0) AS bigint) AS n "
            "FROM bins LEFT JOIN cnt ON bins.bin_no = cnt.bin_no")


def _hist_query(edges, labels, expr):
    extra, body = _hist_sql(expr, edges, labels)
    return with_ctes(extra, body)


@query("dataset_info", oracle=with_enriched(
    "SELECT count(*) AS total_products, cast(21 AS bigint) AS total_features FROM enriched"))
def q_dataset_info(spark, sf_dir):
    return P.dataset_info(enriched(spark, sf_dir)).select("total_products", "total_features")


@query("category_distribution", oracle=with_ctes("""
c AS (SELECT 'main' AS level, main_category AS category, count(*) AS n FROM enriched GROUP BY 2
      UNION ALL SELECT 'sub' AS level, sub_category AS category, count(*) AS n FROM enriched GROUP BY 2),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY level ORDER BY n DESC, category) AS integer) AS rank,
             count(*) OVER (PARTITION BY level) AS unique_count FROM c)""",
    "SELECT level, category, n, rank, unique_count FROM r WHERE rank <= 15"))
def q_category_distribution(spark, sf_dir):
    return P.category_distribution(enriched(spark, sf_dir))


@query("value_counts_topk", oracle=with_enriched(
    "SELECT main_category, count(*) AS n FROM enriched GROUP BY 1 ORDER BY n DESC, main_category LIMIT 10"))
def q_value_counts_topk(spark, sf_dir):
    return P.value_counts(enriched(spark, sf_dir), "main_category", 10)


@query("price_tier_counts", oracle=with_enriched(
    "SELECT price_tier, count(*) AS n FROM enriched GROUP BY 1"))
def q_price_tier_counts(spark, sf_dir):
    return P.price_tier_counts(enriched(spark, sf_dir))


@query("category_depth_stats", oracle=with_ctes(
    "h AS (SELECT category_depth, count(*) AS n FROM enriched GROUP BY 1)",
    f"""SELECT category_depth, n, min(category_depth) OVER () AS min_depth, max(category_depth) OVER () AS max_depth,
           {R2('cast(sum(category_depth * n) OVER () AS double) / cast(sum(n) OVER () AS double)')} AS mean_depth
    FROM h"""))
def q_category_depth_stats(spark, sf_dir):
    return P.category_depth_stats(enriched(spark, sf_dir))


@query("price_stats", oracle=with_enriched(
    _stats_sql(["actual_price", "discounted_price"], pcts=(0.25, 0.5, 0.75, 0.9, 0.99))))
def q_price_stats(spark, sf_dir):
    return P.price_stats(enriched(spark, sf_dir))


@query("price_histogram", oracle=_hist_query(
    [0, 500, 1000, 2000, 5000, 10000, 50000, float("inf")],
    ["0-500", "500-1K", "1K-2K", "2K-5K", "5K-10K", "10K-50K", "50K+"], "coalesce(actual_price, 0e0)"))
def q_price_histogram(spark, sf_dir):
    return P.price_histogram(enriched(spark, sf_dir))


@query("rating_stats", oracle=with_enriched(_stats_sql(["rating"])))
def q_rating_stats(spark, sf_dir):
    return P.rating_stats(enriched(spark, sf_dir))


@query("rating_histogram", oracle=_hist_query(
    [0, 1, 2, 3, 4, 4.5, 5.01], ["0-1", "1-2", "2-3", "3-4", "4-4.5", "4.5-5"], "rating"))
def q_rating_histogram(spark, sf_dir):
    return P.rating_histogram(enriched(spark, sf_dir))


@query("rating_count_stats", oracle=with_enriched(f"""
SELECT min(rating_count) AS min, max(rating_count) AS max, {R2('avg(rating_count)')} AS mean,
       {R2('quantile_cont(rating_count, 0.5)')} AS median, cast(sum(rating_count) AS bigint) AS total_reviews
FROM enriched"""))
def q_rating_count_stats(spark, sf_dir):
    return P.rating_count_stats(enriched(spark, sf_dir))


@query("discount_stats", oracle=with_enriched(_stats_sql(["discount_percentage"])))
def q_discount_stats(spark, sf_dir):
    return P.discount_stats(enriched(spark, sf_dir))


@query("discount_histogram", oracle=_hist_query(
    [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 101],
    ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50-60%", "60-70%", "70-80%", "80-90%", "90-100%"],
    "discount_percentage"))
def q_discount_histogram(spark, sf_dir):
    return P.discount_histogram(enriched(spark, sf_dir))


@query("discount_by_category", oracle=with_enriched(f"""
SELECT main_category, {R2('avg(discount_percentage)')} AS mean_discount,
       {R2('quantile_cont(discount_percentage, 0.5)')} AS median_discount, count(discount_percentage) AS n
FROM enriched WHERE main_category IS NOT NULL GROUP BY main_category"""))
def q_discount_by_category(spark, sf_dir):
    return P.discount_by_category(enriched(spark, sf_dir))


@query("text_length_stats", oracle=with_enriched(
    _stats_sql(["name_length", "description_length"], stats=("min", "max", "mean", "median"))))
def q_text_length_stats(spark, sf_dir):
    return P.text_length_stats(enriched(spark, sf_dir))


def _missing_sql(types: dict[str, str], src: str) -> str:
    miss = {c: (f"({c} IS NULL OR isnan({c}))" if t == "double" else f"{c} IS NULL") for c, t in types.items()}
    any_m = " OR ".join(miss.values())
    sel = ", ".join(f"count(*) FILTER (WHERE {m}) AS m_{c}" for c, m in miss.items())
    rows = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", m_{c} AS n_missing, total, complete FROM w"
                              for c in types)
    return (f"w AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT ({any_m})) AS complete, {sel} FROM {src}),"
            f" r AS ({rows})",
            f"""SELECT "column", n_missing, {R2('n_missing * 100e0 / total')} AS pct_missing,
                   complete AS complete_rows, {R2('complete * 100e0 / total')} AS complete_pct
            FROM r WHERE n_missing > 0""")


_mx, _mb = _missing_sql(ENRICHED_TYPES, "enriched")


@query("missing_values", oracle=with_ctes(_mx, _mb))
def q_missing_values(spark, sf_dir):
    df = enriched(spark, sf_dir, users=True).select(*ENRICHED_TYPES)
    return P.missing_values(df)


def _null_counts_sql() -> str:
    types = {c: ENRICHED_TYPES[c] for c in CATALOG_COLUMNS}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM catalog"
        for c, t in types.items())


@query("null_counts", oracle=with_enriched(_null_counts_sql()))
def q_null_counts(spark, sf_dir):
    return P.null_counts(catalog_view(spark, sf_dir, users=True).select(*CATALOG_COLUMNS))


def _corr_sql(cols=CORRELATION_COLUMNS) -> str:
    aggs, rows = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            aggs.append(f"corr(cast({a} AS double), cast({b} AS double)) AS r_{i}_{j}")
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            key = f"r_{min(i, j)}_{max(i, j)}"
            v = (f"CASE WHEN {key} IS NULL OR isnan({key}) THEN NULL "
                 + ("ELSE 1e0 END" if i == j else f"ELSE greatest(-1e0, least(1e0, {key})) END"))
            rows.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {R2(v, 3)} AS r FROM m")
    return f"m AS (SELECT {', '.join(aggs)} FROM enriched)", " UNION ALL ".join(rows)


_cx, _cb = _corr_sql()


@query("correlation_matrix", oracle=with_ctes(_cx, _cb))
def q_correlation_matrix(spark, sf_dir):
    return P.correlation_matrix(enriched(spark, sf_dir))


@query("target_correlations", oracle=with_ctes(_cx + f", cm AS ({_cb})",
    "SELECT column_b AS feature, r FROM cm WHERE column_a = 'discount_percentage' "
    "AND column_b <> 'discount_percentage'"))
def q_target_correlations(spark, sf_dir):
    return P.target_correlations(enriched(spark, sf_dir))


@query("category_summary", oracle=with_enriched(f"""
SELECT main_category, count(*) AS product_count, {R2('avg(actual_price)')} AS avg_price,
       {R2('avg(discount_percentage)')} AS avg_discount, {R2('avg(rating)')} AS avg_rating,
       cast(sum(rating_count) AS bigint) AS total_reviews, count(DISTINCT sub_category) AS sub_categories,
       {R2('min(actual_price)')} AS price_min, {R2('max(actual_price)')} AS price_max,
       cast(NULL AS varchar) AS error
FROM enriched GROUP BY main_category"""))
def q_category_summary(spark, sf_dir):
    return P.category_summary(enriched(spark, sf_dir))


@query("filter_category", oracle=with_enriched(f"""
SELECT main_category, count(*) AS product_count, {R2('avg(actual_price)')} AS avg_price,
       {R2('avg(discount_percentage)')} AS avg_discount, {R2('avg(rating)')} AS avg_rating,
       cast(sum(rating_count) AS bigint) AS total_reviews, count(DISTINCT sub_category) AS sub_categories,
       {R2('min(actual_price)')} AS price_min, {R2('max(actual_price)')} AS price_max,
       cast(NULL AS varchar) AS error
FROM enriched WHERE main_category = 'STANDARD' GROUP BY main_category
UNION ALL
SELECT 'NoSuchCategory', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Category ''NoSuchCategory'' not found'"""))
def q_filter_category(spark, sf_dir):
    df = enriched(spark, sf_dir)
    return P.category_summary(df, "STANDARD").unionByName(P.category_summary(df, "NoSuchCategory"))


@query("distinct_main_categories", oracle=with_enriched(
    "SELECT count(DISTINCT main_category) AS main_categories, count(DISTINCT sub_category) AS sub_categories "
    "FROM enriched"))
def q_distinct_main_categories(spark, sf_dir):
    return P.distinct_main_categories(enriched(spark, sf_dir))


_DESCRIBE = ["discounted_price", "actual_price", "discount_percentage", "rating", "rating_count"]


@query("describe_numeric", oracle=with_enriched(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, {R2(f'avg({c})')} AS mean, {R2(f'stddev_samp({c})')} AS std,
        {R2(f'cast(min({c}) AS double)')} AS min, {R2(f'quantile_cont({c}, 0.25)')} AS p25,
        {R2(f'quantile_cont({c}, 0.5)')} AS p50, {R2(f'quantile_cont({c}, 0.75)')} AS p75,
        {R2(f'cast(max({c}) AS double)')} AS max FROM catalog""" for c in _DESCRIBE)))
def q_describe_numeric(spark, sf_dir):
    return P.describe_numeric(catalog_view(spark, sf_dir), _DESCRIBE)


_HEAD_COLS = ["product_id", "product_name", "category", "actual_price", "discounted_price",
              "discount_percentage", "rating", "rating_count", "review_id"]


@query("head_rows", oracle=with_enriched(
    f"SELECT {', '.join(_HEAD_COLS)} FROM catalog "
    "ORDER BY order_key, line_number, part_key, supp_key, actual_price LIMIT 5"))
def q_head_rows(spark, sf_dir):
    df = catalog_view(spark, sf_dir)
    return P.head_rows(df, 5, ["order_key", "line_number", "part_key", "supp_key", "actual_price"]).select(*_HEAD_COLS)


@query("duplicate_counts", oracle=with_enriched("""
SELECT 'product_id' AS key_column,
       count(*) - count(DISTINCT product_id) - CASE WHEN count(*) FILTER (WHERE product_id IS NULL) > 0 THEN 1 ELSE 0 END
         AS duplicates FROM catalog
UNION ALL
SELECT 'review_id', count(*) - count(DISTINCT review_id)
       - CASE WHEN count(*) FILTER (WHERE review_id IS NULL) > 0 THEN 1 ELSE 0 END FROM catalog"""))
def q_duplicate_counts(spark, sf_dir):
    from shelfspark.operators.quality import duplicate_counts
    return duplicate_counts(catalog_view(spark, sf_dir), ["product_id", "review_id"])


@query("dedupe_reviews", oracle=with_enriched(
    f"SELECT {', '.join(CATALOG_COLUMNS)} FROM catalog QUALIFY row_number() OVER "
    "(PARTITION BY review_id ORDER BY order_key, line_number, part_key, supp_key, actual_price) = 1"))
def q_dedupe_reviews(spark, sf_dir):
    return dedupe_reviews(catalog_view(spark, sf_dir, users=True).select(*CATALOG_COLUMNS))


def _summary_sql() -> str:
    cols = ["actual_price", "discounted_price", "discount_percentage", "rating", "rating_count"]
    fn = {"min": "min({c})", "max": "max({c})", "mean": "avg({c})", "median": "quantile_cont({c}, 0.5)",
          "std": "stddev_samp({c})"}
    parts = [
        "SELECT 'counts' AS section, 'total_products' AS key, cast(count(*) AS double) AS value FROM enriched",
        "SELECT 'counts', 'main_categories', cast(count(DISTINCT main_category) AS double) FROM enriched",
        "SELECT 'counts', 'sub_categories', cast(count(DISTINCT sub_category) AS double) FROM enriched",
        "SELECT 'top_categories', main_category, cast(n AS double) FROM (SELECT main_category, count(*) AS n "
        "FROM enriched GROUP BY 1 ORDER BY n DESC, main_category LIMIT 10)",
    ]
    for c in cols:
        for s, f in fn.items():
            parts.append(f"SELECT 'stats', '{c}.{s}', {R2('cast(' + f.format(c=c) + ' AS double)')} FROM enriched")
        parts.append(f"SELECT 'missing', '{c}', cast(count(*) FILTER (WHERE {c} IS NULL) AS double) FROM enriched "
                     f"HAVING count(*) FILTER (WHERE {c} IS NULL) > 0")
    return " UNION ALL ".join(parts)


@query("dataset_summary", oracle=with_enriched(_summary_sql()))
def q_dataset_summary(spark, sf_dir):
    return P.dataset_summary(enriched(spark, sf_dir))


def _full_sql() -> str:
    tiers = f"SELECT 'price_tiers' AS section, price_tier AS key, cast(count(*) AS double) AS value FROM enriched GROUP BY 2"
    cats = " UNION ALL ".join(
        f"SELECT 'categories', main_category || '.{k}', {R2(f'cast({x} AS double)')} FROM enriched GROUP BY main_category"
        for k, x in (("product_count", "count(*)"), ("avg_price", "avg(actual_price)"), ("avg_discount", "avg(discount_percentage)"),
                     ("avg_rating", "avg(rating)"), ("total_reviews", "sum(rating_count)"),
                     ("sub_categories", "count(DISTINCT sub_category)"), ("price_min", "min(actual_price)"),
                     ("price_max", "max(actual_price)")))
    texts = " UNION ALL ".join(
        f"SELECT 'texts', '{c}.{k}', {R2(f'cast({f}({c}) AS double)')} FROM enriched"
        for c in ("name_length", "description_length", "review_text_count") for k, f in (("min", "min"), ("max", "max"), ("mean", "avg")))
    cols = ["actual_price", "discounted_price", "discount_percentage", "rating", "rating_count", "category_depth",
            "name_length", "description_length", "rating_count_log"]
    corr = " UNION ALL ".join(
        f"SELECT 'correlations', '{a}|{b}', {R2(f'greatest(-1e0, least(1e0, covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL), 0e0)))', 3)} FROM enriched"
        for i, a in enumerate(cols) for b in cols[i + 1:])
    return f"{_summary_sql()} UNION ALL {tiers} UNION ALL {cats} UNION ALL {texts} UNION ALL {corr}"


@query("full_summary", oracle=with_enriched(_full_sql()))
def q_full_summary(spark, sf_dir):
    """Every section: counts, top categories, stats, missing, price tiers, categories, texts, correlations."""
    from shelfspark.operators.summary import full_summary
    return full_summary(enriched(spark, sf_dir))


@query("summary_view", oracle=with_enriched(_full_sql()))
def q_summary_view(spark, sf_dir):
    """The same sections from per-file states: one load of catalog files, a refresh, the other loads, a refresh."""
    from shelfspark.operators.summary_view import COLUMNS, refresh_summary
    folder = shared_dir(spark, "summary_view", unique=True)
    rows = enriched(spark, sf_dir)
    first = F.coalesce(F.col("line_number") <= 2, F.lit(True))
    for load in (first, ~first):
        rows.where(load).select(*COLUMNS).write.mode("append").parquet(f"{folder}/catalog")
        done = refresh_summary(spark, f"{folder}/catalog", f"{folder}/view")
    return done.summary


_TOP_COLS = ["product_id", "product_name", "main_category", "rating", "actual_price", "discount_percentage",
             "rating_count"]


_TOP_CASES = [(by, None) for by in ("rating", "discount_percentage", "rating_count", "actual_price")] + [
    (by, "STANDARD") for by in ("rating", "actual_price")]


def _top_sql(by: str, category: str | None) -> str:
    where = f"WHERE main_category = '{category}'" if category else ""
    return (f"(SELECT '{by}' AS metric, '{category or 'all'}' AS scope, product_id, product_name, main_category, "
            f"{R2('rating')} AS rating, {R2('actual_price')} AS actual_price, {R2('discount_percentage')} AS discount_percentage, "
            f"rating_count FROM enriched {where} ORDER BY {by} DESC NULLS LAST, product_id, order_key, line_number, supp_key LIMIT 10)")


@query("top_products", oracle=with_enriched(" UNION ALL ".join(_top_sql(*c) for c in _TOP_CASES)))
def q_top_products(spark, sf_dir):
    """The top ten by each metric, and within one category by two of them."""
    df = enriched(spark, sf_dir)
    out = None
    for by, category in _TOP_CASES:
        part = P.top_products(df, by, 10, category).select(F.lit(by).alias("metric"), F.lit(category or "all").alias("scope"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("sort_bins", oracle=with_enriched("""SELECT cast(row_number() OVER (ORDER BY lo) AS integer) AS place, bin, n FROM (
    SELECT least(floor((discount_percentage - 1e-9) / 10e0), 9) AS lo,
           min(CASE WHEN discount_percentage > 90 THEN '90-100%' ELSE
               cast(cast(floor((discount_percentage - 1e-9) / 10e0) * 10 AS integer) AS varchar) || '-' ||
               cast(cast(floor((discount_percentage - 1e-9) / 10e0) * 10 + 10 AS integer) AS varchar) || '%' END) AS bin, count(*) AS n
    FROM enriched WHERE discount_percentage > 0 GROUP BY 1)"""))
def q_sort_bins(spark, sf_dir):
    """Histogram bins that have rows, numbered in bin order (not count order)."""
    bins = P.discount_histogram(enriched(spark, sf_dir)).where("n > 0")
    place = Window.orderBy("bin_no")  # one row per bin
    return bins.select(F.row_number().over(place).alias("place"), "bin", "n")
