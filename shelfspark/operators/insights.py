"""Business questions over the sales catalog (revenue, customers, reviews,
bundles, ads, stock risk).

"Revenue" is ``sum(discounted_price)`` per listing row.  Every top-k orders by
the metric rounded to the reported precision and then by the group key, so
ties are deterministic (there is no input order to fall back on).
Top-k is ``orderBy(...).limit(k)`` → ``TakeOrderedAndProject``: each task keeps
k rows, so the final merge is k × #partitions rows, whatever the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import NB_DISCOUNT_EDGES, NB_DISCOUNT_LABELS
from shelfspark.functions.bins import bins_frame, right_closed_bin
from shelfspark.functions.numeric import round_half_up
from shelfspark.operators.quantiles import quantile_scalar
from shelfspark.session import materialized
from shelfspark.sources.catalog import ROW_ORDER

REV = "discounted_price"


def dedupe_reviews(df: DataFrame, key: str = "review_id", order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """Keep the first row (by ``order``) per ``key``.

    An aggregate (``min_by`` over a struct) rather than a ``row_number``
    window: hash aggregation combines on the map side, so one hot key is
    reduced in every task before the shuffle instead of being sorted in one.
    """
    cols = [c for c in df.columns]
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(first.alias("_r")).select("_r.*")


def notebook_frame(df: DataFrame) -> DataFrame:
    """The question set's input: rating_count null → 0, then one row per review."""
    return dedupe_reviews(df.withColumn("rating_count", F.coalesce(F.col("rating_count"), F.lit(0))))


def top_k(df: DataFrame, metric: str, key: str | Sequence[str], k: int = 10, ascending: bool = False) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    m = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(m, *[F.col(x).asc() for x in keys]).limit(k)


def _sum_by(df: DataFrame, key: str, value: str, alias: str, where: Column | None = None) -> DataFrame:
    src = df.where(where) if where is not None else df
    return src.groupBy(key).agg(round_half_up(F.sum(value)).alias(alias))


def top_revenue_products(df: DataFrame, k: int = 10) -> DataFrame:
    return top_k(_sum_by(df, "product_name", REV, "revenue"), "revenue", "product_name", k)


def top_rated_count_products(df: DataFrame, k: int = 10) -> DataFrame:
    agg = df.groupBy("product_name").agg(F.sum("rating_count").cast("bigint").alias("total_rating_count"))
    return top_k(agg, "total_rating_count", "product_name", k)


def high_rating_low_revenue(df: DataFrame, k: int = 10, min_rating: float = 4.5) -> DataFrame:
    agg = _sum_by(df, "product_name", REV, "revenue", F.col("rating") >= min_rating)
    return top_k(agg, "revenue", "product_name", k, ascending=True)


def high_discount_low_revenue(df: DataFrame, k: int = 10, min_discount: float = 50.0) -> DataFrame:
    agg = _sum_by(df, "product_name", REV, "revenue", F.col("discount_percentage") > min_discount)
    return top_k(agg, "revenue", "product_name", k, ascending=True)


def revenue_by_category(df: DataFrame, k: int = 10) -> DataFrame:
    """Revenue per full category path: best k and worst k (``side``)."""
    agg = materialized(_sum_by(df, "category", REV, "revenue"), "revenue_by_category")  # one row per category, ranked twice
    best = top_k(agg, "revenue", "category", k).withColumn("side", F.lit("best"))
    worst = top_k(agg, "revenue", "category", k, ascending=True).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def avg_discount_by_category(df: DataFrame, k: int = 10) -> DataFrame:
    agg = df.groupBy("category").agg(round_half_up(F.avg("discount_percentage")).alias("avg_discount"))
    return top_k(agg, "avg_discount", "category", k)


def revenue_by_discount_bin(df: DataFrame) -> DataFrame:
    """Revenue per discount bin (0,10] … (60,100]; empty bins kept as 0."""
    bin_no, _ = right_closed_bin(F.col("discount_percentage"), NB_DISCOUNT_EDGES, NB_DISCOUNT_LABELS)
    sums = (df.select(bin_no.alias("bin_no"), REV).where(F.col("bin_no").isNotNull())
              .groupBy("bin_no").agg(F.sum(REV).alias("_rev")))
    bins = bins_frame(df.sparkSession, NB_DISCOUNT_LABELS)
    return bins.join(sums, "bin_no", "left").select(
        "bin_no", "bin", round_half_up(F.coalesce(F.col("_rev"), F.lit(0.0))).alias("revenue"))


def price_vs_discounted(df: DataFrame, k: int = 15) -> DataFrame:
    agg = df.groupBy("product_name").agg(round_half_up(F.avg("actual_price")).alias("avg_actual_price"),
                                         round_half_up(F.avg(REV)).alias("avg_discounted_price"))
    return top_k(agg, "avg_actual_price", "product_name", k)


def price_reduction_candidates(df: DataFrame, k: int = 10) -> DataFrame:
    """score = mean(actual_price) / (revenue + 1): expensive items that sell little."""
    agg = df.groupBy("product_name").agg(F.avg("actual_price").alias("_a"), F.sum(REV).alias("_r"))
    out = agg.select("product_name", round_half_up(F.col("_a")).alias("avg_actual_price"),
                     round_half_up(F.col("_r")).alias("revenue"),
                     round_half_up(F.col("_a") / (F.col("_r") + F.lit(1.0)), 6).alias("score"))
    return top_k(out, "score", "product_name", k)


def top_customers_spend(df: DataFrame, k: int = 10) -> DataFrame:
    return top_k(_sum_by(df, "user_name", REV, "spend"), "spend", "user_name", k)


def top_reviewers(df: DataFrame, k: int = 10) -> DataFrame:
    agg = df.groupBy("user_name").agg(F.count("review_id").alias("reviews"))
    return top_k(agg, "reviews", "user_name", k)


def avg_rating_product(df: DataFrame, k: int = 10) -> DataFrame:
    agg = df.groupBy("product_name").agg(round_half_up(F.avg("rating")).alias("avg_rating"))
    return top_k(agg, "avg_rating", "product_name", k)


def avg_rating_category(df: DataFrame, k: int = 10) -> DataFrame:
    agg = df.groupBy("category").agg(round_half_up(F.avg("rating")).alias("avg_rating"))
    return top_k(agg, "avg_rating", "category", k)


def repeat_purchases(df: DataFrame, k: int = 10) -> DataFrame:
    """Per user, the number of rows on (user, product) pairs seen more than once."""
    per = (df.groupBy("user_name", "product_id").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1))
    agg = per.groupBy("user_name").agg(F.sum("n").cast("bigint").alias("repeat_count"))
    return top_k(agg, "repeat_count", "user_name", k)


def _count_products(df: DataFrame, cond: Column, alias: str, k: int) -> DataFrame:
    agg = df.where(cond).groupBy("product_name").agg(F.count("rating").alias(alias))
    return top_k(agg, alias, "product_name", k)


def negative_products(df: DataFrame, k: int = 10, max_rating: float = 2.0) -> DataFrame:
    return _count_products(df, F.col("rating") <= max_rating, "negative_reviews", k)


def positive_products(df: DataFrame, k: int = 10, min_rating: float = 4.0) -> DataFrame:
    return _count_products(df, F.col("rating") >= min_rating, "positive_reviews", k)


def low_conversion(df: DataFrame, k: int = 10) -> DataFrame:
    """conversion = revenue / (Σ rating_count + 1), lowest first."""
    agg = df.groupBy("product_name").agg(F.sum(REV).alias("_r"), F.sum("rating_count").alias("_c"))
    out = agg.select("product_name", round_half_up(F.col("_r")).alias("revenue"),
                     F.col("_c").cast("bigint").alias("rating_count"),
                     round_half_up(F.col("_r") / (F.col("_c").cast("double") + F.lit(1.0)), 6).alias("conversion"))
    return top_k(out, "conversion", "product_name", k, ascending=True)


def ad_priority(df: DataFrame, k: int = 10) -> DataFrame:
    """Mean per product of discounted_price / (rating_count + 1)."""
    score = F.col(REV) / (F.coalesce(F.col("rating_count"), F.lit(0)).cast("double") + F.lit(1.0))
    agg = df.groupBy("product_name").agg(round_half_up(F.avg(score), 6).alias("ad_score"))
    return top_k(agg, "ad_score", "product_name", k)


def stock_risk(df: DataFrame, k: int = 10, low_q: float = 0.25, high_q: float = 0.75,
               exact: bool = True) -> DataFrame:
    """Products whose revenue is below the ``low_q`` quantile of product
    revenue while their rating count is above the ``high_q`` quantile.

    The two thresholds are scalar subqueries over the per-product table (one
    value each) over the per-product table, which is written once and read by
    both and by the filter; no join is needed to attach them.
    """
    stats = materialized(df.groupBy("product_name").agg(
        F.sum(REV).alias("revenue"), F.sum("rating_count").cast("bigint").alias("rating_count")), "product_totals")
    if exact:
        rev_q, cnt_q = quantile_scalar(stats, "revenue", low_q), quantile_scalar(stats, "rating_count", high_q)
    else:
        rev_q = stats.select(F.percentile_approx("revenue", F.lit(low_q), 100000)).scalar()
        cnt_q = stats.select(F.percentile_approx(F.col("rating_count").cast("double"), F.lit(high_q), 100000)).scalar()
    risky = stats.where((F.col("revenue") < rev_q) & (F.col("rating_count").cast("double") > cnt_q))
    out = risky.select("product_name", round_half_up(F.col("revenue")).alias("revenue"), "rating_count")
    return top_k(out, "rating_count", "product_name", k)


# ---------------------------------------------------------------- bundles


def ordered_pairs(df: DataFrame, user: str = "user_id", item: str = "product_name",
                  order: Sequence[str] = ROW_ORDER, block_rows: int = 256, item_rows: int = 1 << 17) -> DataFrame:
    """(item_a, item_b, n): how often a user has a row of ``item_a`` before one of ``item_b``.

    Equal rows are counted first and written once.  Every user's rows are dealt
    into blocks by a hash of the row, about ``block_rows`` each; a row meets the
    lists of its user's blocks by an equi-join on (user, block pair), so a user
    with many rows becomes many bounded groups, spread over the cluster.  What is
    exchanged is a row with the list of the items that follow it; the pairs are
    formed and counted where all rows of ``item_a`` lie.  An item of more than
    ``item_rows`` rows is dealt into parts by the item that follows.
    """
    rows = df.where(F.col(user).isNotNull()).select(
        F.col(user).alias("u"), F.col(item).alias("i"), F.struct(*[F.col(c) for c in order]).alias("pos"))
    cells = materialized(rows.groupBy("u", "i", "pos").agg(F.count(F.lit(1)).alias("c")), "pair_rows")
    sizes = cells.groupBy("u").agg((F.floor((F.count(F.lit(1)) - 1) / block_rows) + 1).cast("int").alias("blocks"))
    dealt = cells.join(sizes, "u").withColumn("b", F.pmod(F.xxhash64("i", "pos"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = dealt.select("u", F.col("b").alias("b1"), F.explode(every).alias("b2"), F.col("i").alias("item_a"),
                        F.col("pos").alias("p1"), F.col("c").alias("times"))
    lists = dealt.groupBy("u", "b", "blocks").agg(F.collect_list(F.struct("pos", "i", "c")).alias("others"))  # about block_rows each
    right = lists.select("u", F.explode(every).alias("b1"), F.col("b").alias("b2"), "others")
    after = F.filter("others", lambda x: x["pos"] > F.col("p1"))
    met = left.join(right.hint("merge"), ["u", "b1", "b2"]).select("item_a", "times", after.alias("after")).where(F.size("after") > 0)
    once = F.transform(F.filter("after", lambda x: x["c"] == 1), lambda x: x["i"])
    often = F.transform(F.filter("after", lambda x: x["c"] > 1), lambda x: F.struct(x["i"].alias("item_b"), x["c"].alias("c")))
    met = met.select("item_a", "times", once.alias("once"), often.alias("often"))
    # rows that are equal in the order columns are pairs too: c·(c−1)/2 of one place and item
    itself = F.array(F.struct(F.col("i").alias("item_b"), (F.col("c") * (F.col("c") - 1) / 2).cast("bigint").alias("c")))
    met = met.unionByName(cells.where("c > 1").select(
        F.col("i").alias("item_a"), F.lit(1).cast("bigint").alias("times"), F.array().cast(f"array<{dict(cells.dtypes)['i']}>").alias("once"), itself.alias("often")))
    hot = cells.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / item_rows).cast("int").alias("parts")).where("parts > 1")
    dealt_to = met.join(F.broadcast(hot), met["item_a"].eqNullSafe(hot["i"]), "left").drop("i").withColumn(  # a row per item_rows rows
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    mine = lambda item_b: F.pmod(F.xxhash64(item_b), F.col("parts")) == F.col("part")
    held = dealt_to.select(
        "item_a", "part", "times",
        F.when(F.col("parts").isNull(), F.col("once")).otherwise(F.filter("once", mine)).alias("once"),
        F.when(F.col("parts").isNull(), F.col("often")).otherwise(F.filter("often", lambda x: mine(x["item_b"]))).alias("often"))
    placed = held.repartition("item_a", "part")
    pairs = placed.select("item_a", "part", "times", F.inline(F.concat(
        F.transform("once", lambda i: F.struct(i.alias("item_b"), F.lit(1).cast("bigint").alias("c"))), F.col("often"))))
    return (pairs.groupBy("item_a", "part", "item_b").agg(F.sum(F.col("times") * F.col("c")).cast("bigint").alias("n"))
                 .select("item_a", "item_b", "n"))


def bundle_pairs(df: DataFrame, k: int = 10, user: str = "user_id", item: str = "product_name",
                 order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """The ``k`` most frequent ordered item pairs (earlier row, later row) of one user, counted over all users.

    Items are numbered in their order, and the pairs are pairs of numbers until the ``k`` are known: what is
    exchanged is a number for each row that follows, not a name.
    """
    rows = df.where(F.col(user).isNotNull())
    items = materialized(rows.select(F.col(item).alias("_name")).distinct().orderBy("_name").select(
        "_name", F.monotonically_increasing_id().alias("_item")), "pair_items")  # in sorted ranges: numbers rise with names
    numbered = rows.join(items, F.col(item).eqNullSafe(F.col("_name"))).select(user, "_item", *[c for c in order if c != user])
    pairs = ordered_pairs(numbered, user, "_item", order).orderBy(F.desc("n"), "item_a", "item_b").limit(k)
    names = lambda c: items.select(F.col("_item").alias(c), F.col("_name").alias(f"{c}_name"))
    named = F.broadcast(materialized(pairs, "top_pairs"))  # k rows
    named = F.broadcast(names("item_a").join(named, "item_a"))
    return (names("item_b").join(named, "item_b").select(F.col("item_a_name").alias("item_a"), F.col("item_b_name").alias("item_b"), "n")
                           .orderBy(F.desc("n"), "item_a", "item_b")
                           .select(F.concat_ws(" + ", "item_a", "item_b").alias("product_pair"), "item_a", "item_b",
                                   F.col("n").alias("count")))


def rating_band(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with low <= rating <= high (an open end where None)."""
    out = df if low is None else df.where(F.col("rating") >= low)
    return out if high is None else out.where(F.col("rating") <= high)
