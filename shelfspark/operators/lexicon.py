"""Sentiment from a lexicon learned of ratings.

* A term's weight is the log-odds of its use in well against badly rated texts,
  with a Dirichlet prior in proportion to the term's overall use, so that a rare
  term needs evidence to leave 0.  The weight is brought to (-1, 1) by tanh(d / 2)
  and kept in millionths, so sums do not depend on their order.
* A term within ``SCOPE`` tokens after a negation counts for the other side, when
  weights are learned and when texts are scored.
* Ratings are first counted per text, so a text under many ratings is read once;
  term counts combine on the map side.  A lexicon of at most ``BROADCAST_TERMS``
  terms (counted) is broadcast, a larger one is joined by term.

Null and empty texts and texts without a term of the lexicon have polarity 0.0;
null and empty ones subjectivity 0.5, the others without such a term 0.0.
Texts without a rating at either end teach nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import is_number_token, tokens
from shelfspark.operators.text import NEGATIONS
from shelfspark.session import materialized

SCOPE = 3
GOOD, BAD = 4.0, 2.0  # ratings from which and up to which a text counts
PRIOR = 1000.0
LEAST_Z = 1.96
BROADCAST_TERMS = 1 << 17
_UNIT = 1_000_000


def text_ratings(rows: DataFrame, key: str, rating: str = "rating", good: float = GOOD, bad: float = BAD) -> DataFrame:
    """(key, good, bad): how many ratings of each text are high, and how many low; texts with neither are left out."""
    r = F.col(rating)
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(r >= good).alias("good"), F.count_if(r <= bad).alias("bad"))
    return counted.where("good + bad > 0")


def scoped_tokens(df: DataFrame, text_col: str, *keep: str, scope: int = SCOPE) -> DataFrame:
    """(keep..., term, negated): a row per word of a text but numbers and negations themselves."""
    if scope < 1:
        raise ValueError("scope must be at least 1")
    words = tokens(F.col(text_col))

    def place(t, i):
        before = [F.coalesce(F.get("_t", i - k).isin(NEGATIONS), F.lit(False)) for k in range(1, scope + 1)]  # null before the first
        return F.struct(t.alias("term"), reduce(Column.__or__, before).alias("negated"))

    placed = df.select(*keep, words.alias("_t")).select(*keep, F.inline(F.transform("_t", place)))
    return placed.where(~F.col("term").isin(NEGATIONS) & ~is_number_token(F.col("term")))


def learn_lexicon(texts: DataFrame, ratings: DataFrame, key: str, text_col: str, prior: float = PRIOR,
                  least_z: float = LEAST_Z, scope: int = SCOPE) -> DataFrame:
    """(term, positive, negative, weight, z) of the terms whose log-odds lie ``least_z`` deviations off 0.

    ``ratings`` as of ``text_ratings``, ``texts`` one row per key.  ``weight`` is in millionths.
    """
    if prior <= 0:
        raise ValueError("the prior must be positive")
    rated = texts.select(key, text_col).join(ratings, key)
    used = scoped_tokens(rated, text_col, "good", "bad", scope=scope)
    own, other = F.when(F.col("negated"), F.col("bad")).otherwise(F.col("good")), F.when(F.col("negated"), F.col("good")).otherwise(F.col("bad"))
    counts = materialized(used.groupBy("term").agg(F.sum(own).alias("positive"), F.sum(other).alias("negative")), "term_ratings")
    total = counts.agg(F.sum("positive"), F.sum("negative")).first()
    p, n = (float(x or 0) for x in total)
    a = (F.col("positive") + F.col("negative")) * F.lit(prior / max(1.0, p + n))
    odds = lambda c, m: F.try_divide(F.col(c) + a, F.lit(m + prior) - F.col(c) - a)
    d = F.ln(odds("positive", p)) - F.ln(odds("negative", n))
    z = F.try_divide(d, F.sqrt(F.try_divide(F.lit(1.0), F.col("positive") + a) + F.try_divide(F.lit(1.0), F.col("negative") + a)))
    weight = F.floor(F.tanh(d / 2) * _UNIT + 0.5).cast("bigint")
    found = counts.select("term", "positive", "negative", weight.alias("weight"), z.alias("z"))
    return found.where(F.abs("z") >= least_z)


def learned_scores(texts: DataFrame, lexicon: DataFrame, key: str, text_col: str, scope: int = SCOPE) -> DataFrame:
    """(key, polarity, subjectivity, hits) of every row of ``texts``, keys unique.

    polarity: mean weight over the text's uses of terms, turned round where
    negated; subjectivity: the mean of the weights' sizes.
    """
    weights = materialized(lexicon.select("term", "weight"), "lexicon")
    used = scoped_tokens(texts, text_col, key, scope=scope)
    side = F.when(F.col("negated"), F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    if weights.count() <= BROADCAST_TERMS:  # words meet their weights where they are cut: a row per text is exchanged
        met = used.select(key, "term", side.alias("net"), F.lit(1).cast("bigint").alias("uses")).join(F.broadcast(weights), "term")
    else:
        met = used.groupBy(key, "term").agg(F.sum(side).alias("net"), F.count(F.lit(1)).alias("uses")).join(weights, "term")
    sums = met.groupBy(key).agg(
        F.sum(F.col("net") * F.col("weight")).alias("_s"), F.sum(F.col("uses") * F.abs("weight")).alias("_a"),
        F.sum("uses").alias("hits"))
    empty = F.col(text_col).isNull() | (F.col(text_col) == "")
    mean = lambda c: F.coalesce(F.col(c) / F.col("hits") / _UNIT, F.lit(0.0))
    out = texts.select(key, empty.alias("_empty")).join(sums, key, "left")
    return out.select(key, mean("_s").alias("polarity"),
                      F.when(F.col("_empty"), F.lit(0.5)).otherwise(mean("_a")).alias("subjectivity"),
                      F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def rating_agreement(scores: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """(ratings, agreeing, opposed, undecided): high and low ratings whose text's polarity has the same sign, the other, or none."""
    s, g, b = F.signum("polarity"), F.col("good"), F.col("bad")
    of = lambda up, down: F.coalesce(F.sum(F.when(s > 0, up).when(s < 0, down).otherwise(F.lit(0))), F.lit(0)).cast("bigint")
    return scores.join(ratings, key).agg(
        F.coalesce(F.sum(g + b), F.lit(0)).alias("ratings"), of(g, b).alias("agreeing"), of(b, g).alias("opposed"),
        F.coalesce(F.sum(F.when(s == 0, g + b).otherwise(F.lit(0))), F.lit(0)).cast("bigint").alias("undecided"))
