"""Text operators: term counts, lexicon sentiment, RAG documents.

Scale notes
* Texts are tokenised once per *document*; when many catalog rows share a
  document (one product text, many review rows), the rows are first counted
  per document and the count is carried as a weight — the token work does not
  grow with the number of rows.
* Stop-word and lexicon tables are fixed, small lists; they are broadcast
  (their size does not grow with the data).
* Token positions come from ``posexplode``; the previous token (for
  negation) is read inside the token array, so no window is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.constants import DOMAIN_STOPWORDS
from shelfspark.functions.text import ENGLISH_STOPWORDS, is_number_token, tokens

# FIXED VALUES — sentiment lexicon: word, polarity (-1..1), subjectivity (0..1).
LEXICON = [
    ("amazing", 0.6, 0.9), ("awesome", 1.0, 1.0), ("awful", -1.0, 1.0), ("bad", -0.7, 0.667),
    ("beautiful", 0.85, 1.0), ("best", 1.0, 0.3), ("better", 0.5, 0.5), ("boring", -1.0, 1.0),
    ("broken", -0.4, 0.4), ("cheap", 0.4, 0.7), ("comfortable", 0.4, 0.7), ("cool", 0.35, 0.65),
    ("damaged", -0.5, 0.5), ("defective", -0.6, 0.6), ("disappointed", -0.75, 0.75),
    ("disappointing", -0.6, 0.7), ("easy", 0.433, 0.833), ("excellent", 1.0, 1.0),
    ("fantastic", 0.4, 0.9), ("fast", 0.2, 0.6), ("fine", 0.417, 0.5), ("flimsy", -0.5, 0.7),
    ("good", 0.7, 0.6), ("great", 0.8, 0.75), ("happy", 0.8, 1.0), ("hate", -0.8, 0.9),
    ("horrible", -1.0, 1.0), ("love", 0.5, 0.6), ("lovely", 0.5, 0.75), ("nice", 0.6, 1.0),
    ("perfect", 1.0, 1.0), ("poor", -0.4, 0.6), ("recommend", 0.3, 0.4), ("sad", -0.5, 1.0),
    ("slow", -0.3, 0.39), ("sturdy", 0.4, 0.6), ("superb", 1.0, 1.0), ("terrible", -1.0, 1.0),
    ("useful", 0.3, 0.0), ("useless", -0.5, 0.2), ("waste", -0.2, 0.3), ("wonderful", 1.0, 1.0),
    ("worse", -0.4, 0.6), ("worst", -1.0, 1.0), ("wrong", -0.5, 0.9),
]
# FIXED VALUES — negation words: a lexicon word right after one of these has
# its polarity multiplied by -0.5.
NEGATIONS = ["not", "never", "no", "n't", "cannot", "don't", "doesn't", "didn't", "isn't", "wasn't"]
NEGATION_FACTOR = -0.5


def stopword_table(spark: SparkSession, extra: Sequence[str] = DOMAIN_STOPWORDS) -> DataFrame:
    """English stop words ∪ domain words (``unionByName().distinct()``)."""
    base = spark.createDataFrame([(w,) for w in ENGLISH_STOPWORDS], "term string")
    more = spark.createDataFrame([(w,) for w in extra], "term string")
    return base.unionByName(more).distinct()


def lexicon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "term string, polarity double, subjectivity double")


def document_tokens(df: DataFrame, id_col: str, text_col: str, weight_col: str | None = None) -> DataFrame:
    """(id, weight, pos, term) — one row per token occurrence."""
    w = F.col(weight_col) if weight_col else F.lit(1)
    return (df.select(F.col(id_col).alias("id"), w.cast("bigint").alias("weight"),
                      F.posexplode(tokens(F.col(text_col))).alias("pos", "term")))


def term_counts(df: DataFrame, id_col: str, text_col: str, weight_col: str | None = None,
                stopwords: DataFrame | None = None) -> DataFrame:
    """Σ weight per term over all documents, stop words and number tokens removed.

    Stop words leave through a broadcast ``left_anti`` join on a fixed table.
    """
    toks = document_tokens(df, id_col, text_col, weight_col).where(~is_number_token(F.col("term")))
    stop = stopwords if stopwords is not None else stopword_table(df.sparkSession)
    kept = toks.join(F.broadcast(stop), "term", "left_anti")
    return kept.groupBy("term").agg(F.sum("weight").cast("bigint").alias("n"))


def top_terms(term_df: DataFrame, k: int | None = None) -> DataFrame:
    """Terms by falling count; ``k`` keeps the first ones, None all."""
    ordered = term_df.orderBy(F.desc("n"), "term")
    return ordered if k is None else ordered.limit(k)


def document_term_counts(texts: DataFrame, key: str = "part_key", text_col: str = "review_content",
                         stopwords: DataFrame | None = None) -> DataFrame:
    """(key, term, n): occurrences of each kept term in each text — the
    tokenisation done once per text, reusable by every question."""
    toks = document_tokens(texts, key, text_col).where(~is_number_token(F.col("term")))
    stop = stopwords if stopwords is not None else stopword_table(texts.sparkSession)
    kept = toks.join(F.broadcast(stop), "term", "left_anti")
    return kept.groupBy(F.col("id").alias(key), "term").agg(F.count(F.lit(1)).alias("n"))


def review_terms(rows: DataFrame, texts: DataFrame | None, cond: Column, k: int | None = None,
                 key: str = "part_key", doc_terms: DataFrame | None = None) -> DataFrame:
    """Most frequent words in the review text of rows matching ``cond``.

    ``rows`` are catalog rows (one per review), ``texts`` one text per ``key``
    (or precomputed ``doc_terms`` from :func:`document_term_counts`).  Rows are
    counted per key first, so a text shared by many rows is tokenised once and
    weighted: Σ over keys of rows(key) × n(key, term).  Texts get their weight
    before they are cut into words: the words combine per term in every task,
    and no (key, term) row is exchanged.
    """
    weights = rows.where(cond).groupBy(key).agg(F.count(F.lit(1)).alias("w"))
    if doc_terms is not None:
        counts = (doc_terms.join(weights, key)
                  .groupBy("term").agg(F.sum(F.col("w") * F.col("n")).cast("bigint").alias("n")))
    else:
        counts = term_counts(texts.select(key, "review_content").join(weights, key), key, "review_content", "w")
    return top_terms(counts, k)


def sentiment_scores(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: polarity (−1..1), subjectivity (0..1) and lexicon hits.

    polarity = mean over lexicon hits (negated hits × −0.5), 0.0 without hits;
    subjectivity = mean over hits, 0.0 without hits.  A null or empty text gets
    polarity 0.0 and subjectivity 0.5.  The whole text is scored.
    """
    words = [w for w, _, _ in LEXICON]
    value = lambda k: F.create_map(*[x for row in LEXICON for x in (F.lit(row[0]), F.lit(float(row[k])))])
    scored = df.select(F.col(id_col), F.col(text_col).alias("_text"), tokens(F.col(text_col)).alias("_t"))
    # each lexicon word with the word before it, read inside the token array: no join, no shuffle
    found = F.filter(F.transform("_t", lambda t, i: F.struct(t.alias("term"), F.when(i > 0, F.get("_t", i - 1)).alias("prev"))),
                     lambda z: z["term"].isin(words))
    scored = scored.withColumn("_h", found)
    negated = lambda z: F.coalesce(z["prev"].isin(NEGATIONS), F.lit(False))
    total = lambda f: F.aggregate("_h", F.lit(0.0), lambda acc, z: acc + f(z))
    polarity = total(lambda z: F.element_at(value(1), z["term"]) * F.when(negated(z), F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0)))
    subjectivity = total(lambda z: F.element_at(value(2), z["term"]))
    hits = F.when(F.col("_h").isNull(), F.lit(0)).otherwise(F.size("_h"))
    empty = F.col("_text").isNull() | (F.col("_text") == "")
    return scored.select(
        F.col(id_col),
        F.when(empty | (hits == 0), F.lit(0.0)).otherwise(polarity / hits).alias("polarity"),
        F.when(empty, F.lit(0.5)).when(hits == 0, F.lit(0.0)).otherwise(subjectivity / hits).alias("subjectivity"),
        F.when(empty, F.lit(0)).otherwise(hits).cast("bigint").alias("hits"))


def add_sentiment(df: DataFrame, texts: DataFrame | None = None, key: str = "part_key") -> DataFrame:
    """Add ``review_sentiment`` (polarity) if absent.

    With ``texts`` (one review text per ``key``), sentiment is scored once per
    text and joined on ``key``; without any text source it is 0.0.
    """
    if "review_sentiment" in df.columns:
        return df
    if texts is None:
        if "review_content" in df.columns:  # scored in the row: no join on texts
            whole = F.struct(*[F.col(c) for c in df.columns])
            s = sentiment_scores(df.select(whole.alias("_row"), "review_content"), "_row", "review_content")
            return s.select("_row.*", F.col("polarity").alias("review_sentiment"))
        return df.withColumn("review_sentiment", F.lit(0.0))
    s = sentiment_scores(texts, key, "review_content").select(key, F.col("polarity").alias("review_sentiment"))
    return (df.join(s, key, "left")
              .withColumn("review_sentiment", F.coalesce("review_sentiment", F.lit(0.0))))
