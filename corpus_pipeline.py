"""The training-data pipeline: language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import langid, packing, prob_minhash, suffix_dedup
from shelfspark.llm.common import stored
from shelfspark.llm.queries import language_model, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts that are null or without a letter go.

    Ambiguous texts stay.  Without any labelled row no language can be told and
    every text with a letter stays.
    """
    model = language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    return langid.identify_languages(docs, model).where(F.col("lang_pred") != langid.UND).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate class: the smallest id, then the smallest words' hash, text and columns.

    Classes go by row, not by id: rows that share an id and are not near each
    other all stay.  Rows with a null id and texts without words stay; repeated
    rows are one class; an empty table gives no rows.
    """
    return prob_minhash.one_of_each_class(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 100-byte strings; ``n_chars`` is counted anew.

    Bytes of characters that a removed string cut in two go as well.  Null texts
    become empty; repeated rows and rows with a null id are judged like others (a
    null id comes first); an empty table gives no rows.
    """
    found = suffix_dedup.remove_repeats(docs)
    whole = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(whole), whole).otherwise(F.replace(F.make_valid_utf8(whole), F.lit("�"), F.lit("")))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and place.

    A null or empty text is one piece with the end id only; repeated rows and rows
    with a null id are packed each; an empty table gives no rows.
    """
    pieces = packing.piece_step(spark, tokenizer_path(), capacity=2048, end_id=0)
    return packing.best_fit_pack(packing.texts_of(docs), capacity=2048, steps=(pieces,))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_class),
    ("repeated_passages", without_repeats),
    ("packing", packed),
]
#: Word shingles, signatures and merges have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
