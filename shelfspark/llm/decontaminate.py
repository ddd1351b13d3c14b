"""Benchmark decontamination: a broadcast set of hashed benchmark word windows, scanned over all documents.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z
lower-cased.  A window is ``size`` consecutive words of a benchmark item; an item
of fewer words is one window of all of them.  Every window of every document is
looked up in a broadcast set of 64-bit hashes; what is found is verified by the
window's words.  A set of more than ``set_rows`` hashes is looked up in parts of
at most that many, one scan each, so what is broadcast has a fixed bound.

Only DataFrame functions are used.  Items of equal words are one class, so that
copies of an item do not multiply the hits.

Edge cases: null, empty and wordless texts have no words and no hits; rows that
share an id are judged each by their own text; repeated rows are all returned;
null ids are kept; an item without an id counts as an item with an empty name;
an empty benchmark hits nothing, no documents give no rows; texts of any length
are scanned whole; other columns are ignored, or kept by ``remove_contamination``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

WINDOW_WORDS = 10
#: Hashes in one broadcast set: 2^22 longs take about 100 MB in an executor.
SET_ROWS = 1 << 22
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased.

    By splitting: ``regexp_extract_all`` copies the text for every match.
    """
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, f"{_GAP}++"), "")


def _windows(df: DataFrame, sizes: Column) -> DataFrame:
    """Rows of ``df`` (with ``words``) once per window: ``size``, ``at`` and the window's hash ``h``."""
    each = df.withColumn("size", F.explode(sizes)).where(F.size("words") >= F.col("size"))
    placed = each.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    return placed.withColumn("h", F.xxhash64("size", F.slice("words", F.col("at") + 1, F.col("size"))))


def _gram() -> Column:
    """The window's words; without a null, so that no null test of it is pushed below the lookup."""
    return F.coalesce(F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " "), F.lit(""))


def benchmark_windows(items: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """(windows: h, size, gram, class; classes: class, item_ids) of a benchmark (item_id, text)."""
    worded = (items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                           words_of(F.col("text")).alias("words")).where("size(words) > 0"))
    classes = (worded.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))
               .withColumn("class", F.sha2(F.array_join("words", " "), 256)))
    windows = _windows(classes.select("class", "words"), F.array(F.least(F.lit(size), F.size("words"))))
    windows = windows.select("h", "size", _gram().alias("gram"), "class").distinct()
    return stored(windows, "benchmark_windows"), classes.select("class", "item_ids")


def _key(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with the text's digest: what is found is joined back by both."""
    return df.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("of_text"), "text")


def _hits(docs: DataFrame, windows: DataFrame, set_rows: int) -> DataFrame:
    """(doc_id, of_text, at, size, class) for every occurrence of a window."""
    hashes = windows.select("h", "size").distinct()
    sizes = sorted(r["size"] for r in hashes.select("size").distinct().collect())  # 1 to the window's size
    held = hashes.select("h").distinct()
    parts = max(1, -(-held.count() // set_rows))
    spread = _windows(_key(docs).select("doc_id", "of_text", words_of(F.col("text")).alias("words")),
                      F.array(*[F.lit(s) for s in sizes]).cast("array<int>"))
    found = None
    for part in range(parts):
        some = held.where(F.pmod("h", F.lit(parts)) == part) if parts > 1 else held  # about set_rows hashes
        one = spread.join(F.broadcast(some), "h").select("doc_id", "of_text", "at", "size", _gram().alias("gram"))
        found = one if found is None else found.unionByName(one)
    return found.join(windows.select("size", "gram", "class"), ["size", "gram"]).select(
        "doc_id", "of_text", "at", "size", "class")


def find_contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, set_rows: int = SET_ROWS
) -> DataFrame:
    """(doc_id, of_text, n_words, n_hit, spans, item_ids) for every row of ``docs`` (doc_id, text).

    ``spans`` are the maximal runs of hit words (first, end; words count from 0);
    ``item_ids`` the benchmark items with occurring windows, sorted as strings.
    """
    windows, classes = benchmark_windows(items, size)
    hits = stored(_hits(docs, windows, set_rows), "benchmark_hits")  # read twice, scanned once
    earlier = Window.partitionBy("doc_id", "of_text").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "of_text").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0)
    places = hits.groupBy("doc_id", "of_text", "at").agg((F.col("at") + F.max("size")).alias("end"))
    opened = places.withColumn("opens", (F.col("at") > F.coalesce(F.max("end").over(earlier), F.lit(-1))).cast("int"))
    runs = (opened.withColumn("run", F.sum("opens").over(upto)).groupBy("doc_id", "of_text", "run")
            .agg(F.min("at").alias("first"), F.max("end").alias("end")))
    spans = runs.groupBy("doc_id", "of_text").agg(
        F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    named = (hits.select("doc_id", "of_text", "class").distinct().join(classes, "class").groupBy("doc_id", "of_text")
             .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")))
    spans, named = (d.withColumnsRenamed({"doc_id": "_id", "of_text": "_of"}) for d in (spans, named))
    every = _key(docs).select("doc_id", "of_text", F.coalesce(F.size(F.array_remove(F.split("text", f"{_GAP}++"), "")), F.lit(0)).alias("n_words"))

    def with_found(left: DataFrame, right: DataFrame) -> DataFrame:
        same = left["doc_id"].eqNullSafe(right["_id"]) & (left["of_text"] == right["_of"])
        return left.join(right, same, "left").drop("_id", "_of")

    return with_found(with_found(every, spans), named).select(
        "doc_id", "of_text", F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def remove_contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, drop_share: float = 1.0, set_rows: int = SET_ROWS
) -> DataFrame:
    """``docs`` with its columns, without hit words; documents with more than ``drop_share`` of their words hit go.

    A removed word takes what stands before it since the word before along.
    ``drop_share=0`` removes every contaminated document.
    """
    found = (find_contamination(docs, items, size, set_rows).where("n_hit > 0").distinct()
             .select(F.col("doc_id").alias("_id"), F.col("of_text").alias("_of"), "n_words", "n_hit", "spans"))
    whole = docs.withColumn("_text_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    judged = whole.join(
        found, whole["doc_id"].eqNullSafe(found["_id"]) & (whole["_text_digest"] == found["_of"]), "left")
    parts = F.split("text", f"(?<!{_GAP})(?={_GAP})")  # a word with what stands before it; the last may lack the word
    # what stands between two spans: from the end of one to the start of the next
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.size("_parts")))
    cleaned = F.array_join(F.flatten(F.transform(
        F.arrays_zip(ends.alias("e"), starts.alias("s")),
        lambda g: F.slice("_parts", g["e"] + 1, g["s"] - g["e"]))), "")
    kept = judged.where(F.col("n_hit").isNull() | (F.col("n_hit") <= F.lit(drop_share) * F.col("n_words")))
    text = F.when(F.col("n_hit").isNull(), F.col("text")).otherwise(cleaned)
    return (kept.withColumn("_parts", F.when(F.col("n_hit").isNotNull(), parts))
            .withColumn("text", text).select(*docs.columns))
