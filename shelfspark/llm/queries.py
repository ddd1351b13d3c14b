"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import alignment, bpe, conversations, decontaminate, digests, hilbert_ann, html_content, langid, orc_tokens, packing, pivot_search, prob_minhash, suffix_dedup, url_rules
from shelfspark.llm.common import stored
from shelfspark.session import shared_dir

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as ORC and read back."""
    path = shared_dir(spark, "llm", "token_orc", unique=True)
    orc_tokens.write_token_orc(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    read = digests.with_ids_crc32(orc_tokens.read_token_orc(spark, path).drop("n_tokens"))
    return read.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    pieces = packing.piece_step(spark, tokenizer_path(), capacity=2048, end_id=0)
    return packing.best_fit_pack(
        packing.texts_of(_table(spark, sf_dir, "documents")), capacity=2048,
        steps=(pieces, digests.crc32_step(pieces.schema))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    ids = bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return bpe.decode_ids(ids, tokenizer_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


#: The rules of the registered query: (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@_query
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


ORACLES["op4_url_rules"] = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0
              THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0
              THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT p.*, r.rhost, r.rpath, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost) DESC NULLS LAST,
                            length(r.rpath) DESC) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict
FROM fits WHERE k = 1
"""


@_query
def op5_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th vector."""
    return pivot_search.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op5_pivot_top_k"] = """
WITH ints AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op6_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty near neighbours of every 20th vector."""
    return hilbert_ann.hilbert_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_query
def op8_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_content.extract_content(pages).select("page_id", "url", "text", "n_chars")


def language_model(docs: DataFrame) -> langid.Model:
    """The model of the registered query: learned from the rows that are not held out."""
    return langid.train_language_model(docs.where(~langid.held_out(F.col("doc_id"))))


@_query
def op2_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify_languages(
        docs.withColumn("held_out", langid.held_out(F.col("doc_id"))), language_model(docs), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@_query
def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document and the links found for its text."""
    return prob_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated 100-byte strings."""
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op12_benchmark_decontamination"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM grams),
places AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, sizes WHERE len(w) >= k)),
hits AS (SELECT p.r, p.k, p.i, g.item_id FROM places p JOIN grams g USING (k, g)),
hit_words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(x.n, 0) AS BIGINT) AS n_items, sha256(coalesce(x.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items x USING (r)
"""


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers cut every document."""
    return alignment.cross_tokenizer_links(
        _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, the cheapest edits and the repaired text's digest of every damaged conversation."""
    rows = conversations.damage(_table(spark, sf_dir, "conversations"))
    judged = stored(conversations.judge_conversations(rows), "conversation_audits")
    hashed = conversations.repair_conversations(rows, judged, digest=True).withColumnRenamed("conv_id", "_conv")
    return judged.join(hashed, judged["conv_id"].eqNullSafe(hashed["_conv"])).drop("_conv")
