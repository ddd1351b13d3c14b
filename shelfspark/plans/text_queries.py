"""Registered text, vector-search and RAG queries with oracle SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from shelfspark.functions.numeric import round_half_up
from shelfspark.functions.text import ENGLISH_STOPWORDS, TOKEN_PATTERN, point_id
from shelfspark.functions.vectors import cosine_similarity
from shelfspark.constants import DOMAIN_STOPWORDS
from shelfspark.operators import lexicon as L
from shelfspark.operators import rag as RAG
from shelfspark.operators import text as T
from shelfspark.operators.enrich import enrich_catalog
from shelfspark.operators.search import embeddings_index, search_filters, semantic_search
from shelfspark.plans.frames import enriched, questions_frame
from shelfspark.plans.insight_queries import NB_CTE
from shelfspark.plans.registry import query
from shelfspark.plans.sql import R2, with_ctes
from shelfspark.session import materialized
from shelfspark.sources.catalog import catalog_view, product_texts
from shelfspark.sources.tables import read_table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TOK_SQL = ("list_transform(regexp_extract_all(lower(@X@), '" + TOKEN_PATTERN.replace("'", "''")
           + "'), lambda t: regexp_replace(t, '''s$', ''))")
def _tok(x: str) -> str:
    return TOK_SQL.replace("@X@", x)


STOP_SQL = ", ".join(_q(w) for w in sorted(set(ENGLISH_STOPWORDS) | set(DOMAIN_STOPWORDS)))
LEX_SQL = " UNION ALL ".join(f"SELECT {_q(w)} AS term, {p}e0 AS polarity, {s}e0 AS subjectivity"
                             for w, p, s in T.LEXICON)
NEG_SQL = ", ".join(_q(w) for w in T.NEGATIONS)


def _terms_sql(cond: str, k: int = 20) -> str:
    return with_ctes(NB_CTE + f""",
w AS (SELECT part_key, count(*) AS w FROM nb WHERE {cond} GROUP BY part_key),
tk AS (SELECT w.w, unnest({_tok('d.text')}) AS term FROM w JOIN documents d ON d.doc_id = w.part_key)""",
        f"""SELECT term, cast(sum(w) AS bigint) AS n FROM tk
WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({STOP_SQL})
GROUP BY term ORDER BY n DESC, term LIMIT {k}""")


@query("negative_terms", oracle=_terms_sql("rating <= 2e0"))
def q_negative_terms(spark, sf_dir):
    return T.review_terms(questions_frame(spark, sf_dir, "part_key", "rating"), product_texts(spark, sf_dir), F.col("rating") <= 2, k=20)


@query("positive_terms", oracle=_terms_sql("rating >= 4e0"))
def q_positive_terms(spark, sf_dir):
    return T.review_terms(questions_frame(spark, sf_dir, "part_key", "rating"), product_texts(spark, sf_dir), F.col("rating") >= 4, k=20)


_DOC_TERMS = with_ctes(f"tk AS (SELECT unnest({_tok('text')}) AS term FROM documents)", f"""
SELECT term, cast(count(*) AS bigint) AS n FROM tk
WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({STOP_SQL})
GROUP BY term""")


@query("stopword_anti_join", oracle=_DOC_TERMS)
def q_stopword_anti_join(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return T.term_counts(docs, "doc_id", "text")


@query("stopword_union", oracle=with_ctes(f"tk AS (SELECT unnest({_tok('text')}) AS term FROM documents)",
    f"SELECT term, cast(count(*) AS bigint) AS n FROM tk WHERE term IN ({STOP_SQL}) GROUP BY term"))
def q_stopword_union(spark, sf_dir):
    """Occurrences in the documents of each word of the merged stop-word set."""
    docs = read_table(spark, sf_dir, "documents")
    toks = T.document_tokens(docs, "doc_id", "text")
    stop = T.stopword_table(spark)
    return toks.join(F.broadcast(stop), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_SENT_CTES = f"""
lex AS ({LEX_SQL}),
tt AS (SELECT doc_id, {_tok('text')} AS toks FROM documents),
u AS (SELECT doc_id, unnest(toks) AS term, unnest(list_concat([NULL::varchar], toks)[1:len(toks)]) AS prev FROM tt),
hits AS (SELECT u.doc_id, CASE WHEN coalesce(prev, '') IN ({NEG_SQL}) THEN polarity * -0.5e0 ELSE polarity END AS p,
                subjectivity, u.term FROM u JOIN lex ON u.term = lex.term),
agg AS (SELECT doc_id, avg(p) AS ap, avg(subjectivity) AS asub, count(*) AS hits FROM hits GROUP BY doc_id),
sent AS (SELECT d.doc_id,
           CASE WHEN d.text IS NULL OR d.text = '' THEN 0e0 ELSE coalesce(ap, 0e0) END AS polarity,
           CASE WHEN d.text IS NULL OR d.text = '' THEN 0.5e0 ELSE coalesce(asub, 0e0) END AS subjectivity,
           cast(coalesce(agg.hits, 0) AS bigint) AS hits
         FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id)"""


def _sent(spark, sf_dir):
    return T.sentiment_scores(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@query("sentiment_polarity", oracle=with_ctes(_SENT_CTES.strip(),
                                              f"SELECT doc_id, {R2('polarity', 6)} AS polarity, hits FROM sent"))
def q_sentiment_polarity(spark, sf_dir):
    return _sent(spark, sf_dir).select("doc_id", round_half_up("polarity", 6).alias("polarity"), "hits")


@query("sentiment_subjectivity", oracle=with_ctes(_SENT_CTES.strip(),
                                                  f"SELECT doc_id, {R2('subjectivity', 6)} AS subjectivity FROM sent"))
def q_sentiment_subjectivity(spark, sf_dir):
    return _sent(spark, sf_dir).select("doc_id", round_half_up("subjectivity", 6).alias("subjectivity"))


@query("lexicon_join", oracle=with_ctes(_SENT_CTES.strip(),
                                        "SELECT term, count(*) AS n FROM hits GROUP BY term"))
def q_lexicon_join(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    toks = T.document_tokens(docs, "doc_id", "text")
    return toks.join(F.broadcast(T.lexicon_table(spark)), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_SENT_CAT = with_ctes(_SENT_CTES.strip() + """,
cat AS (SELECT e.main_category, coalesce(s.polarity, 0e0) AS review_sentiment FROM enriched e
        LEFT JOIN sent s ON s.doc_id = e.part_key)""", """""")


def _sentiment_catalog(spark, sf_dir):
    return T.add_sentiment(enriched(spark, sf_dir), product_texts(spark, sf_dir))


@query("add_sentiment", oracle=_SENT_CAT + f"""SELECT main_category, count(*) AS n,
    {R2('avg(review_sentiment)', 6)} AS mean_sentiment FROM cat GROUP BY main_category""")
def q_add_sentiment(spark, sf_dir):
    df = _sentiment_catalog(spark, sf_dir)
    return df.groupBy("main_category").agg(F.count(F.lit(1)).alias("n"),
                                           round_half_up(F.avg("review_sentiment"), 6).alias("mean_sentiment"))


@query("sentiment_stats", oracle=_SENT_CAT + f"""SELECT {R2('min(review_sentiment)', 3)} AS min,
    {R2('max(review_sentiment)', 3)} AS max, {R2('avg(review_sentiment)', 3)} AS mean,
    count(*) FILTER (WHERE review_sentiment > 0) AS positive_count,
    count(*) FILTER (WHERE review_sentiment < 0) AS negative_count,
    count(*) FILTER (WHERE review_sentiment = 0) AS neutral_count FROM cat""")
def q_sentiment_stats(spark, sf_dir):
    from shelfspark.operators.profile import sentiment_stats
    return sentiment_stats(_sentiment_catalog(spark, sf_dir))


@query("positive_negative_neutral", oracle=_SENT_CAT + """SELECT
    count(*) FILTER (WHERE review_sentiment > 0) AS positive_count,
    count(*) FILTER (WHERE review_sentiment < 0) AS negative_count,
    count(*) FILTER (WHERE review_sentiment = 0) AS neutral_count FROM cat""")
def q_positive_negative_neutral(spark, sf_dir):
    from shelfspark.operators.profile import sentiment_stats
    return sentiment_stats(_sentiment_catalog(spark, sf_dir)).select(
        "positive_count", "negative_count", "neutral_count")


@query("text_length", oracle="SELECT doc_id, cast(coalesce(length(text), 0) AS bigint) AS text_length FROM documents")
def q_text_length(spark, sf_dir):
    from shelfspark.functions.cleaning import text_length
    return read_table(spark, sf_dir, "documents").select("doc_id", text_length("text").alias("text_length"))


@query("count_reviews", oracle="""SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0
    ELSE cast(len(list_filter(string_split(text, ','), lambda x: regexp_matches(x, '\\S'))) AS bigint) END AS n_reviews
    FROM documents""")
def q_count_reviews(spark, sf_dir):
    from shelfspark.functions.cleaning import count_segments
    return read_table(spark, sf_dir, "documents").select("doc_id", count_segments("text").alias("n_reviews"))


# ---------------------------------------------------------------- learned lexicon


def _learned_sql(fold: str = "true") -> str:
    """CTEs ``rated``, ``used`` (a word and whether it is negated), ``lexicon`` (of the texts where ``fold``), ``scored``."""
    return f"""
rated AS (SELECT part_key, count(*) FILTER (WHERE rating >= 4) AS good, count(*) FILTER (WHERE rating <= 2) AS bad
          FROM catalog GROUP BY part_key HAVING count(*) FILTER (WHERE rating >= 4 OR rating <= 2) > 0),
tt AS (SELECT doc_id, {_tok('text')} AS toks FROM documents),
used AS (SELECT doc_id, toks[i] AS term, list_has_any(toks[greatest(1, i - 3):i - 1], [{NEG_SQL}]) AS negated
         FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM tt)
         WHERE toks[i] NOT IN ({NEG_SQL}) AND NOT regexp_full_match(toks[i], '[0-9]+')),
tc AS (SELECT term, cast(sum(CASE WHEN negated THEN bad ELSE good END) AS bigint) AS positive,
              cast(sum(CASE WHEN negated THEN good ELSE bad END) AS bigint) AS negative
       FROM used JOIN rated ON doc_id = part_key WHERE {fold} GROUP BY term),
tot AS (SELECT sum(positive) AS p, sum(negative) AS n FROM tc),
pr AS (SELECT tc.*, p, n, (positive + negative) * 1e3 / (p + n) AS a FROM tc, tot),
lo AS (SELECT *, ln((positive + a) / (p + 1e3 - positive - a)) - ln((negative + a) / (n + 1e3 - negative - a)) AS d FROM pr),
lexicon AS (SELECT term, positive, negative, cast(floor((exp(d) - 1) / (exp(d) + 1) * 1e6 + 0.5e0) AS bigint) AS weight,
                   d / sqrt(1 / (positive + a) + 1 / (negative + a)) AS z FROM lo
            WHERE abs(d / sqrt(1 / (positive + a) + 1 / (negative + a))) >= 1.96e0),
sums AS (SELECT doc_id, sum(CASE WHEN negated THEN -weight ELSE weight END) AS s, sum(abs(weight)) AS m, count(*) AS hits
         FROM used JOIN lexicon USING (term) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(s / hits / 1e6, 0e0) AS polarity,
                  CASE WHEN text IS NULL OR text = '' THEN 0.5e0 ELSE coalesce(m / hits / 1e6, 0e0) END AS subjectivity,
                  cast(coalesce(hits, 0) AS bigint) AS hits
           FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id)"""


def _ratings(spark, sf_dir):
    rows = catalog_view(spark, sf_dir).select(F.col("part_key").alias("doc_id"), "rating")
    return L.text_ratings(rows, "doc_id")


@query("learned_lexicon", oracle=with_ctes(_learned_sql().strip(), f"""SELECT term, positive, negative,
    {R2('weight / 1e6', 5)} AS weight, {R2('z', 6)} AS z FROM lexicon"""))
def q_learned_lexicon(spark, sf_dir):
    """Terms whose use tells high from low ratings, with weights from their log-odds."""
    found = L.learn_lexicon(read_table(spark, sf_dir, "documents"), _ratings(spark, sf_dir), "doc_id", "text")
    return found.select("term", "positive", "negative", round_half_up(F.col("weight") / 1e6, 5).alias("weight"),
                        round_half_up("z", 6).alias("z"))


@query("learned_sentiment", oracle=with_ctes(_learned_sql().strip(), f"""SELECT doc_id, {R2('polarity', 5)} AS polarity,
    {R2('subjectivity', 5)} AS subjectivity, hits FROM scored"""))
def q_learned_sentiment(spark, sf_dir):
    """Polarity and subjectivity of every text by the learned lexicon."""
    docs = read_table(spark, sf_dir, "documents")
    scores = L.learned_scores(docs, L.learn_lexicon(docs, _ratings(spark, sf_dir), "doc_id", "text"), "doc_id", "text")
    return scores.select("doc_id", round_half_up("polarity", 5).alias("polarity"),
                         round_half_up("subjectivity", 5).alias("subjectivity"), "hits")


@query("learned_agreement", oracle=with_ctes(_learned_sql("doc_id % 3 <> 1").strip(), """SELECT
    cast(coalesce(sum(good + bad), 0) AS bigint) AS ratings,
    cast(coalesce(sum(CASE WHEN polarity > 0 THEN good WHEN polarity < 0 THEN bad ELSE 0 END), 0) AS bigint) AS agreeing,
    cast(coalesce(sum(CASE WHEN polarity > 0 THEN bad WHEN polarity < 0 THEN good ELSE 0 END), 0) AS bigint) AS opposed,
    cast(coalesce(sum(CASE WHEN polarity = 0 THEN good + bad ELSE 0 END), 0) AS bigint) AS undecided
    FROM scored JOIN rated ON doc_id = part_key WHERE doc_id % 3 = 1"""))
def q_learned_agreement(spark, sf_dir):
    """Ratings of held-out texts (a third) against the polarity by a lexicon of the other texts."""
    docs, ratings = read_table(spark, sf_dir, "documents"), _ratings(spark, sf_dir)
    held = F.col("doc_id") % 3 == 1
    lexicon = L.learn_lexicon(docs, ratings.where(~held), "doc_id", "text")
    return L.rating_agreement(L.learned_scores(docs.where(held), lexicon, "doc_id", "text"), ratings, "doc_id")


# ---------------------------------------------------------------- documents & ids


def products(spark, sf_dir):
    """Last catalog row per product with its text (text joined per product).

    Order lines are cut to the last one per part before they meet the parts, so no line
    carries names and categories through a shuffle; a part key that repeats in ``part`` is one product.
    """
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount").where(
        "l_extendedprice IS NOT NULL AND l_discount IS NOT NULL")  # others have no price or discount, and are no catalog rows
    last_lines = RAG.latest_per_key(lines, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], narrow=True)
    cat = enrich_catalog(catalog_view(spark, sf_dir, lineitem=last_lines))
    last = RAG.latest_per_key(cat, "product_id")
    return last.join(product_texts(spark, sf_dir), "part_key", "left")


_UUID_SQL = """lower(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
      CASE WHEN substr(h, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr(h, 17, 1) IN ('1','5','9','d') THEN '9'
           WHEN substr(h, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END || substr(h, 18, 3), substr(h, 21, 12)))"""

_PRODUCTS_CTE = """lastrow AS (SELECT * FROM enriched QUALIFY row_number() OVER (PARTITION BY product_id
      ORDER BY order_key DESC, line_number DESC, part_key DESC, supp_key DESC, actual_price DESC) = 1),
prod AS (SELECT l.*, d.text AS about_product, d.text AS review_content FROM lastrow l
         LEFT JOIN documents d ON d.doc_id = l.part_key)"""


@query("point_id_uuid5", oracle=with_ctes(
    "p AS (SELECT DISTINCT product_id FROM catalog), hh AS (SELECT product_id, "
    "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(product_id)) AS h FROM p)",
    f"SELECT product_id, {_UUID_SQL} AS point_id FROM hh"))
def q_point_id_uuid5(spark, sf_dir):
    p = catalog_view(spark, sf_dir).select("product_id").distinct()
    return p.select("product_id", point_id("product_id").alias("point_id"))


@query("build_rag_documents", oracle=with_ctes(_PRODUCTS_CTE, """SELECT product_id AS id,
    concat_ws(chr(10), 'Product: ' || product_name, 'Category: ' || main_category, 'Sub-category: ' || sub_category,
              'Description: ' || about_product, 'Reviews: ' || review_content) AS text,
    main_category, price_tier, rating_count FROM prod"""))
def q_build_rag_documents(spark, sf_dir):
    return RAG.build_rag_documents(products(spark, sf_dir)).select("id", "text", "main_category", "price_tier",
                                                                   "rating_count")


@query("document_vector_join", oracle="""SELECT d.doc_id, cast(len(e.embedding) AS integer) AS dim, e.label,
    cast(length(d.text) AS bigint) AS n_chars FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""")
def q_document_vector_join(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    e = read_table(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id).select("doc_id", F.size("embedding").alias("dim"), "label",
                                                  F.length("text").cast("bigint").alias("n_chars"))


def _embed_cte(name: str, source: str) -> str:
    """(id, b, n) word counts per place and (id, norm) of ``source`` (id, text)."""
    return f"""{name}_b AS (SELECT id, cast('0x' || substr(md5(t), 1, 8) AS bigint) % 256 AS b, count(*) AS n
  FROM (SELECT id, unnest({_tok('text')}) AS t FROM {source}) GROUP BY 1, 2),
{name}_n AS (SELECT id, sqrt(cast(sum(n * n) AS double)) AS norm FROM {name}_b GROUP BY id)"""


@query("embed_documents", oracle=f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {_embed_cte('e', 'src')}
SELECT e_b.id AS doc_id, cast(b AS integer) AS place, {R2('n / norm', 9)} AS value FROM e_b JOIN e_n ON e_b.id = e_n.id""")
def q_embed_documents(spark, sf_dir):
    """The non-zero places of every document's vector."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return RAG.embed_documents(docs, "text", "vector").select("doc_id", F.posexplode("vector").alias("place", "x")).where(
        "x <> 0").select("doc_id", "place", round_half_up("x", 9).alias("value"))


# ---------------------------------------------------------------- vectors & search

_CENTROID_SQL = """WITH ex AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, avg(cast(x AS double)) AS m FROM ex GROUP BY label, i),
cv AS (SELECT label, list(m ORDER BY i) AS centroid FROM c GROUP BY label)
SELECT e.vec_id, e.label, """ + R2("list_dot_product(cast(e.embedding AS double[]), cv.centroid) / "
                                   "(sqrt(list_dot_product(cast(e.embedding AS double[]), cast(e.embedding AS double[]))) "
                                   "* sqrt(list_dot_product(cv.centroid, cv.centroid)))", 6) + """ AS cosine
FROM embeddings e JOIN cv ON e.label = cv.label"""


@query("cosine_similarity", oracle=_CENTROID_SQL)
def q_cosine_similarity(spark, sf_dir):
    """Cosine of every vector to its label centroid (centroid = per-dimension mean)."""
    e = read_table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x"))
    cent = (parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
                 .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_c"))
                 .select("label", F.transform("_c", lambda s: s["m"]).alias("centroid")))
    return e.join(cent, "label").select("vec_id", "label",
                                        round_half_up(cosine_similarity("embedding", "centroid"), 6).alias("cosine"))


def _search_sql(k: int, tau: str, where: str = "") -> str:
    w = f"AND {where}" if where else ""
    return f"""WITH ix AS (SELECT vec_id AS id, cast(embedding AS double[]) AS v, 'label_' || cast(label AS varchar)
                         AS main_category FROM embeddings),
n AS (SELECT id, main_category, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM ix),
s AS (SELECT q.id AS query_id, i.id, i.main_category, list_dot_product(q.u, i.u) AS score
      FROM n q, n i WHERE list_dot_product(q.u, i.u) >= {tau} {w}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM s)
SELECT query_id, cast(rk AS integer) AS rank, id, {R2('score', 6)} AS score, main_category FROM r WHERE rk <= {k}"""


def _self_search(spark, sf_dir, **kw):
    idx = embeddings_index(read_table(spark, sf_dir, "embeddings"))
    q = idx.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    filt = kw.pop("filters", {})
    hits = semantic_search(q, search_filters(idx, **filt), **kw)
    return hits.select("query_id", "rank", "id", round_half_up("score", 6).alias("score"), "main_category")


@query("semantic_search", oracle=_search_sql(5, "0.2e0"))
def q_semantic_search(spark, sf_dir):
    """Every vector as a query against the whole index: top 5 with cosine ≥ 0.2."""
    return _self_search(spark, sf_dir, score_threshold=0.2)


@query("vector_topk", oracle=_search_sql(10, "0.5e0"))
def q_vector_topk(spark, sf_dir):
    return _self_search(spark, sf_dir, top_k=10, score_threshold=0.5)


@query("query_document_cross", oracle=_search_sql(20, "0e0"))
def q_query_document_cross(spark, sf_dir):
    """All query × vector scores ≥ 0 (pivot cells prune nothing at τ = 0), top 20.

    The search ranks by scores of 9 digits; the hits' scores are taken anew from
    their vectors, since rounding twice would move a score next to a tie.
    """
    idx = embeddings_index(read_table(spark, sf_dir, "embeddings"))
    q = idx.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    hits = semantic_search(q, idx, top_k=20, score_threshold=0.0).select("query_id", "rank", "id")
    score = round_half_up(cosine_similarity("query_vector", "vector"), 6).alias("score")
    return hits.join(q, "query_id").join(idx, "id").select("query_id", "rank", "id", score, "main_category")


# ---------------------------------------------------------------- RAG batch


def product_index(spark, sf_dir):
    """Every product document with its vector."""
    return RAG.embed_documents(RAG.build_rag_documents(products(spark, sf_dir)), "text", "vector")


def user_questions(spark, sf_dir):
    """Every user turn as a question with its vector."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    q = conv.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"))
    return RAG.embed_documents(q, "question", "query_vector")


def _hits(spark, sf_dir, top_k=5, tau=0.5, filters=None):
    idx = search_filters(product_index(spark, sf_dir), **(filters or {}))
    q = user_questions(spark, sf_dir)
    payload = ["text", "product_name", "main_category", "actual_price", "discounted_price",
               "discount_percentage", "rating", "rating_count"]
    hits = semantic_search(q, idx, top_k=top_k, score_threshold=tau, payload=payload)
    return q, hits


_RAG_CTE = _PRODUCTS_CTE + """,
docs AS (SELECT product_id AS id, product_name, main_category, actual_price, discount_percentage, rating, rating_count,
           concat_ws(chr(10), 'Product: ' || product_name, 'Category: ' || main_category,
                     'Sub-category: ' || sub_category, 'Description: ' || about_product,
                     'Reviews: ' || review_content) AS text FROM prod),
qs AS (SELECT concat_ws('-', conv_id, turn) AS query_id, text AS question FROM conversations WHERE role = 'user'),
q_src AS (SELECT query_id AS id, question AS text FROM qs),
""" + _embed_cte("q", "q_src") + "," + _embed_cte("d", "docs") + """,
s AS (SELECT query_id, docs.*, score FROM (
        SELECT q_b.id AS query_id, d_b.id AS did, round(sum(q_b.n * d_b.n) / (any_value(q_n.norm) * any_value(d_n.norm)), 9) AS score
        FROM q_b JOIN d_b ON q_b.b = d_b.b JOIN q_n ON q_b.id = q_n.id JOIN d_n ON d_b.id = d_n.id GROUP BY 1, 2)
      JOIN docs ON docs.id = did WHERE score >= 0.5e0 /*filter*/),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM s),
h AS (SELECT * FROM r WHERE rk <= 5),
blk AS (SELECT query_id, rk, concat_ws(chr(10),
          chr(10) || cast(rk AS varchar) || '. ' || coalesce(product_name, 'Unknown'),
          CASE WHEN main_category IS NOT NULL AND main_category <> '' THEN '   Category: ' || main_category END,
          CASE WHEN actual_price IS NOT NULL AND actual_price <> 0 THEN printf('   Price: $%.2f', actual_price) END,
          CASE WHEN discount_percentage IS NOT NULL AND discount_percentage <> 0
               THEN printf('   Discount: %.1f%%', discount_percentage) END,
          CASE WHEN rating IS NOT NULL AND rating <> 0 THEN printf('   Rating: %.1f/5', rating) ||
               CASE WHEN rating_count IS NOT NULL AND rating_count <> 0
                    THEN printf(' (%d reviews)', rating_count) ELSE '' END END,
          CASE WHEN text IS NOT NULL AND text <> '' THEN '   Details: ' || text END,
          printf('   (Relevance: %.2f%%)', score * 100e0)) AS b FROM h),
ctx AS (SELECT query_id, count(*) AS n_hits,
          'Relevant products from our catalog:' || chr(10) || chr(10) || string_agg(b, chr(10) ORDER BY rk) AS context
        FROM blk GROUP BY query_id),
cq AS (SELECT qs.query_id, qs.question, cast(coalesce(ctx.n_hits, 0) AS integer) AS n_hits,
          coalesce(ctx.context, 'No relevant products found in the database.') AS context
        FROM qs LEFT JOIN ctx ON qs.query_id = ctx.query_id)"""


@query("format_context", oracle=with_ctes(_RAG_CTE, "SELECT query_id, n_hits, context FROM cq"))
def q_format_context(spark, sf_dir):
    q, hits = _hits(spark, sf_dir)
    return RAG.format_context(hits, q).select("query_id", "n_hits", "context")


@query("extract_sources", oracle=with_ctes(_RAG_CTE, f"""SELECT query_id, cast(rk AS integer) AS rank,
    coalesce(product_name, 'Unknown') AS product, {R2('score')} AS relevance, id FROM h"""))
def q_extract_sources(spark, sf_dir):
    q, hits = _hits(spark, sf_dir)
    src = RAG.format_context(hits, q).select("query_id", F.posexplode("sources").alias("p", "s"))
    return src.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("s.product").alias("product"),
                      F.col("s.relevance").alias("relevance"), F.col("s.id").alias("id"))


_FILTERED = {"min_price": 300.0, "max_price": 5000.0, "min_rating": 2.0}


@query("search_filters", oracle=with_ctes(_RAG_CTE.replace(
    "/*filter*/", "AND actual_price >= 300e0 AND actual_price <= 5000e0 AND rating >= 2e0"),
    f"SELECT query_id, cast(rk AS integer) AS rank, id, {R2('score', 6)} AS score, main_category FROM h"))
def q_search_filters(spark, sf_dir):
    """Questions against the products of a price band with a rating of at least 2."""
    _, hits = _hits(spark, sf_dir, filters=_FILTERED)
    return hits.select("query_id", "rank", "id", round_half_up("score", 6).alias("score"), "main_category")


@query("question_search", oracle=with_ctes(
    _RAG_CTE, f"SELECT query_id, cast(rk AS integer) AS rank, id, {R2('score', 6)} AS score, main_category FROM h"))
def q_question_search(spark, sf_dir):
    """Question text → vector → the five nearest product documents."""
    _, hits = _hits(spark, sf_dir)
    return hits.select("query_id", "rank", "id", round_half_up("score", 6).alias("score"), "main_category")


_KINDS = ("qa", "qa_examples", "recommendation", "comparison", "pricing")


def _filled(kind: str) -> str:
    """The prompt of a kind from ``cq``; slots are filled once, the question last so that its text is never filled again."""
    from shelfspark.operators.prompts import UNGROUNDED_PROMPT_TEMPLATE, template
    t = template(kind)
    slot = "{request}" if "{request}" in t else "{question}"
    pieces = re.split(r"(\{context\}|" + re.escape(slot) + ")", t)
    grounded = " || ".join("context" if x == "{context}" else "question" if x == slot else _q(x) for x in pieces if x)
    pieces = re.split(r"(\{question\})", UNGROUNDED_PROMPT_TEMPLATE)
    without = " || ".join("question" if x == "{question}" else _q(x) for x in pieces if x)
    return f"CASE WHEN n_hits > 0 THEN {grounded} ELSE {without} END"


def _prompt_sql() -> str:
    """The prompts of all kinds."""
    return with_ctes(_RAG_CTE, " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, query_id, n_hits > 0 AS grounded, {_filled(kind)} AS prompt FROM cq" for kind in _KINDS))


def _contexts(spark, sf_dir):
    q, hits = _hits(spark, sf_dir)
    return RAG.format_context(hits, q).join(q.select("query_id", "question"), "query_id")


@query("assemble_prompts", oracle=_prompt_sql())
def q_assemble_prompts(spark, sf_dir):
    """Prompts of every kind for every question, grounded or not."""
    ctx = materialized(_contexts(spark, sf_dir), "contexts")  # read once per kind
    out = None
    for kind in _KINDS:
        part = RAG.assemble_prompts(ctx, kind=kind).select(F.lit(kind).alias("kind"), "query_id", "grounded", "prompt")
        out = part if out is None else out.unionByName(part)
    return out


def _rag_batch_sql() -> str:
    sources = (f"SELECT query_id, string_agg('{{\"product\":' || cast(to_json(coalesce(product_name, 'Unknown')) AS varchar) || "
               f"',\"relevance\":' || cast({R2('score')} AS varchar) || ',\"id\":' || cast(to_json(id) AS varchar) || '}}', ',' ORDER BY rk) AS s, "
               f"{R2('max(score)', 6)} AS best_score FROM h GROUP BY query_id")
    return with_ctes(_RAG_CTE + f""",
src AS ({sources})""", f"""SELECT cq.query_id, question, n_hits, n_hits > 0 AS grounded, best_score, context,
    {_filled('qa_examples')} AS prompt, '[' || coalesce(s, '') || ']' AS sources
    FROM cq LEFT JOIN src ON src.query_id = cq.query_id""")


@query("rag_batch", oracle=_rag_batch_sql())
def q_rag_batch(spark, sf_dir):
    """Questions → hits → context → prompt, sources (JSON, in rank order) and grounded flag, all given out (no generation)."""
    q, hits = _hits(spark, sf_dir)
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    ctx = RAG.format_context(hits, q).join(q.select("query_id", "question"), "query_id").join(best, "query_id", "left")
    out = RAG.assemble_prompts(ctx, kind="qa_examples")
    return out.select("query_id", "question", "n_hits", "grounded", round_half_up("best", 6).alias("best_score"),
                      "context", "prompt", F.to_json("sources").alias("sources"))
