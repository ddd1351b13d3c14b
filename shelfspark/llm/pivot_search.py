"""Exact top-k inner products by pivot-table elimination.

A pivot table holds every vector's distance to many pivots.  By the triangle
inequality |d(q,p) - d(v,p)| bounds d(q,v) from below, and with it the inner
product (|q|^2 + |v|^2 - d^2) / 2 from above.  Each query evaluates a block's
candidates in the order of that bound and stops when the next bound is below
its k-th best score, so the result is exact.

Queries and candidates meet block by block: a block pair is one bounded group,
whatever the table's size.  Pivots come from a bounded sample and only change
how early a query stops.

Edge cases: vectors that are null or hold null or non-finite components, and
rows with a null id, take no part; a query's own id is no candidate (rows that
repeat it neither); a query id that repeats is answered once, from its smallest
vector; shorter vectors count as ending in zeros; fewer than k candidates give
all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import bounded_sample, stored
from shelfspark.llm.vectors import ids_of, matrix, usable, widest

_FOUND = "query_id long, vec_id long, score long"


def scaled_integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of a sample."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every vector to every pivot."""
    squares = (vectors ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: float = 256.0,
    pivots: int = 16,
    pivot_sample: int = 512,
    block_rows: int = 2048,
    query_rows: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products."""
    spark = vectors.sparkSession
    rows = (
        vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
                scaled_integers(F.col(vector_column), scale).alias("v"))
    )
    width = widest(rows, "v")
    sample = bounded_sample(rows, pivot_sample, "id", "v").select("v").collect()
    points = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        points[i, :len(r.v)] = r.v
    chosen = choose_pivots(points, pivots)

    def add_distances(batches):
        for b in batches:
            d = distances(matrix(b.column(2), width), chosen)
            offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * chosen.shape[0])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))], names=[*b.schema.names, "to_pivots"])

    table = stored(rows.mapInArrow(add_distances, "id long, is_query boolean, v array<long>, to_pivots array<double>"),
                   "pivot_table")
    total, asked = table.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, parts = max(1, -(-total // block_rows)), max(1, -(-asked // query_rows))
    queries = (
        table.where("is_query").groupBy("id").agg(F.min(F.struct("v", "to_pivots")).alias("x")).select("id", "x.*")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    candidates = (
        table.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        found = _search_block(
            ids_of(q["id"]), matrix(q["v"], width), matrix(q["to_pivots"], len(chosen)),
            ids_of(c["id"]), matrix(c["v"], width), matrix(c["to_pivots"], len(chosen)), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    found = (queries.select("part", "block", "id", "v", "to_pivots").groupBy("part", "block")
             .cogroup(candidates.select("part", "block", "id", "v", "to_pivots").groupBy("part", "block"))
             .applyInArrow(search, _FOUND))
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search_block(q_ids, q, q_far, c_ids, c, c_far, k: int) -> tuple:
    """Each query's best ``k`` of one block, candidates in bound order until no bound can reach the k-th score."""
    if not len(q_ids) or not len(c_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bound = np.zeros((len(q), len(c)))
    for p in range(q_far.shape[1]):
        np.maximum(bound, np.abs(q_far[:, p:p + 1] - c_far[:, p]), out=bound)
    bound = ((q ** 2).sum(axis=1)[:, None] + (c ** 2).sum(axis=1) - bound ** 2) / 2
    bound += 1 + 1e-9 * np.abs(bound)  # rounding of the distances
    order = np.argsort(-bound, axis=1)
    largest = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    if largest ** 2 * max(1, q.shape[1]) >= 2 ** 53:  # beyond exact doubles
        q, c = q.astype(np.int64), c.astype(np.int64)
    best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
    best = np.full((len(q), k), np.iinfo(np.int64).min)
    active, at, step = np.arange(len(q)), 0, 64
    while len(active) and at < len(c):
        some = order[active, at:at + step]
        scores = np.einsum("qd,qwd->qw", q[active], c[some]).astype(np.int64)
        ids = c_ids[some]
        scores[ids == q_ids[active, None]] = np.iinfo(np.int64).min
        all_scores = np.concatenate([best[active], scores], axis=1)
        all_ids = np.concatenate([best_ids[active], ids], axis=1)
        first = np.lexsort((all_ids, -1 - all_scores), axis=1)[:, :k]  # -1 - x: no overflow at the smallest
        best[active] = np.take_along_axis(all_scores, first, axis=1)
        best_ids[active] = np.take_along_axis(all_ids, first, axis=1)
        at += step
        if at < len(c):
            active = active[bound[active, order[active, at]] >= best[active, -1]]
    real = best > np.iinfo(np.int64).min
    return np.repeat(q_ids, real.sum(axis=1)), best_ids[real], best[real]
