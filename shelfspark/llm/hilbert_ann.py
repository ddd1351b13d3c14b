"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected by random rotations, shifted, and ordered along several
Hilbert curves; Spark range-partitions each ordering.  A query's candidates
are its neighbouring key windows on all curves; they are scored with the
original vectors and the best of all windows merge.

The rotations are random, the projection bounds come from a bounded sample of
rows; every row is indexed.  A window is a share of the table on each curve
(``window_share``), because without clusters the share that must be seen for a
given recall does not fall with the table's size.

Edge cases: null, all-zero and non-finite vectors and rows with a null id take
no part; a query's own id is no candidate (rows that repeat it neither);
shorter vectors count as ending in zeros; equal vectors share a key and are
ordered by id; fewer than k candidates give all of them; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import bounded_sample, shuffle_partitions, stored
from shelfspark.llm.vectors import ids_of, matrix, usable, widest


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows of ``bits``-bit coordinates)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def make_curves(sample: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> list[tuple]:
    """(axes, low, step) of each curve: disjoint axes of random rotations, bounds from the sample, random shifts."""
    rng = np.random.default_rng(seed)
    width, found = sample.shape[1], []
    while len(found) < curves:
        rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for i in range(0, max(1, width - dims + 1), dims):
            axes = rotation[:, i:i + dims]
            seen = sample @ axes
            low, high = seen.min(axis=0), seen.max(axis=0)
            step = np.maximum(high - low, 1e-12) * 1.5 / (1 << bits)
            found.append((axes, low - rng.random(axes.shape[1]) * 0.5 * (high - low), step))
    return found[:curves]


def hilbert_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    curves: int = 8,
    dims: int = 16,
    bits: int = 3,
    window_share: float = 0.2,
    least_window: int = 512,
    block_rows: int = 2048,
    sample_rows: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each query."""
    spark = vectors.sparkSession
    rows = (
        vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull()
                      & F.exists(F.col(vector_column), lambda x: x != 0))
        .select(F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
                F.col(vector_column).alias("v"))
    )
    width = widest(rows, "v")
    sampled = bounded_sample(rows, sample_rows, "id", "v").select("v").collect()
    points = np.zeros((max(1, len(sampled)), max(1, width)))
    for i, r in enumerate(sampled):
        points[i, :len(r.v)] = r.v
    made = make_curves(points, curves, min(dims, max(1, width)), bits, seed)
    top = (1 << bits) - 1

    def index(batches):
        for b in batches:
            x = matrix(b.column(2), points.shape[1])
            for t, (axes, low, step) in enumerate(made):
                cells = np.clip((x @ axes - low) // step, 0, top).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(hilbert_keys(cells, bits)), *b.columns],
                    names=["curve", "key", *b.schema.names])

    kind = dict(rows.dtypes)["v"]
    keyed = rows.mapInArrow(index, f"curve int, key long, id long, is_query boolean, v {kind}")
    ordered = (keyed.repartitionByRange(shuffle_partitions(spark), "curve", "key", "id")
               .sortWithinPartitions("curve", "key", "id"))

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(curves, dtype=np.int64)
        for b in batches:
            curve = b.column(0).to_numpy()
            first = np.searchsorted(curve, curve, side="left")
            place = np.arange(len(curve)) - first + seen[curve]
            seen += np.bincount(curve, minlength=curves)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(np.full(len(curve), part, dtype=np.int32)), pa.array(place)],
                names=["curve", "id", "is_query", "v", "part", "place"])

    index_table = stored(
        ordered.mapInArrow(number, f"curve int, id long, is_query boolean, v {kind}, part int, place long"),
        "hilbert_index")
    sizes = index_table.groupBy("curve", "part").agg(F.count("*").alias("n"))  # <= curves + partitions rows
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")
    size = F.sum("n").over(Window.partitionBy("curve"))
    bases = sizes.select("curve", "part", before.alias("base"), size.alias("total"))
    placed = index_table.join(F.broadcast(bases), ["curve", "part"]).withColumn("at", F.col("base") + F.col("place"))
    half = F.greatest(F.lit(least_window), F.ceil(F.col("total") * F.lit(window_share / 2)))
    last = F.floor((F.col("total") - 1) / block_rows)
    candidates = placed.select("curve", F.floor(F.col("at") / block_rows).alias("block"), "id", "v")
    queries = placed.where("is_query").select(
        "curve", "id", "v",
        F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - half) / block_rows)),
                             F.least(last, F.floor((F.col("at") + half) / block_rows)))).alias("block"))
    columns = [F.col(c).alias(c) for c in ("curve", "block", "id", "v")]  # new columns: both sides read one table

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        q_ids, c_ids = ids_of(q["id"]), ids_of(c["id"])
        x = matrix(q["v"], width) @ matrix(c["v"], width).T
        x[q_ids[:, None] == c_ids] = -np.inf
        keep = min(k, x.shape[1])
        far = np.argpartition(-x, keep - 1, axis=1)[:, :keep] if x.size else np.zeros((len(q_ids), 0), np.int64)
        got = np.take_along_axis(x, far, axis=1)
        tied = got.min(axis=1, initial=np.inf)  # everything that ties with the last one kept comes too
        ids, scores = [], []
        for i in range(len(q_ids)):
            own = np.flatnonzero((x[i] >= tied[i]) & (x[i] > -np.inf))
            own = own[np.lexsort((c_ids[own], -x[i, own]))[:keep]]
            ids.append(c_ids[own])
            scores.append(x[i, own])
        return pa.table({"query_id": pa.array(q_ids, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())),
                         "scores": pa.array(scores, pa.list_(pa.float64()))})

    found = (queries.select(*columns).groupBy("curve", "block").cogroup(candidates.select(*columns).groupBy("curve", "block"))
             .applyInArrow(score, "query_id long, ids array<long>, scores array<double>"))

    def merge(t: pa.Table) -> pa.Table:
        q = np.repeat(ids_of(t["query_id"]), [len(x) for x in t["ids"]])
        ids, scores = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
        order = np.lexsort((-scores, ids, q))
        q, ids, scores = q[order], ids[order], scores[order]
        once = np.ones(len(q), dtype=bool)
        once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, scores = q[once], ids[once], scores[once]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left") + 1
        kept = rank <= k
        return pa.table({"query_id": q[kept], "rank": rank[kept].astype(np.int32), "vec_id": ids[kept], "score": scores[kept]})

    asked = index_table.where(F.col("is_query") & (F.col("curve") == 0)).count()
    groups = max(1, -(-asked // 256))
    return (found.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group"))
            .applyInArrow(merge, "query_id long, rank int, vec_id long, score double"))
