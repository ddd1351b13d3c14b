"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Only lengths decide where a piece goes, and there are at most ``capacity``
different ones.  So the exact best-fit-decreasing plan for the whole corpus is
made from the length histogram: lengths fall from ``capacity`` to 1, a segment
tree over remaining capacities finds the tightest open sequences for each, and
equal pieces go to equally filled sequences in runs, filling each up first.  The plan is a table of
runs (length, ranks, sequences, offset); its size depends on the number of
different lengths, not on the corpus.  Spark numbers the pieces of each length
(per partition, plus a prefix sum over partitions) and looks each rank up.

Edge cases: a null or empty text is one piece with the end id; an item's
length must lie in 1..capacity (else an error); equal rows are separate items;
no items give an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import ArrowStep, chunked, int_lists, run_steps, stored, string_values
from shelfspark.llm.tokens import read_tokenizer, worker_encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids array<int>"
_FLUSH_BYTES = 4 << 20
_ADDED = ("_part", "_rank", "_base", "sequence_id", "offset")


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Ids of every whole text plus the end id, cut into pieces of at most ``capacity``."""
    return run_steps(texts_of(docs), piece_step(docs.sparkSession, tokenizer_path, capacity, end_id))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def piece_step(spark: SparkSession, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> ArrowStep:
    """``token_pieces`` over record batches of (doc_id, text)."""
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(spec.value)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), string_values(batch.column(1))):
                ids = encoder.encode(text) + end
                for i in range(0, len(ids), step):
                    piece = ids[i:i + step]
                    rows.append((doc_id, i // step, i >> 2, len(piece) >> 2, piece))
                held += len(ids)
                if held >= _FLUSH_BYTES:
                    yield _pieces(rows)
                    rows, held = [], 0
            if rows:
                yield _pieces(rows)

    return ArrowStep(cut, T.StructType.fromDDL(PIECE_SCHEMA))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    doc, piece, start, length, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
         pa.array(length, pa.int64()), int_lists(list(ids))],
        names=["doc_id", "piece", "start", "length", "ids"])


class OpenSequences:
    """Segment tree over remaining capacities 0..capacity; a leaf holds runs of equally filled sequences."""

    def __init__(self, capacity: int) -> None:
        self._leaves = 1 << (capacity + 1).bit_length()
        self._open = [0] * (2 * self._leaves)
        self._runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, first: int, count: int) -> None:
        self._runs[remaining].append((first, count))
        self._update(remaining, count)

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` consecutive sequences with this remaining capacity: (first, count)."""
        first, count = self._runs[remaining].pop()
        if count > most:
            self._runs[remaining].append((first + most, count - most))
            count = most
        self._update(remaining, -count)
        return first, count

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity >= ``length`` that has an open sequence."""
        node = length + self._leaves
        if self._open[node]:
            return length
        while node > 1:  # up to the first right-hand sibling with an open sequence
            if not node & 1 and self._open[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self._leaves:  # down to its leftmost open leaf
            node = 2 * node if self._open[2 * node] else 2 * node + 1
        return node - self._leaves

    def _update(self, remaining: int, by: int) -> None:
        node = remaining + self._leaves
        while node:
            self._open[node] += by
            node >>= 1


def plan_best_fit_decreasing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, count), ordered by length and rank."""
    sequences, plan, opened = OpenSequences(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = sequences.tightest(length)
            if room is None:
                room, count = capacity, -(-left // (capacity // length))  # as many as the rest of this length needs
                sequences.add(capacity, opened, count)
                opened += count
            # a sequence that still fits this length is the tightest once it has one of them: fill it up first
            per = min(left, room // length)
            first, count = sequences.take(room, left // per)
            for j in range(per):
                plan.append((length, rank + j * count, first, capacity - room + j * length, count))
            if room > per * length:
                sequences.add(room - per * length, first, count)
            rank, left = rank + per * count, left - per * count
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def best_fit_pack(
    items: DataFrame, capacity: int = 2048, length_column: str = "length", steps: tuple[ArrowStep, ...] = ()
) -> DataFrame:
    """``items`` plus ``sequence_id`` and ``offset`` (gapless from 0 in every sequence).

    ``steps`` make the items out of ``items`` first, in the Python worker that numbers them.
    """
    spark = items.sparkSession
    made = T.StructType([f for f in (steps[-1].schema if steps else items.schema).fields if f.name not in _ADDED])
    numbered = stored(
        run_steps(items if steps else items.drop(*_ADDED), *steps, _number_step(made, capacity, length_column)), "pack_items")
    counts = numbered.groupBy("_part", length_column).agg(F.count("*").alias("n"))
    by_length = Window.partitionBy(length_column).orderBy("_part")  # one row per partition
    bases = counts.select("_part", length_column, (F.sum("n").over(by_length) - F.col("n")).alias("_base"))
    histogram = {r[0]: r[1] for r in counts.groupBy(length_column).agg(F.sum("n")).collect()}  # <= capacity rows
    plan = spark.sparkContext.broadcast(plan_best_fit_decreasing(histogram, capacity))
    names = made.names
    schema = T.StructType([*made.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        keys = table[:, 0] << 44 | table[:, 1] if len(table) else np.zeros(0, np.int64)
        for b in batches:
            column = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            length = column(length_column).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = column("_rank").to_numpy() + column("_base").to_numpy()
            run = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(column(n) for n in names), pa.array(table[run, 2] + rank - table[run, 1]), pa.array(table[run, 3])],
                names=[*names, "sequence_id", "offset"])

    return numbered.join(bases, ["_part", length_column]).mapInArrow(place, schema)


def _number_step(made: T.StructType, capacity: int, length_column: str) -> ArrowStep:
    """Add (_part, _rank): each item's number among those of its length in its partition."""
    schema = T.StructType([*made.fields, T.StructField("_part", T.IntegerType()),
                           T.StructField("_rank", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for b in batches:
            column = chunked(b.column(b.schema.get_field_index(length_column)))
            if b.num_rows and (column.null_count or not 0 < np.min(column) <= np.max(column) <= capacity):
                raise ValueError(f"item lengths must lie in 1..{capacity}")
            length = column.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(length, kind="stable")
            in_order = length[order]
            first = np.searchsorted(in_order, in_order, side="left")
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = np.arange(len(length)) - first + seen[in_order]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(n)) for n in made.names),
                 pa.array(np.full(len(length), part, dtype=np.int32)), pa.array(rank)],
                names=[*made.names, "_part", "_rank"])

    return ArrowStep(number, schema)
