"""Token ids in ORC: run-length coded stripes, row indexes and Bloom filters on document ids.

``write_token_orc`` range-partitions documents by id, encodes them in id order
and writes one ORC file per range.  ORC stores the ids with its integer
run-length encoding, cut into stripes that tasks read in parallel; row indexes
(min/max per row group) and a Bloom filter on ``doc_id`` let a reader that asks
for some documents skip files, stripes and row groups by their metadata.

Edge cases: a null or empty text has the end id only; null ids sort first;
rows with equal ids are kept and ordered by text; an empty table gives an
empty file set with the schema; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import shuffle_partitions, slices_by_bytes
from shelfspark.llm.tokens import read_tokenizer, worker_encoder

ORC_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
_SLICE_BYTES = 4 << 20


def write_token_orc(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    partitions: int | None = None,
    stripe_bytes: int = 16 << 20,
    row_index_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode every whole text and write the ids as ORC in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(partitions or shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(spec.value)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, n in slices_by_bytes(batch.column(1), _SLICE_BYTES):
                ids, sizes = encoder.encode_column(batch.column(1).slice(lo, n))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                yield _encoded(batch.column(0).slice(lo, n), part, start, ids, sizes + 1)
                start += len(ids)

    (ordered.mapInArrow(encode, ORC_SCHEMA).write.mode("errorifexists")
     .option("compression", "zstd")
     .option("orc.stripe.size", str(stripe_bytes))
     .option("orc.create.index", "true")
     .option("orc.row.index.stride", str(row_index_stride))
     .option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", str(bloom_fpp))
     .orc(path))


def _encoded(doc_ids: pa.Array, part: int, start: int, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(start + ends - sizes),
         pa.array(sizes.astype(np.int32)), lists],
        names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids.

    ``doc_ids`` asks for some documents: the filter reaches the ORC scan, which
    skips what row indexes and Bloom filters rule out.  ``start`` adds each
    range's offset, a prefix sum over one row per written file.
    """
    rows = spark.read.schema(ORC_SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # one row per file
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")
