"""Small helpers shared by the corpus operators: worker-side caches, Arrow building, shared tables."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.session import shared_dir

_CACHE_MODULE = "_shelfspark_llm_worker"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, also across its tasks."""
    module = sys.modules.get(_CACHE_MODULE)
    if module is None:
        module = sys.modules[_CACHE_MODULE] = types.ModuleType(_CACHE_MODULE)
        module.cache = {}
    return module.cache


def free_worker() -> None:
    """Drop what other steps keep in this Python worker and give free memory back to the system.

    A worker outlives its step: without this a tokenizer, its words and the
    allocators' free pages stand beside all that the next steps hold.
    """
    cache = worker_cache()
    for key in [k for k in cache if isinstance(k, tuple)]:  # (kind, hash of its file): encoders
        del cache[key]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``step`` over record batches, with ``free_worker`` before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        yield from step(batches)
        free_worker()

    return run


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes as well as by rows, unless it does so itself.

    A batch of 10,000 whole texts is held by each task as it is built, as it is
    sent and in the worker.  Rows larger than the bound are a batch of their own.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, "4m")


def stored(df: DataFrame, name: str, blobs: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    ``blobs``: rows are large and compressed already.  They are written as they
    are, a row to a page; Parquet's codecs would hold buffers of whole pages,
    and it looks at a page's size only after 100 rows.

    Cuts the lineage: an executor lost later costs a read, not a recomputation.
    Shuffle files of the write are removed when it ends, so a chain of stored
    tables holds one stage's shuffle on disk at a time.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "llm", name, unique=True)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        write = df.write.mode("errorifexists")
        if blobs:
            write = (write.option("compression", "none").option("parquet.page.size.row.check.min", "1")
                     .option("parquet.page.size.row.check.max", "1").option("parquet.enable.dictionary", "false")
                     .option("parquet.block.size", str(16 << 20))
                     .option("parquet.block.size.row.check.min", "1").option("parquet.block.size.row.check.max", "1"))
        write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About ``rows`` rows, never more, chosen by the hash of ``columns``; all rows of a small table.

    A hash bound is applied before the limit, so that tasks together hand on
    about twice the rows asked for, however many tasks there are.
    """
    total = df.count()
    h = F.xxhash64(*columns)
    likely = F.pmod(h, F.lit(1 << 30)) < int(min(1.0, 2.0 * rows / max(1, total)) * (1 << 30))
    return df.where(likely).withColumn("_h", h).orderBy("_h").limit(rows).drop("_h")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class ArrowStep(NamedTuple):
    """A function over record batches and the schema of what it gives."""

    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: T.StructType


def run_steps(df: DataFrame, *steps: ArrowStep) -> DataFrame:
    """Apply steps one after another in one Python worker (one transfer in, one out)."""
    bounded_batches(df.sparkSession)
    functions = [s.function for s in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in functions:
            batches = f(batches)
        return batches

    return df.mapInArrow(run, steps[-1].schema) if steps else df


def id_order(doc_id) -> tuple:
    """Sort key of a nullable id: null first."""
    return (doc_id is not None, doc_id if doc_id is not None else 0)


def string_values(column: pa.Array) -> Iterator[str | None]:
    """Python strings of a string column, one at a time (no list of the whole batch)."""
    for x in column:
        yield x.as_py()


def slices_by_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices that end with the row that reaches ``limit`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = before = 0
    while lo < len(column):
        hi = min(int(np.searchsorted(ends, before + limit)) + 1, len(column))
        yield lo, hi - lo
        lo, before = hi, int(ends[hi - 1])


def joined_text(values: pa.Array, sign: str) -> str:
    """All strings of a column as one, without a Python string of each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), sign)[0].as_py()


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size - 1`` of all ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def int_lists(rows: list[bytes]) -> pa.ListArray:
    """A list<int32> array from one little-endian 32-bit buffer per row."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) >> 2 for r in rows], out=offsets[1:])
    values = np.frombuffer(b"".join(rows), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))


def list_buffers(column: pa.ListArray) -> Iterator[memoryview]:
    """One contiguous little-endian 32-bit buffer per row of a list<int32> column."""
    offsets = column.offsets.to_numpy()
    values = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), dtype="<i4")
    view = memoryview(values).cast("B")
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield view[4 * lo:4 * hi]


def chunked(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def batches_of(rows: Iterable[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from dicts."""
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
