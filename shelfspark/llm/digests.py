"""Digest columns that the registered queries derive from the operators' outputs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfspark.llm.common import ArrowStep, list_buffers, run_steps


def crc32_step(schema: T.StructType, column: str = "ids") -> ArrowStep:
    """Replace an id list by (n_ids long, ids_crc32 long)."""
    kept = [f for f in schema.fields if f.name != column]
    names = [f.name for f in kept]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index(column))
            crc = np.fromiter((zlib.crc32(x) for x in list_buffers(lists)), dtype=np.int64, count=len(lists))
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(sizes), pa.array(crc)],
                names=[*names, "n_ids", "ids_crc32"])

    return ArrowStep(digest, T.StructType([*kept, T.StructField("n_ids", T.LongType()),
                                           T.StructField("ids_crc32", T.LongType())]))


def with_ids_crc32(df: DataFrame, column: str = "ids") -> DataFrame:
    return run_steps(df, crc32_step(df.schema, column))
