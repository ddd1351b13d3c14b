"""Vector index as a merge-on-read table in hash buckets.

* A write of m rows writes m rows: the batch is reduced to its last row per key,
  dealt into buckets by the key's hash and stored as files of its own, delete
  markers among them.  No stored row is touched.
* A version lists which writes hold rows of which bucket.  It becomes visible when
  it is complete, so a failed write is never read and a reader keeps the files of
  the version that it opened.  One writer at a time: a second one finds the
  version's folder taken and fails.
* Readers take the newest row per key.  Buckets with one write hold each key once
  and are read as they are; in the others the newest write per key (an aggregate of
  keys alone) picks the rows.
* ``compact_index`` rewrites the buckets that hold more than ``most`` writes, and
  only those; ``upsert_index`` and ``delete_points`` call it.
* Rows lie ordered by ``partition_col`` in their files, so row groups are skipped.

Rows without a key are not stored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from shelfspark.session import complete_versions, delete_path, mark_complete

BUCKETS = 16
MOST_WRITES = 4
_PARTS = "write string, bucket int, points long"
_META = "`key` string, buckets int, rows_schema string"


class _Version:
    """The newest complete version: its number, live parts and layout."""

    def __init__(self, spark: SparkSession, root: str):
        names = complete_versions(spark, f"{root}/versions")
        self.number = int(names[-1][1:]) if names else 0
        taken = complete_versions(spark, f"{root}/versions", unfinished=True)
        self.next = int(taken[-1][1:]) + 1 if taken else 1  # a version that broke off keeps its number
        self.parts: list[tuple[str, int, int]] = []
        self.key, self.buckets, self.schema = "id", BUCKETS, StructType()
        if names:
            path = _version_path(root, self.number)
            self.parts = [tuple(r) for r in spark.read.schema(_PARTS).parquet(f"{path}/parts").collect()]
            meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
            self.key, self.buckets, self.schema = meta["key"], meta["buckets"], StructType.fromJson(json.loads(meta["rows_schema"]))


def _version_path(root: str, number: int) -> str:
    return f"{root}/versions/v{number:010d}"


def _merged_schema(old: StructType, new: StructType) -> StructType:
    """Old columns, then new ones; all nullable (a delete marker holds the key alone)."""
    out = StructType()
    for f in [*old, *[f for f in new if f.name not in old.names]]:
        out.add(f.name, f.dataType, True)
    return out


def _rows(spark: SparkSession, root: str, v: _Version, parts: list[tuple[str, int, int]]) -> DataFrame:
    stored = StructType([*v.schema]).add("_seq", LongType()).add("_deleted", BooleanType())
    if not parts:
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).parquet(*[f"{root}/data/{w}/bucket={b}" for w, b, _ in parts])


def _newest(spark: SparkSession, root: str, v: _Version, parts: list[tuple[str, int, int]]) -> DataFrame:
    """The newest row of each key in ``parts``, delete markers left out."""
    writes: dict[int, int] = {}
    for _, b, _ in parts:
        writes[b] = writes.get(b, 0) + 1
    plain = _rows(spark, root, v, [p for p in parts if writes[p[1]] == 1])
    several = [p for p in parts if writes[p[1]] > 1]
    if several:
        rows = _rows(spark, root, v, several)
        last = rows.groupBy(v.key).agg(F.max("_seq").alias("_seq"))  # a write holds a key once
        plain = plain.unionByName(rows.join(last, [v.key, "_seq"], "left_semi"))
    return plain.where(~F.col("_deleted")).drop("_deleted")


def read_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of the newest version; None before the first write."""
    root = root.rstrip("/")
    v = _Version(spark, root)
    return _newest(spark, root, v, v.parts).drop("_seq") if v.number else None


def _bucket(v: _Version) -> Column:
    return F.pmod(F.xxhash64(v.key), F.lit(v.buckets)).cast("int")


def _write(spark: SparkSession, root: str, rows: DataFrame, v: _Version, sort: str | None,
           placed: bool = False) -> list[tuple[str, int, int]]:
    """Store ``rows`` (with ``_seq`` and ``_deleted``) in their buckets as one write; its parts.

    ``placed``: ``rows`` lie by bucket already (column ``bucket``) and are not exchanged again.
    """
    write = uuid.uuid4().hex[:12]
    order = ["bucket", *([sort] if sort in rows.columns else [])]
    dealt = rows
    if not placed:  # by size: a large bucket is many files
        dealt = rows.withColumn("bucket", _bucket(v)).hint("rebalance", F.col("bucket"))
    dealt = dealt.sortWithinPartitions(*order)
    dealt.write.partitionBy("bucket").parquet(f"{root}/data/{write}")
    if not _has_buckets(spark, f"{root}/data/{write}"):
        return []
    counts = spark.read.schema("bucket int").parquet(f"{root}/data/{write}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return [(write, r["bucket"], r["n"]) for r in counts.collect()]  # one row per bucket


def _has_buckets(spark: SparkSession, path: str) -> bool:
    """Whether a write left any bucket (an empty batch leaves none)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(s.isDirectory() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def _publish(spark: SparkSession, root: str, number: int, v: _Version, parts: list[tuple[str, int, int]]) -> str:
    path = _version_path(root, number)
    spark.createDataFrame(parts, _PARTS).coalesce(1).write.parquet(f"{path}/parts")
    spark.createDataFrame([(v.key, v.buckets, v.schema.json())], _META).coalesce(1).write.parquet(f"{path}/meta")
    mark_complete(spark, path)
    return path


def upsert_index(spark: SparkSession, root: str, points: DataFrame, order_col: str, key: str = "id",
                 recreate: bool = False, partition_col: str = "main_category", buckets: int = BUCKETS,
                 most: int = MOST_WRITES) -> str:
    """Write ``points`` into the index at ``root``; returns the new version's path.

    ``order_col`` says which of several rows of one key came last; it is not stored.
    ``recreate`` starts from an empty index; ``key`` and ``buckets`` are fixed then.
    """
    root = root.rstrip("/")
    v = _Version(spark, root)
    cols = [c for c in points.columns if c != order_col]
    if recreate or not v.number:
        v.parts, v.key, v.buckets, v.schema = [], key, buckets, StructType()
    v.schema = _merged_schema(v.schema, points.select(*cols).schema)
    number = v.next
    # the rows move once: a bucket is dealt into shares by another part of the key's hash, the last row per key is
    # taken in each share, and the shares are written where they lie
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // v.buckets)
    share = F.pmod(F.shiftright(F.xxhash64(v.key), 32), F.lit(shares)).cast("int")
    dealt = points.where(F.col(v.key).isNotNull()).withColumns({"_bucket": _bucket(v), "_share": share}).repartition("_bucket", "_share")
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col))
    points = dealt.groupBy("_bucket", "_share", v.key).agg(last.alias("_r")).select("_r.*", F.col("_bucket").alias("bucket"))
    fresh = _write(spark, root, points.withColumns({"_seq": F.lit(number).cast("long"), "_deleted": F.lit(False)}), v,
                   partition_col, placed=True)
    path = _publish(spark, root, number, v, v.parts + fresh)
    return compact_index(spark, root, most, partition_col) or path


def delete_points(spark: SparkSession, root: str, keys: DataFrame, most: int = MOST_WRITES) -> str | None:
    """Mark the keys in ``keys`` as deleted; returns the new version's path (None without an index)."""
    root = root.rstrip("/")
    v = _Version(spark, root)
    if not v.number:
        return None
    number = v.next
    marks = keys.select(v.key).where(F.col(v.key).isNotNull()).distinct()
    fresh = _write(spark, root, marks.withColumns({"_seq": F.lit(number).cast("long"), "_deleted": F.lit(True)}), v, None)
    path = _publish(spark, root, number, v, v.parts + fresh)
    return compact_index(spark, root, most) or path


def compact_index(spark: SparkSession, root: str, most: int = MOST_WRITES, partition_col: str = "main_category") -> str | None:
    """Rewrite the buckets of more than ``most`` writes into one; the new version's path, None if there is none."""
    root = root.rstrip("/")
    v = _Version(spark, root)
    writes: dict[int, int] = {}
    for _, b, _ in v.parts:
        writes[b] = writes.get(b, 0) + 1
    full = {b for b, n in writes.items() if n > most}
    if not full:
        return None
    kept = _newest(spark, root, v, [p for p in v.parts if p[1] in full]).withColumn("_deleted", F.lit(False))
    fresh = _write(spark, root, kept, v, partition_col)
    return _publish(spark, root, v.next, v, [p for p in v.parts if p[1] not in full] + fresh)


def vacuum_index(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions and the writes that none of them names; how many folders went."""
    root = root.rstrip("/")
    names = complete_versions(spark, f"{root}/versions")
    if keep < 1:
        raise ValueError("keep at least one version")
    named = lambda vs: {r["write"] for n in vs for r in
                        spark.read.schema(_PARTS).parquet(f"{root}/versions/{n}/parts").select("write").distinct().collect()}
    gone = [f"{root}/data/{w}" for w in sorted(named(names[:-keep]) - named(names[-keep:]))]
    gone += [f"{root}/versions/{n}" for n in names[:-keep]]
    for path in gone:
        delete_path(spark, path)
    return len(gone)


def index_info(spark: SparkSession, root: str) -> DataFrame:
    """Point count (and partitions) of the newest index version."""
    idx = read_index(spark, root)
    if idx is None:
        return spark.createDataFrame([(0, 0)], "points long, categories long")
    return idx.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("main_category").alias("categories"))
