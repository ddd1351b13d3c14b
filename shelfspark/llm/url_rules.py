"""URL rules by a sort-merge range join on reversed-host keys.

A host's labels reversed ("org.example.www.") make every host rule a key
prefix, that is an interval of keys; intervals nest.  URLs are dealt to ranges
of the key order, each rule is copied to the ranges its interval meets, and a
sorted sweep over each range keeps the stack of host rules that are open at
the current key.  The innermost open host with a fitting path decides.

The range bounds come from a bounded sample of keys and only balance the work.
A key that fills several ranges is spread over all of them.

Edge cases: a null URL or one without ``://`` has an empty host and path; a
rule with an empty host covers every host; among rules for the same host and
path a block rule beats an allow rule; no rules give the default verdict; rows
with equal or null ids are judged one by one; an empty table gives no rows;
other columns are kept, clashing names are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import bounded_sample, shuffle_partitions

_OUT = ("host", "path", "rule", "verdict")
_INNER = ("_range", "_key", "_kind", "_rule_path", "_rule_verdict", "_rule_text")


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(url.contains("://"), host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(url.contains("://"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels reversed, each closed by a dot; an empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_column: str = "url",
    default: str = "allow",
    ranges: int | None = None,
    sample_rows: int = 4000,
) -> DataFrame:
    """``pages`` plus host, path, rule and verdict.

    ``rules`` has (host, path, verdict) with verdict allow or block; its hosts
    and paths may be empty, not null.
    """
    spark = pages.sparkSession
    n = ranges or shuffle_partitions(spark)
    pages = pages.drop(*_OUT, *_INNER)
    keyed = (
        pages.withColumn("host", url_host(F.col(url_column)))
        .withColumn("path", url_path(F.col(url_column)))
        .withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
        .withColumn("_key", F.concat(host_key(F.col("host")), F.lit("\0"), F.col("path")))
    )
    spread = F.xxhash64(*[F.col(c) for c in pages.columns])
    sample = sorted(r[0] for r in bounded_sample(keyed, sample_rows, *pages.columns).select("_key").collect())
    bounds = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    if bounds:
        bound_list = F.array(*[F.lit(b) for b in bounds])  # n - 1 keys
        below = F.size(F.filter(bound_list, lambda b: b < F.col("_key")))
        upto = F.size(F.filter(bound_list, lambda b: b <= F.col("_key")))
        keyed = keyed.withColumn("_range", (below + F.pmod(spread, upto - below + 1)).cast("int"))
    else:
        keyed = keyed.withColumn("_range", F.lit(0))
    fields = [*keyed.schema.fields]
    urls = keyed.select(
        "*", F.lit(1).alias("_kind"), *[F.lit(None).cast("string").alias(c) for c in _INNER[3:]])

    def ranges_of(key: str) -> list[int]:
        last = bisect_right(bounds, key + "\U0010ffff")
        return list(range(bisect_left(bounds, key), last + 1))

    openings = T.StructType([
        T.StructField("_range", T.IntegerType()), T.StructField("_key", T.StringType()),
        *(T.StructField(c, T.StringType()) for c in _INNER[3:])])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, key, path, verdict, text) for key, path, verdict, text in zip(*(c.to_pylist() for c in b.columns))
                    for r in ranges_of(key)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.string()] * 4])],
                    names=openings.names)

    dealt = (
        rules.select(host_key(F.col("host")).alias("_key"), F.col("path"), F.col("verdict"),
                     F.concat("host", "path").alias("text"))
        .mapInArrow(opened, openings)
    )
    dealt = dealt.select(
        *[F.col(f.name) if f.name in ("_range", "_key") else F.lit(None).cast(f.dataType).alias(f.name) for f in fields],
        F.lit(0).alias("_kind"), *_INNER[3:])
    both = (urls.unionByName(dealt).repartition(n, "_range")
            .sortWithinPartitions("_range", "_key", "_kind"))
    names = [*pages.columns, "host", "path"]
    schema = T.StructType([*(keyed.schema[c] for c in names), T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, _Host]] = []
        at = None
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            rows, found = [], []
            for i, (r, key, kind, path, p, v, t) in enumerate(zip(*(
                    column(c).to_pylist() for c in ("_range", "_key", "_kind", "path", *_INNER[3:])))):
                if r != at:
                    at, stack = r, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, _Host()))
                    stack[-1][1].add(p, v, t)
                    continue
                rows.append(i)
                found.append(next((x for _, h in reversed(stack) if (x := h.fits(path))), (None, default)))
            if rows:
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(b.schema.get_field_index(c)) for c in names),
                     pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
                    names=[*names, "rule", "verdict"])

    return both.mapInArrow(sweep, schema)


class _Host:
    """The path rules of one open host, by length of the path prefix."""

    def __init__(self) -> None:
        self._by_length: dict[int, dict[str, tuple[str, str]]] = {}
        self._lengths: list[int] = []

    def add(self, path: str, verdict: str, text: str) -> None:
        if len(path) not in self._by_length:
            self._by_length[len(path)] = {}
            self._lengths = sorted(self._by_length, reverse=True)
        own = self._by_length[len(path)]
        if own.get(path, (None, "allow"))[1] == "allow":
            own[path] = (text, verdict)

    def fits(self, path: str) -> tuple[str, str] | None:
        for n in self._lengths:
            if n <= len(path) and (x := self._by_length[n].get(path[:n])):
                return x
        return None
