"""Removal of repeated byte strings by a distributed, common-prefix-aware suffix merge sort.

Every byte covered by a ``window``-byte string that also starts earlier
(smaller document id, or the same document further left) goes.  Sorting every
suffix would move the corpus many times over, so the suffix array is sparse:

* Each window has an anchor, the leftmost of its ``gram``-byte strings with the
  smallest hash.  Consecutive windows with one anchor form a group; equal
  windows have equal anchors, so only groups whose anchor gram occurs with
  another one can hold repeats.  Hashes of grams and of whole groups are
  exchanged first; what occurs once in the corpus is never moved.
* The suffixes at which the remaining groups start are sorted in each block,
  front-coded, cut at common splitters and exchanged; loser trees merge the
  runs by their known common prefixes, never comparing a known prefix again.
  Neighbours that share the whole group are repeats but for the earliest.
* A group that meets its anchor gram in different surroundings (the borders of
  a repeated passage) is judged window by window, by 96-bit hashes.

Blocks of documents (hashed by row) are the unit of work; each is one row of a
stored table, and nothing is proportional to the square of a repeat's copies:
a block sends each different group or window once.

Edge cases: a null text is empty; a null id sorts before all others; rows with
equal ids are ordered by block and text; texts shorter than the window stay
whole; matches never cross documents; an empty table gives no rows; other
columns are carried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import bounded_batches, free_worker, lean, stored
from shelfspark.llm.rolling import Substrings, byte_values, mix

_PLACE = np.uint64((1 << 20) - 1)
_CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SAMPLE_BLOCKS, _SAMPLE_EACH = 64, 256
_FIRST_ID = -(1 << 63)
#: A task deals about so many bytes of rows to blocks at a time.
_DEALT_BYTES = 16 << 20


# ---------------------------------------------------------------- blocks


def pack_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, data): one row per block, its documents as a compressed Arrow stream ordered by id and text."""

    def write(table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _DEALT_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dealt in gather(batches):
            block = dealt.column(0).to_numpy()
            rest = dealt.select(dealt.schema.names[1:])
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[rows[0]]], pa.int32()),
                     pa.array([write(rest.take(pa.array(rows)))], pa.binary())],
                    names=["block", "data"])

    def join(parts: pa.Table) -> pa.Table:
        free_worker()
        table = pa.concat_tables(read_block(x) for x in parts["data"])
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        return pa.table({"block": pa.array([parts["block"][0].as_py()], pa.int32()), "data": pa.array([write(table)], pa.binary())})

    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    schema = "block int, data binary"
    return docs.select(spread, "*").mapInArrow(lean(pack), schema).groupBy("block").applyInArrow(join, schema)


def read_block(data: pa.Scalar | bytes) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer() if isinstance(data, pa.Scalar) else data).read_all()


def block_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each document and the end, ids with null as the smallest)."""
    texts = table["text"].cast(pa.large_binary()).combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    ids = table["doc_id"].fill_null(_FIRST_ID).to_numpy()
    return data, offsets - offsets[0], ids


# ---------------------------------------------------------------- anchors


def anchor_groups(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple]:
    """(first window, last window, anchor hash, group hash, hashes by position) of a block, chunk by chunk.

    Positions count from the block's first byte; the last item gives hashes of
    windows by position.
    """
    table, second = byte_values(1), byte_values(2)
    doc, n_docs = 0, len(offsets) - 1
    while doc < n_docs:
        lo, hi = offsets[doc], offsets[doc + 1]
        if hi - lo > _CHUNK:  # a long document: overlapping slices of window starts
            for start in range(int(lo), int(hi) - window + 1, _CHUNK):
                stop = min(int(hi), start + _CHUNK + window - 1)
                yield from _chunk_groups(data, start, np.array([start, stop]), window, gram, table, second)
            doc += 1
            continue
        last = int(np.searchsorted(offsets, lo + _CHUNK, side="right")) - 1
        last = max(last, doc + 1)
        yield from _chunk_groups(data, int(lo), offsets[doc:last + 1], window, gram, table, second)
        doc = last


def _chunk_groups(data, base, bounds, window, gram, table, second) -> Iterator[tuple]:
    x = data[base:bounds[-1]]
    if len(x) < window:
        return
    sums = Substrings(table[x])
    hashes = sums.of_length(gram)
    least = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, window - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:span - width], least[width - span:])
    at = (least & _PLACE).astype(np.int64)
    valid = np.zeros(len(at), dtype=bool)
    begins = np.zeros(len(at) + 1, dtype=bool)
    begins[1:-1] = at[1:] != at[:-1]
    for a, b in zip((bounds[:-1] - base).tolist(), (bounds[1:] - base).tolist()):
        if b - a >= window:
            valid[a:b - window + 1] = True
            begins[a] = True
    ends = valid.copy()
    ends[:-1] &= begins[1:-1] | ~valid[1:]
    first, last = np.flatnonzero(valid & begins[:-1]), np.flatnonzero(ends)
    anchor = at[first]
    whole = sums.of(first, last + window)
    whole = mix(whole + (anchor - first).astype(np.uint64) * _ODD + (last - first).astype(np.uint64))

    def window_hashes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the sums are made again for the few chunks that ask: a block would keep eight bytes for each of its own
        return tuple(Substrings(t[x]).of(p - base, p - base + window) for t in (table, second))

    yield first + base, last + base, hashes[anchor], whole, window_hashes


def _unique_groups(gram_hash: np.ndarray, group_hash: np.ndarray, buckets: int):
    """Different (gram, group) hash pairs ordered by (bucket, gram, group): bucket cuts, pairs, inverse, counts."""
    bucket = (gram_hash % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((group_hash, gram_hash, bucket))
    g, w, b = gram_hash[order], group_hash[order], bucket[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return b[new], g[new], w[new], inverse, np.bincount(inverse, minlength=int(new.sum()))


# ---------------------------------------------------------------- repeated hashes


def find_repeated(blocks: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """(block, bucket, data): for each different group of a block, whether it (1) or its gram in other groups (2) repeats.

    Block -1 holds sampled group texts for splitters.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, offsets, _ = block_texts(read_block(packed))
                found = list(anchor_groups(data, offsets, window, gram))
                if not found:
                    continue
                first, last, g, w = (np.concatenate([f[i] for f in found]) for i in range(4))
                bucket, g, w, _, _ = _unique_groups(g, w, buckets)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                rows = [(int(bucket[s[0]]), block, g[s].tobytes() + w[s].tobytes())
                        for s in np.split(np.arange(len(bucket)), cuts)]
                if block < _SAMPLE_BLOCKS:
                    some = np.arange(_SAMPLE_EACH) * len(first) // _SAMPLE_EACH
                    texts = [data[first[i]:first[i] + window].tobytes() for i in dict.fromkeys(some.tolist())]
                    rows.append((-1, block, b"".join(texts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))],
                    names=["bucket", "block", "data"])

    def repeated(t: pa.Table) -> pa.Table:
        free_worker()
        bucket = t["bucket"][0].as_py()
        if bucket < 0:
            return pa.table({"block": pa.array([-1], pa.int32()), "bucket": pa.array([-1], pa.int32()),
                             "data": pa.array([b"".join(t["data"].to_pylist())], pa.binary())})
        parts = [np.frombuffer(x, dtype=np.uint64).reshape(2, -1) for x in t["data"].to_pylist()]
        both = np.concatenate(parts, axis=1)
        order = np.lexsort((both[1], both[0]))
        g, w = both[0][order], both[1][order]
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_w = new_g | np.concatenate([[True], w[1:] != w[:-1]])
        of_w, of_g = np.cumsum(new_w) - 1, np.cumsum(new_g) - 1
        many = np.bincount(of_w)[of_w] > 1
        mixed = np.bincount(of_g[new_w])[of_g] > 1
        flags = np.empty(len(order), dtype=np.uint8)
        flags[order] = many + 2 * mixed
        ends = np.cumsum([p.shape[1] for p in parts])
        return pa.table({"block": t["block"].cast(pa.int32()), "bucket": t["bucket"].cast(pa.int32()),
                         "data": pa.array([x.tobytes() for x in np.split(flags, ends[:-1])], pa.binary())})

    schema = "bucket int, block int, data binary"
    return blocks.mapInArrow(lean(hashes), schema).groupBy("bucket").applyInArrow(repeated, "block int, bucket int, data binary")


# ---------------------------------------------------------------- sorted runs

#: Where an item is: document id, block, document's place in it, first and last window.
_ITEM = np.dtype([("id", "<i8"), ("block", "<i4"), ("doc", "<i4"), ("first", "<i8"), ("last", "<i8")])
_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("id", "<i8"), ("block", "<i4"), ("doc", "<i4"), ("at", "<i8")])
_SPAN = np.dtype([("doc", "<i4"), ("lo", "<i8"), ("hi", "<i8")])


def squeeze(data: bytes) -> bytes:
    """zstd with the length in front."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def squeeze_records(records: np.ndarray) -> bytes:
    """Records column by column, so that what is alike stands together."""
    return squeeze(b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names))


def unsqueeze_records(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = unsqueeze(data)
    out, at = np.empty(len(raw) // kind.itemsize, dtype=kind), 0
    for f in kind.names:
        out[f] = np.frombuffer(raw, dtype=kind[f], count=len(out), offset=at)
        at += len(out) * kind[f].itemsize
    return out


def common_prefixes(texts: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each text with the one before (0 for the first)."""
    found = np.zeros(len(texts), dtype=np.int64)
    for lo in range(0, len(texts), 8192):
        part = texts[max(0, lo - 1):lo + 8192]
        sizes = np.array([len(t) for t in part])
        grid = np.zeros((len(part), sizes.max() + 1), dtype=np.uint8)
        inside = np.arange(grid.shape[1]) < sizes[:, None]
        grid[inside] = np.frombuffer(b"".join(part), dtype=np.uint8)
        differ = (grid[1:] != grid[:-1]) | ~inside[1:] | ~inside[:-1]
        found[max(1, lo):lo + 8192] = differ.argmax(axis=1)
    return found


def front_code(texts: list[bytes], items: np.ndarray) -> bytes:
    """A sorted run: common prefix lengths, tail lengths, items, tails."""
    prefixes = common_prefixes(texts)
    tails = [t[n:] for t, n in zip(texts, prefixes.tolist())]
    return b"".join([np.int64(len(texts)).tobytes(), prefixes.astype("<u4").tobytes(),
                     np.array([len(t) for t in tails], dtype="<u4").tobytes(), items.tobytes(), *tails])


class Run:
    """Reads a front-coded run: ``text`` is the current suffix, ``shared`` its common prefix with the one before."""

    def __init__(self, coded: bytes) -> None:
        n = int(np.frombuffer(coded, dtype="<i8", count=1)[0])
        self._prefixes = np.frombuffer(coded, dtype="<u4", count=n, offset=8).tolist()
        self._sizes = np.frombuffer(coded, dtype="<u4", count=n, offset=8 + 4 * n).tolist()
        self.items = np.frombuffer(coded, dtype=_ITEM, count=n, offset=8 + 8 * n)
        self._coded, self._from, self._n = coded, 8 + 8 * n + n * _ITEM.itemsize, n
        self.at, self.text, self.shared = -1, b"", 0

    def advance(self) -> bool:
        self.at += 1
        if self.at >= self._n:
            return False
        size = self._sizes[self.at]
        self.shared = self._prefixes[self.at]
        self.text = self.text[:self.shared] + self._coded[self._from:self._from + size]
        self._from += size
        return True


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        middle = (lo + hi) >> 1
        if a[lo:middle] == b[lo:middle]:
            lo = middle
        else:
            hi = middle
    return lo


def merge_runs(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    """Runs merged by a loser tree: the run with the next suffix and its common prefix with the last one.

    A node keeps the run that lost there and the length it shares with the run
    that won.  Two suffixes with different shared lengths are ordered by them;
    equal lengths are compared from there on.
    """
    leaves = 1 << max(0, (len(runs) - 1).bit_length())
    shared = [-1] * leaves  # of each run with the last suffix given out; -1: run is over
    for i, r in enumerate(runs):
        if r.advance():
            shared[i] = 0
    losers = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        na, nb = shared[a], shared[b]
        if na != nb:
            return (a, b) if na > nb else (b, a)
        if na < 0:
            return a, b
        x, y = runs[a].text, runs[b].text
        n = _common(x, y, na)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = list(range(leaves))
    width = leaves
    while width > 1:
        width >>= 1
        rows = []
        for i in range(width):
            w, losers[width + i] = play(winners[2 * i], winners[2 * i + 1])
            rows.append(w)
        winners = rows
    best = winners[0]
    while shared[best] >= 0:
        run = runs[best]
        yield run, shared[best]
        shared[best] = run.shared if run.advance() else -1
        node = (leaves + best) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


def sort_and_judge(
    blocks: DataFrame, repeated: DataFrame, splitters: list[bytes], buckets: int, window: int, gram: int
) -> DataFrame:
    """(kind, dest, block, data): repeats within a block (0), front-coded runs by range (1), windows by bucket (2)."""

    def judge(packed: pa.Table, flagged: pa.Table) -> pa.Table:
        free_worker()
        rows: list[tuple] = []
        if len(packed) and len(flagged):
            flags = dict(zip(flagged["bucket"].to_pylist(), flagged["data"].to_pylist()))
            rows = _judge_block(packed["block"][0].as_py(), packed["data"][0], flags, splitters, buckets, window, gram)
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(
            (("kind", pa.int32()), ("dest", pa.int32()), ("block", pa.int32()), ("data", pa.binary())))})

    return (blocks.groupBy("block").cogroup(repeated.groupBy("block"))
            .applyInArrow(judge, "kind int, dest int, block int, data binary"))


def _judge_block(block, packed, flags, splitters, buckets, window, gram) -> list[tuple]:
    data, offsets, ids = block_texts(read_block(packed))
    found = list(anchor_groups(data, offsets, window, gram))
    if not found:
        return []
    first, last, g, w = (np.concatenate([f[i] for f in found]) for i in range(4))
    chunk = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
    bucket, _, _, inverse, counts = _unique_groups(g, w, buckets)
    flag = np.frombuffer(b"".join(flags[b] for b in np.unique(bucket).tolist()), dtype=np.uint8)[inverse]
    doc = np.searchsorted(offsets, first, side="right") - 1
    again = (flag & 1 == 1) | (counts[inverse] > 1)
    places = np.flatnonzero(again)
    texts = [data[a:b].tobytes() for a, b in zip(first[places].tolist(), (last[places] + window).tolist())]
    order = sorted(range(len(texts)), key=texts.__getitem__)  # stable: equal texts stay in document order
    lead = np.ones(len(flag), dtype=bool)  # the block's first of its group
    for i, j in zip(order, order[1:]):
        if texts[i] == texts[j]:
            lead[places[j]] = False
    spans = [(doc[~lead], first[~lead], last[~lead] + window)]
    rows = []
    items = np.empty(len(first), dtype=_ITEM)
    items["id"], items["block"], items["doc"] = ids[doc], block, doc
    items["first"], items["last"] = first - offsets[doc], last - offsets[doc]
    sent = [i for i in order if lead[places[i]] and flag[places[i]] & 1]
    run = [texts[i] for i in sent]
    cuts = [0, *(bisect_left(run, s) for s in splitters), len(run)]
    for dest, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            rows.append((1, dest, block, squeeze(front_code(run[a:b], items[places[sent[a:b]]]))))
    single = np.flatnonzero(lead & (flag >= 2))
    windows = []
    for c in np.unique(chunk[single]).tolist():
        own = single[chunk[single] == c]
        sizes = last[own] - first[own] + 1
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[own], sizes)
        part = np.empty(len(at), dtype=_WINDOW)
        part["h1"], second = found[c][4](at)
        part["h2"] = second >> np.uint64(32)
        of = np.repeat(doc[own], sizes)
        part["id"], part["block"], part["doc"], part["at"] = ids[of], block, of, at - offsets[of]
        windows.append(part)
    if windows:
        part = np.concatenate(windows)
        keep = _first_windows(part)
        late = part[~keep]
        start = late["at"] + offsets[late["doc"]]
        spans.append((late["doc"], start, start + window))
        part = part[keep]
        part = part[np.argsort(part["h1"] % np.uint64(buckets), kind="stable")]
        dest = (part["h1"] % np.uint64(buckets)).astype(np.int64)
        for s in np.split(np.arange(len(part)), np.flatnonzero(np.diff(dest)) + 1):
            rows.append((2, int(dest[s[0]]), block, squeeze_records(part[s])))
    docs, lo, hi = (np.concatenate([s[i] for s in spans]) for i in range(3))
    if len(docs):
        rows.append((0, block, block, _spans(docs, lo - offsets[docs], hi - offsets[docs])))
    return rows


def _first_windows(part: np.ndarray) -> np.ndarray:
    """Whether each window is the earliest of its hash."""
    order = np.lexsort((part["at"], part["doc"], part["block"], part["id"], part["h2"], part["h1"]))
    h1, h2 = part["h1"][order], part["h2"][order]
    new = np.ones(len(part), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    keep = np.empty(len(part), dtype=bool)
    keep[order] = new
    return keep


def _spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    out = np.empty(len(doc), dtype=_SPAN)
    out["doc"], out["lo"], out["hi"] = doc, lo, hi
    return squeeze_records(out)


def merge_and_compare(judged: DataFrame, window: int) -> DataFrame:
    """(block, data): spans that repeat something earlier, in the same block or another."""

    def compare(t: pa.Table) -> pa.Table:
        free_worker()
        coded = t["data"].to_pylist()
        if t["kind"][0].as_py() == 0:
            return t.select(["block", "data"])
        if t["kind"][0].as_py() == 1:
            late = _late_items([Run(unsqueeze(c)) for c in coded])
            doc, block, lo, hi = late["doc"], late["block"], late["first"], late["last"] + window
        else:
            part = np.concatenate([unsqueeze_records(c, _WINDOW) for c in coded])
            late = part[~_first_windows(part)]
            doc, block, lo, hi = late["doc"], late["block"], late["at"], late["at"] + window
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        parts = [s for s in np.split(order, cuts) if len(s)]
        return pa.table({"block": pa.array([int(block[s[0]]) for s in parts], pa.int32()),
                         "data": pa.array([_spans(doc[s], lo[s], hi[s]) for s in parts], pa.binary())})

    return judged.groupBy("kind", "dest").applyInArrow(compare, "block int, data binary")


def _late_items(runs: list[Run]) -> np.ndarray:
    """All items of merged runs whose whole text an earlier item has."""
    late: list[np.ndarray] = []
    held: list[np.void] = []
    size = -1

    def close() -> None:
        if len(held) > 1:
            earliest = min(range(len(held)), key=lambda i: held[i].item()[:4])
            late.extend(x for i, x in enumerate(held) if i != earliest)

    for run, shared in merge_runs(runs):
        if not (shared == size == len(run.text)):
            close()
            held, size = [], len(run.text)
        held.append(run.items[run.at])
    close()
    return np.array(late, dtype=_ITEM)


# ---------------------------------------------------------------- removal


def remove_spans(blocks: DataFrame, spans: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """The documents without their spans: ``kept`` bytes, ``n_bytes`` before and the ``removed`` spans."""
    names = [f.name for f in fields]
    schema = T.StructType([
        *fields, T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()),
        T.StructField("removed", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def remove(packed: pa.Table, found: pa.Table) -> pa.Table:
        free_worker()
        table = read_block(packed["data"][0])
        data, offsets, _ = block_texts(table)
        change = np.zeros(len(data) + 1, dtype=np.int32)
        for x in found["data"].to_pylist():
            s = unsqueeze_records(x, _SPAN)
            np.add.at(change, offsets[s["doc"]] + s["lo"], 1)
            np.add.at(change, offsets[s["doc"]] + s["hi"], -1)
        gone = np.cumsum(change[:-1]) > 0
        border = np.zeros(len(data) + 1, dtype=bool)
        border[offsets] = True
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
        starts = np.flatnonzero(gone & (~before | border[:-1]))
        ends = np.flatnonzero(gone & (~after | border[1:])) + 1
        left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        kept = data[~gone]
        of = np.searchsorted(offsets, starts, side="right") - 1
        per = np.searchsorted(starts, offsets, side="left").astype(np.int32)
        removed = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays(
            [pa.array(starts - offsets[of]), pa.array(ends - offsets[of])], names=["start", "end"]))
        texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                      [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))])
        return pa.table([*(table[n] for n in names), pa.array(np.diff(offsets)), texts.cast(pa.binary()), removed],
                        names=[*names, "n_bytes", "kept", "removed"])

    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(remove, schema)


def remove_repeats(
    docs: DataFrame, window: int = 100, gram: int = 48, block_bytes: int = 4 << 20, range_bytes: int = 16 << 20
) -> DataFrame:
    """Every column but ``text``, plus n_bytes, kept (bytes) and removed (spans) of every document."""
    names = [c for c in docs.columns if c not in ("n_bytes", "kept", "removed")]
    docs = docs.select(*names).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    bounded_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // range_bytes))
    packed = stored(pack_blocks(docs, blocks), "blocks", blobs=True)
    repeated = stored(find_repeated(packed, buckets, window, gram), "repeated", blobs=True)
    sample = repeated.where("block = -1").select("data").first()  # at most a few MB, whatever the corpus
    texts = sorted({sample[0][i:i + window] for i in range(0, len(sample[0]), window)}) if sample else []
    splitters = [bytes(texts[len(texts) * i // buckets]) for i in range(1, buckets)] if texts else []
    judged = sort_and_judge(packed, repeated.where("block >= 0"), splitters, buckets, window, gram)
    spans = stored(merge_and_compare(judged, window), "spans", blobs=True)  # exchanged once, not kept beside that
    return remove_spans(packed, spans, [f for f in docs.schema.fields if f.name != "text"])
