"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is its five-word shingles weighted by their counts.  Every shingle
starts a Poisson process whose rate is its weight; each arrival hits one
register, a register keeps the shingle that came first, and a shingle stops
once its next arrival is later than every register's first.  Two signatures
agree in a register with the probability Jaccard similarity of the documents.  A text
that repeats a shingle has a second signature in which all weights are 1 (two
of these agree with the Jaccard similarity of the shingle sets; without repeats
both are the same), so either measure that verification accepts finds candidates.

Exact copies (equal words) are one node from the start.  Bands of registers
give buckets; members of a bucket are compared with its most central member
first, and from then on only across components, so that a large group of near
copies is linked by its centre and no candidate link between components is
lost.  Members of large buckets that are still apart form clusters; a cluster is
dealt into blocks, and one task compares two blocks: it adds up what every two
texts share, verifies the pairs that can be near, and gives out no more links
than join its components, so rows stay linear in the members.  Candidates are
verified on their whole texts: probability Jaccard of the counts, or Jaccard of
the shingle sets, of at least the threshold.  Classes are the connected components.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters
in the lower-cased text; a shorter text is one shingle of all its words.

Edge cases: documents without words (null, empty, signs only) are classes of
their own; documents with a null id have a null class; rows that share an id are
documents of their own, each judged by its text; repeated rows are all returned;
an empty table gives no rows; texts of any length are read whole; other columns
are ignored, or kept by ``one_of_each_class``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import bounded_batches, free_worker, lean, stored
from shelfspark.llm.components import connected_components
from shelfspark.llm.rolling import Substrings, byte_values, mix

SHINGLE_WORDS = 5
_SLICE = 1 << 20
_ARRIVALS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found, lo, table = [], 0, byte_values()
    while lo < len(data):
        hi = min(len(data), lo + _SLICE)
        while hi < len(data) and _IN_WORD[data[hi - 1]] and _IN_WORD[data[hi]]:
            rest = np.flatnonzero(~_IN_WORD[data[hi:hi + _SLICE]])
            hi = hi + int(rest[0]) if len(rest) else min(len(data), hi + _SLICE)
        part = data[lo:hi]
        edges = np.diff(_IN_WORD[part].astype(np.int8), prepend=0, append=0)
        found.append(Substrings(table[part]).of(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)))
        lo = hi
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of all words together where there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        total = total * _STEP + words[i:len(words) - size + 1 + i]
    return mix(total)


def prob_minhash(elements: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """Signatures (rows) of weighted sets (hashes, weights), none of them empty."""
    n = len(elements)
    sizes = np.array([len(d) for d, _ in elements])
    of = np.repeat(np.arange(n), sizes)
    ids = np.concatenate([d for d, _ in elements])
    weights = np.concatenate([w for _, w in elements]).astype(np.float64)
    first = np.full(n * registers, np.inf)
    signature = np.zeros(n * registers, dtype=np.uint64)
    each = np.maximum(1, np.ceil(registers * (math.log(registers) + 3) / sizes)).astype(np.int64)[of]
    at, drawn = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
    active = np.arange(len(ids))
    while len(active):
        for chosen in _in_parts(active, each):
            counts = each[chosen]
            starts = np.cumsum(counts) - counts
            nth = np.arange(counts.sum()) - np.repeat(starts, counts) + np.repeat(drawn[chosen], counts)
            element = np.repeat(chosen, counts)
            h = mix(ids[element] + (nth + 1).astype(np.uint64) * _STEP)
            gap = -np.log((h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / weights[element]
            when = np.cumsum(gap)
            when += np.repeat(at[chosen] - when[starts] + gap[starts], counts)
            register = of[element] * registers + (mix(h + _STEP) >> np.uint64(33)).astype(np.int64) % registers
            np.minimum.at(first, register, when)
            won = when == first[register]
            signature[register[won]] = ids[element[won]]
            at[chosen] = when[starts + counts - 1]
            drawn[chosen] += counts
        latest = first.reshape(n, registers).max(axis=1)
        active = active[at[active] < latest[of[active]]]
        each = np.minimum(each, 64)
    return signature.reshape(n, registers)


def band_keys(elements: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int) -> list[np.ndarray]:
    """Distinct keys of the bands of each weighted set's signature and of the one with all weights 1.

    Both share one space of keys: a text without repeats has one signature,
    which must meet the second one of a text that repeats a line.
    """
    again = [i for i, (_, w) in enumerate(elements) if w.max() > 1]
    every = elements + [(elements[i][0], np.ones(len(elements[i][0]))) for i in again]
    parts = prob_minhash(every, bands * rows).reshape(-1, bands, rows)
    total = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), parts.shape[:2])
    for i in range(rows):
        total = mix(total * _STEP + parts[:, :, i])
    keys = total.view(np.int64)
    found = list(keys[:len(elements)])
    for i, more in zip(again, keys[len(elements):]):
        found[i] = np.union1d(found[i], more)
    return found


def _in_parts(active: np.ndarray, each: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(each[active])
    return iter(np.split(active, np.unique(np.searchsorted(ends, np.arange(_ARRIVALS, ends[-1], _ARRIVALS))) )) \
        if ends[-1] > _ARRIVALS else iter([active])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard (by weights) and Jaccard (of the sets) of (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    shared = (x > 0) & (y > 0)
    jaccard = shared.mean()
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    below = np.concatenate([[0.0], np.cumsum(x[order])])  # weights of x up to a ratio
    above = y.sum() - np.concatenate([[0.0], np.cumsum(y[order])])
    t = ratio[shared]
    upto = np.searchsorted(ratio[order], t, side="right")
    return max(float(jaccard), float((y[shared] / (t * below[upto] + above[upto])).sum()))


def _counted(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(word_hashes(text), size), return_counts=True)


def signatures(docs: DataFrame, bands: int, rows: int, shingle_words: int) -> DataFrame:
    """(doc_id, h1, h2, bands): the words' hash and the keys of the bands; null where there are no words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                whole, elements, size, hi = [], [], 0, lo
                while hi < b.num_rows and size < 300_000 and hi - lo < 512:
                    text = b.column(1)[hi].as_py()
                    words = word_hashes(text) if text else ()
                    if len(words):
                        whole.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                        elements.append(np.unique(shingle_hashes(words, shingle_words), return_counts=True))
                        size += (len(elements[-1][0]) + 1500) * (2 if elements[-1][1].max() > 1 else 1)
                    else:
                        whole.append(None)
                    hi += 1
                keys = band_keys(elements, bands, rows) if elements else []
                has = np.array([w is not None for w in whole])
                halves = np.zeros((len(whole), 2), dtype=np.int64)
                halves[has] = np.frombuffer(b"".join(w for w in whole if w), dtype="<i8").reshape(-1, 2)
                counts = np.zeros(len(whole), dtype=np.int64)
                counts[has] = [len(k) for k in keys]
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                held = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(halves[:, 0], mask=~has), pa.array(halves[:, 1], mask=~has),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(held))], names=["doc_id", "h1", "h2", "bands"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(sign), "doc_id long, h1 long, h2 long, bands array<long>")


def _near(pairs: DataFrame, texts: DataFrame, threshold: float, shingle_words: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_counted = None, None
        for b in batches:
            kept = []
            for i, hub in enumerate(b.column(1).to_pylist()):
                if hub != last:
                    last, last_counted = hub, _counted(b.column(3)[i].as_py(), shingle_words)
                kept.append(similarity(_counted(b.column(2)[i].as_py(), shingle_words), last_counted) >= threshold)
            if any(kept):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(kept))

    return (pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
            .mapInArrow(lean(verify), "a long, b long"))


def _link_buckets(
    members: DataFrame, texts: DataFrame, threshold: float, shingle_words: int, small: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(id, label) of the components of all near pairs that share a bucket, and the verified links (a, b) that make them.

    First every member meets the most central member of its bucket, which links
    a group of near copies at once.  What is then still apart meets within
    buckets of at most ``small`` members pair by pair, in larger ones by blocks.
    """
    leading = members.groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("centre"))
    met = members.join(leading, "key").where("id <> centre")
    first = stored(met.select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct(), "pairs")
    links = stored(_near(first, texts, threshold, shingle_words), "links")
    labels = connected_components(links)
    placed = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = (placed.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"))
             .where("first <> last").select("key", "first"))
    apart = stored(placed.join(mixed, "key"), "open_buckets")
    few = apart.where(F.col("size") <= small)
    others = few.select("key", F.col("id").alias("other"), F.col("label").alias("other_label"))
    pairs = (few.join(others, "key").where("label <> other_label AND id > other")
             .select(F.col("id").alias("a"), F.col("other").alias("b")))
    pairs = stored(pairs.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = _near(pairs, texts, threshold, shingle_words)
    many = apart.where(F.col("size") > small)
    if not many.isEmpty():
        # buckets join the components (labels) of their members to clusters: a label is tied to the least label it
        # meets in any bucket, and that one to the least labels of the label's other buckets
        met = many.groupBy("label").agg(F.collect_set("first").alias("firsts")).withColumn("least", F.array_min("firsts"))
        ties = (met.select(F.col("label").alias("a"), F.col("least").alias("b"))
                .union(met.select(F.explode("firsts").alias("a"), F.col("least").alias("b"))).distinct())
        clusters = connected_components(ties).select(F.col("id").alias("label"), F.col("label").alias("cluster"))
        clustered = many.select("id", "label").distinct().join(clusters, "label")
        more = more.union(_links_between_blocks(clustered, texts, threshold, shingle_words))
    more = stored(more, "links")
    if more.isEmpty():
        return labels, links
    every = links.union(more)
    return connected_components(every), every


#: A block holds about so many members and bytes of text at most; a task compares two blocks.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
_LISTED = 12


def _links_between_blocks(
    members: DataFrame, texts: DataFrame, threshold: float, shingle_words: int,
    block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Links (a, b) between members (id, label, cluster) of one cluster with different labels, enough to join all near ones."""
    own = stored(texts.join(members, "id").withColumn("bytes", F.octet_length("text")), "clusters")
    sizes = own.groupBy("cluster").agg(F.greatest(
        F.lit(1), F.ceil(F.count("*") / block_rows), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = own.join(sizes, "cluster").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         "block", "id", "label", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        free_worker()
        ids, labels, blocks = (t[c].to_numpy() for c in ("id", "label", "block"))
        found = []
        if len(np.unique(labels)) > 1:
            counted = [_counted(x.as_py(), shingle_words) for x in t["text"]]
            found = _joining_links(ids, labels, blocks == blocks.min(), blocks == blocks.max(), counted, threshold)
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def _joining_links(ids: np.ndarray, labels: np.ndarray, in_x: np.ndarray, in_y: np.ndarray,
                   counted: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Verified links between members of block x and of block y, a spanning forest of their labels."""
    x, y = np.flatnonzero(in_x), np.flatnonzero(in_y)
    place_x, place_y = np.cumsum(in_x) - 1, np.cumsum(in_y) - 1
    sizes = np.array([len(h) for h, _ in counted])
    hashes, of = np.concatenate([h for h, _ in counted]), np.repeat(np.arange(len(ids)), sizes)
    share = np.concatenate([w / w.sum() if len(w) else w for _, w in counted]).astype(np.float32)
    order = np.argsort(hashes, kind="stable")
    hashes, of, share = hashes[order], of[order], share[order]
    cuts = np.flatnonzero(np.diff(hashes)) + 1
    lows, highs = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(hashes)]])
    both = np.zeros((len(x), len(y)), dtype=np.float32)  # shingles that two texts share
    weight_x, weight_y = np.zeros_like(both), np.zeros_like(both)  # and their share of each text's weight
    width = highs - lows
    for k in range(2, _LISTED + 1):  # a shingle of few texts: their pairs
        chosen = np.flatnonzero(width == k)
        for part in np.array_split(chosen, max(1, len(chosen) * k * k >> 20)):
            at = lows[part][:, None] + np.arange(k)
            left, right = (np.repeat(at, k, axis=1).ravel(), np.tile(at, k).ravel())
            ok = in_x[of[left]] & in_y[of[right]]
            left, right = left[ok], right[ok]
            cell = place_x[of[left]], place_y[of[right]]
            np.add.at(both, cell, 1)
            np.add.at(weight_x, cell, share[left])
            np.add.at(weight_y, cell, share[right])
    often = np.flatnonzero(width > _LISTED)
    for part in np.array_split(often, max(1, -(-len(often) // 512))):  # a shingle of many: products of matrices
        at = np.concatenate([np.arange(lows[p], highs[p]) for p in part]) if len(part) else part
        column = np.repeat(np.arange(len(part)), width[part])
        here_x, here_y = in_x[of[at]], in_y[of[at]]
        has_x, has_y = np.zeros((len(x), len(part)), dtype=np.float32), np.zeros((len(part), len(y)), dtype=np.float32)
        has_x[place_x[of[at[here_x]]], column[here_x]] = 1
        has_y[column[here_y], place_y[of[at[here_y]]]] = 1
        both += has_x @ has_y
        of_x, of_y = has_x.copy(), has_y.copy()
        of_x[place_x[of[at[here_x]]], column[here_x]] = share[at[here_x]]
        of_y[column[here_y], place_y[of[at[here_y]]]] = share[at[here_y]]
        weight_x += of_x @ has_y
        weight_y += has_x @ of_y
    union = sizes[x][:, None] + sizes[y][None, :] - both
    # with a and b the weights that are not shared, probability Jaccard <= 1 / (1 + a / (1 - a) + b / (1 - b))
    # (its terms x_i y_i / (y_i + b x_i) are concave; equal for equal weights)
    with np.errstate(divide="ignore"):
        most = 1 / (1 / weight_x + 1 / weight_y - 1)
    can = (labels[x][:, None] != labels[y][None, :]) & ((both >= (threshold - 1e-5) * union) | (most >= threshold - 1e-3))
    root: dict[int, int] = {}

    def find(label: int) -> int:
        while root.get(label, label) != label:
            root[label] = root.get(root[label], root[label])
            label = root[label]
        return label

    found = []
    for i, j in np.argwhere(can).tolist():
        p, q = find(int(labels[x[i]])), find(int(labels[y[j]]))
        if p != q and similarity(counted[x[i]], counted[y[j]]) >= threshold:
            root[max(p, q)] = min(p, q)
            pair = int(ids[x[i]]), int(ids[y[j]])
            found.append((max(pair), min(pair)))
    return found


def _words_digest(text: str | None) -> bytes | None:
    words = word_hashes(text) if text else ()
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of ``nodes`` (id, doc_id, h1, h2): of the rows with a node's doc_id, one with its words."""
    joined = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .where(F.col("text").isNotNull()).join(nodes.select("doc_id", "id", "h1", "h2"), "doc_id"))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = np.stack([b.column(3).to_numpy(), b.column(4).to_numpy()], axis=1).astype("<i8")
            keep = [_words_digest(t.as_py()) == w.tobytes() for t, w in zip(b.column(1), want)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1)], names=["id", "text"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(lean(same), "id long, text string").groupBy("id").agg(F.min("text").alias("text"))


def duplicate_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    bands: int = 30,
    rows: int = 6,
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """(doc_id, h1, h2, class_id, n_links, class_key) for every row; h1 and h2 hash the words (null without words).

    The class is named by its smallest doc_id; where rows of different classes
    share that id, ``class_key`` still tells them apart (null without an id or
    words).  ``n_links`` counts the verified links to other texts that were found
    for the row's text (copies share one text).
    """
    bounded_batches(docs.sparkSession)
    signed = stored(signatures(docs, bands, rows, shingle_words), "signatures")
    known = signed.where(F.col("doc_id").isNotNull() & F.col("h1").isNotNull())
    copies = (known.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min_by("bands", "doc_id").alias("bands"))
              .withColumn("id", F.monotonically_increasing_id()))
    copies = stored(copies, "copies")
    keys = copies.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(keys.join(shared, "key"), "buckets")
    central = members.groupBy("id").agg(F.sum("size").alias("degree"))  # who meets the most others
    members = stored(members.join(central, "id"), "ranked_buckets")
    nodes = copies.select("id", "doc_id", "h1", "h2").join(central.select("id"), "id")
    texts = stored(_texts_of(docs, nodes), "bucket_texts")
    labels, links = _link_buckets(members, texts, threshold, shingle_words)
    degrees = (links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links")))
    placed = (copies.select("h1", "h2", "id", "doc_id").join(labels, "id", "left").join(degrees, "id", "left")
              .withColumn("label", F.coalesce("label", "id")))
    named = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of_copy = placed.join(named, "label").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("label").alias("class_key"))
    has_id = F.col("doc_id").isNotNull()
    return (
        signed.select("doc_id", "h1", "h2")
        .join(of_copy, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
        .select("doc_id", "h1", "h2", F.when(has_id, F.coalesce("class_id", "doc_id")).alias("class_id"),
                F.when(has_id, F.coalesce("n_links", F.lit(0)).cast("long")).alias("n_links"), F.when(has_id, F.col("class_key")).alias("class_key")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) for every row (options: see ``duplicate_classes``)."""
    return duplicate_classes(docs, **options).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with its columns, without all but one of every class.

    The row with the smallest id stays, of several the one with the smallest
    words' hash, then the smallest text and columns.  Rows without an id and
    texts without words all stay.
    """
    placed = duplicate_classes(docs, **options).where("class_key IS NOT NULL AND doc_id = class_id")
    words = F.concat_ws(":", "h1", "h2")
    chosen = placed.groupBy("class_key").agg(F.min("class_id").alias("_id"), F.min(words).alias("_chosen"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_words_digest(t.as_py()) for t in b.column(b.schema.get_field_index(whole))]
            text = [":".join(map(str, np.frombuffer(d, "<i8").tolist())) if d else None for d in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "_words"])

    # texts that are strings go to the worker once, not beside a copy
    whole = "text" if isinstance(docs.schema["text"].dataType, T.StringType) else "_text"
    held = docs if whole == "text" else docs.withColumn(whole, F.col("text").cast("string"))
    keyed = held.mapInArrow(lean(digest), T.StructType([*held.schema.fields, T.StructField("_words", T.StringType())]))
    rest = [c for c in docs.columns if c != "text"]
    kept = keyed.join(chosen, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_words") == F.col("_chosen")))
    one = (kept.groupBy("class_key").agg(F.min(F.struct("text", *rest)).alias("r"))
           .select(*[F.col("r")[c].alias(c) for c in docs.columns]))
    return one.unionByName(keyed.where("doc_id IS NULL OR _words IS NULL").select(*docs.columns))
