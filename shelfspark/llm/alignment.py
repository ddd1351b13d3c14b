"""Alignment of two tokenizers over the same texts by their tokens' byte ends.

Both tokenizers cut the same bytes.  The ends of the shorter list of tokens
drive the search into the longer one: from where the last end was found, steps
double until they pass the end wanted, then a binary search closes in.  Ends
that both have cut the text into groups, and the ranks of a token's two ends in
the other list are the range of tokens that it overlaps; these are its links.

Texts are aligned many at a time: their ends, laid one after another, are again
two ascending lists, and a text's last end is common to both.

Where neither tokenizer joins bytes across the start of white space (a byte-level
file with the common pattern; a byte-pair file without normaliser, whose pieces
have spaces at their start only), texts are cut there into words with the space
before them, and such a word's last end is common to both, too.  Each different
word of many texts is encoded and aligned once; a text's tokens, groups and links
are those of its words, one after another.  With other files a text is one word.

Counts of linked id pairs over the corpus are added up per task, then over a
shuffle, and read back by a join on the pair: a broadcast one where the counted
pairs are at most ``broadcast_pairs`` rows, else a shuffled one, whose hot pairs
adaptive execution splits.

Edge cases: null and empty texts, and texts whose joined token bytes differ from
space + text, have no tokens (all counts 0, no groups); strings of special tokens
are plain text; repeated rows and shared or null ids are kept row by row; no rows
give no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import gathered, joined_text, slices_by_bytes, stored, worker_cache

#: Rows of the pair counts that may be broadcast: 24 bytes each, about 100 MB in an executor with its hash table.
BROADCAST_PAIRS = 1 << 21
#: The pattern by which the public byte-level vocabulary cuts texts (a fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TEXT_BYTES = 2 << 20
_ENCODED_BYTES = 32 << 10
_LONG_WORD = 4000
_COARSE = 64
#: White space by Unicode and U+001C..U+001F: a superset of what either tokenizer takes for it.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Texts that ``split(" ")`` would cut inside a run of white space, and where to cut these.
_RUNS = f"^{_WHITE}| {_WHITE}| $"
_CUT = re.compile(r"(?<=\S) (?=\s*\S)")


# ---------------------------------------------------------------- tokenizers


def _byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; ``pieces[id]`` are a token's bytes.

    Where every merge makes the id after the one before it, ids are ranks and
    tiktoken encodes the same ids several times as fast; a text with a very long
    run without a break, and any other file, go through the library itself.
    """

    _RUN = re.compile(r"\s{4096}|\S{4096}")

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(source)
        self._library.encode_special_tokens = True
        spec, alphabet = json.loads(source), _byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        self.pieces = [b""] * (max([*vocabulary.values(), *[t["id"] for t in spec["added_tokens"]]]) + 1)
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.pieces[i] = bytes(alphabet[c] for c in token)
        for t in spec["added_tokens"]:  # never produced from plain text, so nothing is joined to them
            self.pieces[t["id"]] = b""
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        self._ranks = None
        if _plain_byte_level(spec) and merged == list(range(256, 256 + len(merged))):
            import tiktoken

            ranks = {p: i for i, p in enumerate(self.pieces) if p}
            self._ranks = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.by_word = self._ranks is not None

    def encode(self, text: str) -> list[int]:
        if self._ranks is None or self._RUN.search(text):
            return self._library.encode(text, add_special_tokens=False).ids
        return self._ranks.encode_ordinary(text)


def _plain_byte_level(spec: dict) -> bool:
    """Whether texts are only cut by the common pattern before merging."""
    before = spec.get("pre_tokenizer") or {}
    return (before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"].get("type") == "BPE"
            and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                        "end_of_word_suffix", "ignore_merges")))


class Pieces:
    """A sentencepiece file; ``pieces[id]`` are a token's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i)
                               else piece.replace("▁", " ").encode("utf-8"))
        self.by_word = _spaces_at_start(model, self._model)

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


def _spaces_at_start(source: bytes, model) -> bool:
    """Whether a sentencepiece file's tokens never reach from a character into a space after it."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    spec = sentencepiece_model_pb2.ModelProto.FromString(source)
    normalizer, trainer = spec.normalizer_spec, spec.trainer_spec
    plain = (normalizer.add_dummy_prefix and normalizer.escape_whitespaces and not normalizer.remove_extra_whitespaces
             and not normalizer.precompiled_charsmap and not trainer.treat_whitespace_as_suffix)
    kinds = {p.type for p in spec.pieces}
    odd = {spec.pieces[0].USER_DEFINED, spec.pieces[0].UNUSED}
    return (plain and trainer.model_type == trainer.BPE and trainer.byte_fallback and not kinds & odd
            and sum(model.is_byte(i) for i in range(len(spec.pieces))) == 256
            and not any(re.search("[^▁]▁", p.piece) for p in spec.pieces))


# ---------------------------------------------------------------- alignment


def galloping_ranks(driver: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each of ``driver`` (ascending) the index of the first of ``other`` (ascending) that is not less.

    Every 64th value gallops from where the last of these was found; the values
    between gallop from the one before them, all at once.
    """
    n = len(other)
    found = np.zeros(len(driver), dtype=np.int64)
    coarse = range(0, len(driver), _COARSE)
    at = 0
    for i in coarse:
        value, step, lo = driver[i], 1, at
        while lo + step < n and other[lo + step] < value:
            lo += step
            step *= 2
        at = lo + int(np.searchsorted(other[lo:min(n, lo + step + 1)], value))
        found[i] = at
    lo = np.repeat(found[::_COARSE], _COARSE)[:len(driver)]
    step = np.ones(len(driver), dtype=np.int64)
    active = np.arange(len(driver))
    while len(active):  # exponential part: lo stays at or below the place wanted
        ahead = lo[active] + step[active]
        inside = ahead < n
        inside[inside] = other[ahead[inside]] < driver[active[inside]]
        active = active[inside]
        lo[active] += step[active]
        step[active] *= 2
    hi = np.minimum(lo + step, n)
    while True:  # binary part: the place is in lo..hi
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        middle = (lo[open_] + hi[open_]) >> 1
        less = other[middle] < driver[open_]
        lo[open_[less]] = middle[less] + 1
        hi[open_[~less]] = middle[~less]


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, group_a, group_b): overlapping token indices, and the index after each group's last token.

    Both lists of ends are ascending without repeats and close with the same end.
    """
    swap = len(ends_a) > len(ends_b)
    short, long_ = (ends_b, ends_a) if swap else (ends_a, ends_b)
    rank = galloping_ranks(short, long_)
    common = long_[rank] == short if len(rank) else np.zeros(0, dtype=bool)
    first = np.concatenate([[0], rank[:-1] + common[:-1]]) if len(rank) else rank
    width = rank - first + 1  # rank differences: how many tokens of the other list a token overlaps
    link_short = np.repeat(np.arange(len(short)), width)
    link_long = np.arange(len(link_short)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
    group_short, group_long = np.flatnonzero(common) + 1, rank[common] + 1
    if swap:
        return link_long, link_short, group_long, group_short
    return link_short, link_long, group_short, group_long


def _group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, to_a: np.ndarray,
                 to_b: np.ndarray, names: pa.Array, lengths: np.ndarray) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3;`` of each word's groups; a word's tokens end before ``to_a`` and ``to_b``."""
    last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    last_a[group_a - 1] = True
    last_b[group_b - 1] = True
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    sizes_a, sizes_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
    before_a = np.repeat(group_b - sizes_b, sizes_a)  # tokens of b ahead of each token of a
    before_b = np.repeat(group_a, sizes_b)
    codes[np.arange(len(a)) + before_a] = 3 * a + last_a
    codes[np.arange(len(b)) + before_b] = 3 * b + 2 * last_b
    text = names.take(pa.array(codes))
    ends = np.concatenate([[0], np.cumsum(lengths[codes])])[np.concatenate([[0], to_a + to_b])]
    return pa.Array.from_buffers(pa.large_binary(), len(to_a), [None, pa.py_buffer(ends), text.buffers()[2]])


def _names(size: int) -> tuple[pa.Array, np.ndarray]:
    """``id,`` ``id|`` and ``id;`` at 3 * id + 0, 1 and 2, and their lengths."""
    names = pa.array([f"{i}{sign}" for i in range(size) for sign in ",|;"], pa.large_string())
    return names, pc.binary_length(names).to_numpy()


def words_of(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Each text's words without the space before them, and the texts' places in the order given out."""
    odd = pc.match_substring_regex(texts, _RUNS)
    words, places = pc.split_pattern(texts, " "), np.arange(len(texts))
    if not pc.any(odd).as_py():
        return words, places
    cut = pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], words.type)
    odd = odd.to_numpy(zero_copy_only=False)
    return pa.concat_arrays([words.filter(pa.array(~odd)), cut]), np.concatenate([places[~odd], places[odd]])


# ---------------------------------------------------------------- operator


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligner(byte_source: str, piece_source: bytes):
    """A function of doc ids and texts that gives their rows."""
    a, b = ByteLevel(byte_source), Pieces(piece_source)
    size_a, size_b = (np.array([len(p) for p in t.pieces], dtype=np.int64) for t in (a, b))
    names = _names(max(len(a.pieces), len(b.pieces)))
    by_word = a.by_word and b.by_word

    def encoded(text: str):
        """Ids of space + text by both, or none."""
        if not text:
            return [], []
        whole = (" " + text).encode("utf-8", "surrogatepass")
        ids_a, ids_b = a.encode(" " + text), b.encode(text)
        if b"".join(map(a.pieces.__getitem__, ids_a)) != whole or b"".join(map(b.pieces.__getitem__, ids_b)) != whole:
            return [], []
        return ids_a, ids_b

    def together(words: pa.Array) -> tuple:
        """(ids, ids, counts, counts) of words that are encoded as one text; one by one where that has no tokens."""
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        ids = [np.array(x, dtype=np.int64) for x in encoded(joined_text(words, " "))]
        if len(ids[0]):
            of = [np.cumsum(size[x]) for size, x in zip((size_a, size_b), ids)]
            to = [np.searchsorted(x, ends) for x in of]
            if all((x[i] == ends).all() for x, i in zip(of, to)):
                return *ids, *(np.diff(i + 1, prepend=0) for i in to)
        return one_by_one(words)

    def one_by_one(words: pa.Array) -> tuple:
        both = [encoded(w) for w in words.to_pylist()]
        return (*(np.array([i for x in both for i in x[k]], dtype=np.int64) for k in (0, 1)),
                *(np.array([len(x[k]) for x in both], dtype=np.int64) for k in (0, 1)))

    def aligned(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words, places = words_of(texts) if by_word else (
            pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts), np.arange(len(texts)))
        coded, n_words = words.flatten().dictionary_encode(), np.diff(words.offsets.to_numpy())
        different, word = coded.dictionary, coded.indices.to_numpy()

        # words in runs of white space and long ones are encoded alone, the others many at a time
        alone = pc.or_(pc.match_substring_regex(different, f"^({_WHITE}|$)"),
                       pc.greater_equal(pc.binary_length(different), _LONG_WORD)) if by_word else pa.array([True] * len(different))
        others = different.filter(pc.invert(alone))
        parts = [together(others.slice(lo, n)) for lo, n in slices_by_bytes(others, _ENCODED_BYTES)]
        parts.append(one_by_one(different.filter(alone)))
        all_a, all_b, n_a, n_b = (np.concatenate(x) for x in zip(*parts))
        alone = alone.to_numpy(zero_copy_only=False)
        order = np.empty(len(different), dtype=np.int64)
        order[np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])] = np.arange(len(different))
        word = order[word]

        # tokens, links and groups of the different words
        link_a, link_b, group_a, group_b = align(np.cumsum(size_a[all_a]), np.cumsum(size_b[all_b]))
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        to_link, to_group = np.searchsorted(link_a, to_a), np.searchsorted(group_a, to_a, side="right")
        n_links, n_groups = np.diff(to_link, prepend=0), np.diff(to_group, prepend=0)
        group_text = _group_texts(all_a, all_b, group_a, group_b, to_a, to_b, *names)
        pairs, code = np.unique(all_a[link_a] << 32 | all_b[link_b], return_inverse=True)

        # texts: a word without tokens leaves its text without
        of = np.repeat(np.arange(len(texts)), n_words)
        broken = np.zeros(len(texts), dtype=bool)
        broken[of[n_a[word] == 0]] = True
        kept = ~broken[of]
        of, word, n_words = of[kept], word[kept], np.where(broken, 0, n_words)
        to_word = np.concatenate([[0], np.cumsum(n_words)])

        def per_text(counts: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(counts[word])])[to_word])

        links = n_links[word]
        every = code[gathered((to_link - n_links)[word], links)] + np.repeat(of * max(1, len(pairs)), links)
        every, times = np.unique(every, return_counts=True)
        to_pair = np.searchsorted(every, np.arange(len(texts) + 1) * max(1, len(pairs))).astype(np.int32)
        text = group_text.take(pa.array(word))
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[:len(word) + 1][to_word].tolist()
        view = memoryview(text.buffers()[2] or b"")
        digests = [hashlib.sha256(view[lo:hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends[:-1], ends[1:])]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(places)), pa.array(per_text(n_a)), pa.array(per_text(n_b)), pa.array(per_text(n_groups)),
             pa.array(per_text(n_links)), pa.array(digests, pa.string()),
             pa.ListArray.from_arrays(pa.array(to_pair), pa.array(pairs[every % max(1, len(pairs))])),
             pa.ListArray.from_arrays(pa.array(to_pair), pa.array(times.astype(np.int32)))],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return aligned


def align_documents(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """One row per document: counts, the groups' digest, and its distinct linked id pairs (a << 32 | b) with their times."""
    context = docs.sparkSession.sparkContext
    with open(byte_file, encoding="utf-8") as f:
        byte_source = f.read()
    with open(piece_file, "rb") as f:
        piece_source = f.read()
    held = context.broadcast((byte_source, piece_source))  # two tokenizer files of a few MB
    key = ("alignment", hashlib.sha1(byte_source.encode()).hexdigest(), hashlib.sha1(piece_source).hexdigest())

    def tools():
        cache = worker_cache()
        if key not in cache:
            cache[key] = aligner(*held.value)
        return cache[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for lo, n in slices_by_bytes(texts, _TEXT_BYTES):
                yield tools()(batch.column(0).slice(lo, n), texts.slice(lo, n))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, _ROW)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair over all documents; whether its B id has no pair with more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
        for b in batches:
            every = np.concatenate([held, b.column(0).values.to_numpy()])
            weights = np.concatenate([sums, b.column(1).values.to_numpy().astype(np.int64)])
            held, place = np.unique(every, return_inverse=True)
            total = np.zeros(len(held), dtype=np.int64)
            np.add.at(total, place, weights)
            sums = total
            if len(held) > 1 << 21:  # given out early, so that a task holds a bounded table
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], schema=schema)
                held, sums = held[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], schema=schema)

    counts = (aligned.select("pairs", "times").mapInArrow(add, "pair long, n long")
              .groupBy("pair").agg(F.sum("n").alias("count")))
    low = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = stored(counts.withColumn("b", low), "pair_counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def cross_tokenizer_links(
    docs: DataFrame, byte_file: str, piece_file: str, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = stored(align_documents(docs, byte_file, piece_file).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    bounded = F.broadcast if counts.count() <= broadcast_pairs else (lambda df: df)
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "times")))
    links = links.withColumnsRenamed({"pairs": "pair"})
    sums = (links.join(bounded(counts), "pair").groupBy("row")
            .agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"),
                 F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")))
    zero = F.lit(0).cast("long")
    return rows.select(*kept).join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
