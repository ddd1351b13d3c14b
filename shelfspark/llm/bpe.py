"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

Each leaf of a word's tree holds the merge rank of one adjacent pair (with its
place, so equal ranks prefer the left); the root is the leftmost lowest-rank
merge.  A merge changes three leaves, each repaired on its way to the root,
until no mergeable pair is left.  Words of similar length share one NumPy
array of trees, so one step merges in all of them at once; each worker keeps
the ids of words it has met in a bounded cache.

Edge cases: null and empty texts have no ids and decode to the empty string;
texts and words of any length are encoded whole; ids outside the vocabulary
are skipped by decoding, null id lists decode to the empty string; repeated
rows and other columns do not matter.  Letters and case pairs that Unicode
assigned after version 15 follow the installed Python tables.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import int_lists, list_buffers, string_values, worker_cache
from shelfspark.llm.tokens import byte_alphabet, check_word_bpe, read_tokenizer, split_words

_FLUSH_BYTES = 4 << 20
_BATCH_CHARS = 2 << 20
_TREE_CELLS = 1 << 20
_NONE = np.int64(1) << 62


class WordBpe:
    """Encoder and decoder for one word-level BPE file (the file's text, not its path)."""

    def __init__(self, tokenizer_json: str, cache_words: int = 300_000) -> None:
        check_word_bpe(tokenizer_json)
        spec = json.loads(tokenizer_json)
        model, added = spec["model"], spec["added_tokens"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self._tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in added}
        self._special = {a["content"]: a["id"] for a in added}
        names = "|".join(regex.escape(s) for s in sorted(self._special, key=len, reverse=True))
        self._special_pattern = regex.compile(f"({names})") if names else None
        self._pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_alphabet()
        self._byte = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self._last_byte = np.array([vocab[letters[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._limit = cache_words
        self._words: dict[str, bytes] = {}
        self._known: dict[str, bytes] = {}  # ids of lower-cased pieces

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces (the file has no decoder)."""
        try:
            return " ".join(map(self._tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self._tokens[i] for i in ids if i in self._tokens)

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self._words) > self._limit:
            self._words = {}
        if len(self._known) > self._limit:
            self._known = {}
        words = [split_words(t) if t else [] for t in texts]
        missing = set().union(*words).difference(self._words)
        if missing:
            self._encode_words(missing)
        return [b"".join(map(self._words.__getitem__, w)) for w in words]

    def _encode_words(self, words: set[str]) -> None:
        """Add the ids of white-space free ``words``, merging all new pieces at once."""
        single: list[tuple[str, str]] = []
        parts: list[tuple[str, list[str | int]]] = []
        for w in words:
            lower = w.lower() if w.isascii() else _lowered(w)
            if lower.isalpha():
                single.append((w, lower))
                continue
            own: list[str | int] = []
            for i, s in enumerate(self._special_pattern.split(w) if self._special_pattern and "<" in w else [w]):
                if i % 2:
                    own.append(self._special[s])
                elif s:
                    own += self._pieces.findall(_lowered(s))
            parts.append((w, own))
        new = {p for _, p in single}.union(p for _, own in parts for p in own if isinstance(p, str))
        self._known.update(self.merge_all(new.difference(self._known)))
        known = self._known
        for w, p in single:
            self._words[w] = known[p]
        for w, own in parts:
            self._words[w] = b"".join(known[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in own)

    def merge_all(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of every piece, shortest first, in batches of equal tree size."""
        found: dict[str, bytes] = {}
        coded = sorted(((p.encode("utf-8"), p) for p in pieces), key=lambda x: len(x[0]))
        lo = 0
        while lo < len(coded):
            leaves = 1 << max(1, (len(coded[lo][0]) - 1).bit_length())
            hi = lo
            while hi < len(coded) and len(coded[hi][0]) <= leaves and (hi - lo + 1) * leaves <= max(_TREE_CELLS, leaves):
                hi += 1
            for (_, p), ids in zip(coded[lo:hi], self._merge([b for b, _ in coded[lo:hi]], leaves)):
                found[p] = ids
            lo = hi
        return found

    def _pair_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, leaves: int) -> np.ndarray:
        """Tree keys rank * leaves + place of adjacent symbols; none where they don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((right >= 0) & (left >= 0) & (self._keys[at] == key), self._ranks[at] * leaves + place, _NONE)

    def _merge(self, words: list[bytes], leaves: int) -> list[bytes]:
        n = len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        place = np.arange(leaves, dtype=np.int64)
        inside = place < sizes[:, None]
        symbols = np.full((n, leaves + 1), -1, dtype=np.int64)  # the last column: no symbol
        symbols[:, :-1][inside] = self._byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rows = np.arange(n)
        symbols[rows, sizes - 1] = self._last_byte[[w[-1] for w in words]]
        after = np.where(place + 1 < sizes[:, None], place + 1, leaves)
        before = np.broadcast_to(np.where(place > 0, place - 1, leaves), (n, leaves)).copy()
        tree = np.full((n, 2 * leaves), _NONE, dtype=np.int64)
        tree[:, leaves:] = self._pair_keys(symbols[:, :-1], symbols[:, 1:], place, leaves)
        half = leaves
        while half > 1:
            half >>= 1
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        alive = inside.copy()
        rows = rows[tree[:, 1] < _NONE]
        while len(rows):
            root = tree[rows, 1]
            left = root & (leaves - 1)
            right = after[rows, left]
            beyond, ahead = after[rows, right], before[rows, left]
            symbols[rows, left] = self._merged[root // leaves]
            symbols[rows, right] = -1
            alive[rows, right] = False
            after[rows, left] = beyond
            more = beyond < leaves
            before[rows[more], beyond[more]] = left[more]
            tree[rows, leaves + right] = _NONE
            tree[rows, leaves + left] = self._pair_keys(symbols[rows, left], symbols[rows, beyond], left, leaves)
            has = ahead < leaves
            r, a = rows[has], ahead[has]
            tree[r, leaves + a] = self._pair_keys(symbols[r, a], symbols[r, left[has]], a, leaves)
            for who, leaf in ((rows, left), (rows, right), (r, a)):
                node = leaf + leaves
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
            rows = rows[tree[rows, 1] < _NONE]
        ids = symbols[:, :-1][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _lowered(s: str) -> str:
    """NFC and lower case character by character (no word-final sigma)."""
    return s.lower() if s.isascii() else unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()


def _worker_bpe(tokenizer_json: str) -> WordBpe:
    cache = worker_cache()
    key = ("bpe", hash(tokenizer_json))
    if key not in cache:
        cache[key] = WordBpe(tokenizer_json)
    return cache[key]


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(spec.value)
        for batch in batches:
            texts: list[str | None] = []
            lo = held = 0
            for i, text in enumerate(string_values(batch.column(1))):
                texts.append(text)
                held += len(text or "")
                if held >= _BATCH_CHARS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, len(texts)), int_lists(bpe.encode_texts(texts))],
                        names=["doc_id", "ids"])
                    texts, lo, held = [], i + 1, 0

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, tokenizer_path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the decoded text of an id list column."""
    spec = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    df = df.drop(into)
    names = df.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(spec.value)
        for batch in batches:
            texts: list[str] = []
            lo = held = 0
            for i, ids in enumerate(list_buffers(batch.column(names.index(column)))):
                texts.append(bpe.decode(ids.cast("i").tolist()))
                held += len(texts[-1])
                if held >= _FLUSH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(lo, len(texts)) for c in batch.columns), pa.array(texts, pa.string())],
                        names=[*names, into])
                    texts, lo, held = [], i + 1, 0

    return df.mapInArrow(decode, T.StructType([*df.schema.fields, T.StructField(into, T.StringType())]))
