"""Token ids of whole texts by a ``tokenizers`` file, word by word with a bounded cache.

The tokenizer of the contract drops white space and never merges across it, so
the ids of a text are the ids of its white-space separated words, one after
another.  Each worker keeps the ids of the words it has met; a word not yet met
goes to the library (its BPE model directly for plain Latin letters, digits and
ASCII signs, where its normaliser and splitter reduce to lower case and one
pattern; the library's whole pipeline for everything else).

``encode_column`` takes many texts at once: their words are cut and numbered by
Arrow, each different word is encoded once, and the ids are laid out by the
words' numbers.  Plain words go through tiktoken together, with a NUL for the
end of a word: its merges are ranked by the bytes they make, which gives the
library's ids where every entry of the vocabulary is encoded as itself (then
no other pair of neighbours makes an entry's bytes before its own merge does);
this is checked once per worker, and other files go word by word.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Split

from shelfspark.llm.common import gathered, joined_text, worker_cache

#: White space by Unicode; ``str.split`` also cuts at U+001C..U+001F, which are none.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

#: Words of at most 1000 plain characters; the pieces of many of them, joined by U+0001.
_PLAIN_WORD = "^[!-~À-ÖØ-öø-ÿ]{1,1000}$"
_JOINED_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\x01|[^a-z0-9ß-öø-ÿ\x01]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + i)
    return table


def split_words(text: str) -> list[str]:
    """White-space separated words, by the Unicode property."""
    if _SEPARATORS.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


class Remembered(dict):
    """key -> value, made on demand; when full, the entries not used since the last time go."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self._make, self._limit, self._older = make, limit, {}

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._limit:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Ids of whole texts; ``cache_words`` bounds the words kept per worker (twice, in two generations)."""

    def __init__(self, tokenizer_json: str, cache_words: int = 400_000) -> None:
        check_word_bpe(tokenizer_json)
        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        self._letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self._pieces = Remembered(self._piece, cache_words // 2)
        self._words = Remembered(self._word, cache_words)
        self._source = tokenizer_json

    @cached_property
    def _joined(self):
        return _joined_pieces(json.loads(self._source), self._model)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; null gives none."""
        return b"".join(map(self._words.__getitem__, split_words(text))) if text else b""

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids; null gives none."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        pool, starts, sizes = self._different(coded.dictionary)
        word = coded.indices.to_numpy()
        sizes = sizes[word]
        ends = np.concatenate([[0], np.cumsum(sizes)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return pool[gathered(starts[word], sizes)], np.diff(ends)

    def _different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each word's ids start and how many they are."""
        starts, sizes = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        plain = np.zeros(len(words), dtype=bool)
        pool = np.zeros(0, dtype=np.uint32)
        if self._joined is not None:
            fits = pc.and_not(pc.match_substring_regex(words, _PLAIN_WORD), pc.match_substring(words, "<|"))
            plain = fits.to_numpy(zero_copy_only=False)
            if plain.any():
                ranks, cut = self._joined
                joined = joined_text(words.filter(fits), "\x01").lower()
                pieces = _JOINED_PIECES.findall(joined + "\x01")
                pool = np.array(ranks.encode_ordinary("\0".join(pieces) + "\0"), dtype=np.uint32)
                ends = np.flatnonzero(pool == cut)
                starts[plain] = np.concatenate([[0], ends[:-1] + 1])
                sizes[plain] = ends - starts[plain]
        other = np.flatnonzero(~plain)
        found = [self._words[w] if w else b"" for w in words.take(pa.array(other)).to_pylist()]
        sizes[other] = [len(x) >> 2 for x in found]
        starts[other] = len(pool) + np.cumsum(sizes[other]) - sizes[other]
        return np.concatenate([pool, np.frombuffer(b"".join(found), dtype="<u4")]), starts, sizes

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        lower = word.lower()
        if lower.isalpha():
            if lower.isascii() or _PLAIN.fullmatch(word):
                return self._pieces[lower]
        elif _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self._pieces.__getitem__, _PIECES.findall(lower)))
        return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


def _joined_pieces(spec: dict, model):
    """tiktoken over pieces that each end with NUL and the id of U+0001 as a piece; None where it may give other ids."""
    letters, vocabulary = {c: b for b, c in byte_alphabet().items()}, spec["model"]["vocab"]
    if (spec["model"].get("type") != "BPE" or spec["model"].get("end_of_word_suffix") != "</w>"
            or any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))):
        return None
    single = {c + end for c in letters for end in ("", "</w>")}
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    if (any(vocabulary.get(t, 512) >= 512 for t in single) or any(vocabulary[c] >= 256 for c in letters)
            or merged != list(range(512, 512 + len(merged))) or len(vocabulary) != 512 + len(merged)):
        return None
    ranks = {}
    for token, i in vocabulary.items():
        of = token.removesuffix("</w>") if i >= 256 else token
        if token not in single and (len(of) < 2 or "\u0100" in of or any(c not in letters for c in of)):
            return None
        ranks[bytes([letters[c] for c in of]) + b"\0" * (of != token)] = i
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    for suffix in ("", "</w>"):  # entries inside words, then those at their ends
        alone = Tokenizer(model if suffix else BPE(vocabulary, merges))
        alone.pre_tokenizer = Split("\n", "removed")
        own = [t for t, i in vocabulary.items() if i >= 512 and t.endswith("</w>") == bool(suffix)]
        if alone.encode("\n".join([t.removesuffix(suffix) for t in own])).ids != [vocabulary[t] for t in own]:
            return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ranks[b"\1\0"]


def check_word_bpe(tokenizer_json: str) -> None:
    """Raise unless the file has the normaliser and splitter that word-by-word encoding relies on."""
    spec = json.loads(tokenizer_json)
    parts = (spec.get("normalizer") or {}).get("normalizers") or []
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    word = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    if not ([p.get("type") for p in parts] == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0].get("pattern") == {"Regex": word} and pre[0].get("behavior") == "Removed"
            and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")):
        raise ValueError("this tokenizer joins text across white space; words can't be encoded one by one")


def worker_encoder(tokenizer_json: str) -> TextEncoder:
    """The worker's encoder, built once and kept across tasks."""
    cache = worker_cache()
    key = ("encoder", hash(tokenizer_json))
    if key not in cache:
        cache[key] = TextEncoder(tokenizer_json)
    return cache[key]


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text, read on the driver and broadcast (a few MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()
