"""Cross-tokenizer alignment: against a plain version over bytes, and the parts of its search."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from shelfspark.llm import alignment
from shelfspark.llm.queries import QUERIES, tokenizer_path as tokenizer_file

#: Texts that a tokenizer may normalise, cut in odd places or give no tokens.
BROKEN = ["a \u2581 b", "<s> </s> <unk> <0x41>", "<|endoftext|>", " " * 20_000 + "x", "y" * 9000, "\x00\x01", "  two  spaces  ",
          "ﬁ ① Å", "😀" * 50, "\n\n\n", "e\u0301", "日本語 한국어"]
BYTE_FILE, PIECE_FILE = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_FILE)
    library.encode_special_tokens = True
    return library, sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)


def plain_tokens(text, tools):
    """[(id, bytes)] of both tokenizers, or two empty lists."""
    library, model = tools
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet, n = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            alphabet[chr(256 + n)] = b
            n += 1
    if not text:
        return [], []
    a = library.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in library.id_to_token(i))) for i in a.ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole and b"".join(x for _, x in b) == whole else ([], [])


def plain_result(texts, tools):
    per, total = [], Counter()
    for doc_id, text in texts:
        a, b = plain_tokens(text, tools)
        spans = []
        for tokens in (a, b):
            at, found = 0, []
            for i, x in tokens:
                found.append((i, at, at + len(x)))
                at += len(x)
            spans.append(found)
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        links, groups, rest = [], [], [spans[0][::-1], spans[1][::-1]]
        for end in common:
            of_a, of_b = [], []
            for of, left in zip((of_a, of_b), rest):
                while left and left[-1][2] <= end:
                    of.append(left.pop())
            links += [(x[0], y[0]) for x in of_a for y in of_b if x[1] < y[2] and y[1] < x[2]]
            groups.append(",".join(str(x[0]) for x in of_a) + "|" + ",".join(str(y[0]) for y in of_b))
        total.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        per.append((doc_id, len(a), len(b), len(groups), links, digest))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return sorted(((d, na, nb, g, len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links), s)
                   for d, na, nb, g, links, s in per), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bound", [1 << 21, 0])
def test_odd_texts_equal_the_plain_version(spark, odd_docs, tools, bound):
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(100 + i, t) for i, t in enumerate(BROKEN)]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in texts], "doc_id long, text string, pairs string, row int")
    got = alignment.cross_tokenizer_links(docs, BYTE_FILE, PIECE_FILE, broadcast_pairs=bound)
    assert rows_of(got) == plain_result(texts, tools)


def test_the_query_equals_the_plain_version(spark, sf_dir, tools):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows_of(QUERIES["op13_token_alignment"](spark, sf_dir))
    assert got == plain_result(texts, tools)
    assert sum(r[4] for r in got) == sum(r[1] + r[2] - r[3] for r in got)


def test_white_space_and_repeated_words_equal_the_plain_version(spark, tools, monkeypatch):
    rnd = random.Random(9)
    parts = list("abc it's,.!0\n\t\x0b\x1c\x85\xa0\u3000éñ日😀-") + [" "] * 6 + ["  ", " \n", "\n ", " \u2581", "the ", "the ", "\r"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    texts += [" ", "  ", "\n", " a", "a ", "a  ", "the \x1c", "the " * 3000, "x" * 5000 + " the", "the " + " " * 5000 + "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(alignment, "_ENCODED_BYTES", 100)
    monkeypatch.setattr(alignment, "_TEXT_BYTES", 2000)
    assert rows_of(alignment.cross_tokenizer_links(docs, BYTE_FILE, PIECE_FILE)) == plain_result(enumerate(texts), tools)


def test_files_that_join_across_white_space_get_whole_texts(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "_spaces_at_start", lambda source, model: False)
    texts = [(i, t) for i, t in enumerate([*BROKEN, "the cat  the\n the cat", None, ""])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows_of(alignment.cross_tokenizer_links(docs, BYTE_FILE, PIECE_FILE)) == plain_result(texts, tools)


def test_a_repeated_word_is_encoded_once(monkeypatch):
    sent = []
    encode = alignment.Pieces.encode
    monkeypatch.setattr(alignment.Pieces, "encode", lambda self, text: sent.append(text) or encode(self, text))
    aligner = alignment.aligner(open(BYTE_FILE, encoding="utf-8").read(), open(PIECE_FILE, "rb").read())
    texts = pa.array(["the cat", "the dog the", "cat the"] * 100)
    got = aligner(pa.array(range(300)), texts)
    assert sorted(" ".join(sent).split()) == ["cat", "dog", "the"]
    assert got.num_rows == 300 and pc.min(got["n_b"]).as_py() > 1


def test_no_documents(no_docs):
    assert alignment.cross_tokenizer_links(no_docs, BYTE_FILE, PIECE_FILE).collect() == []


def test_byte_level_equals_the_library(tools):
    own, rnd = alignment.ByteLevel(open(BYTE_FILE, encoding="utf-8").read()), random.Random(5)
    letters = list("abc etaoin  '.,!?\n\t\r\x0b\x1c\x85\xa0 ▁éßñΣ²½٣一日한é́_-<|>0123\x00\xad😀🏽‍")
    texts = BROKEN + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    assert own._ranks is not None
    for t in texts:
        assert own.encode(" " + t) == tools[0].encode(" " + t, add_special_tokens=False).ids


def test_galloping_finds_every_rank():
    rng = np.random.default_rng(2)
    for n, m in [(1, 1), (3, 50), (70, 65), (500, 90_000), (5000, 5001), (0, 4)]:
        other = np.sort(rng.choice(200_000, m, replace=False))
        driver = np.sort(rng.choice(other[-1] + 1, min(n, other[-1] + 1), replace=False))
        assert alignment.galloping_ranks(driver, other).tolist() == np.searchsorted(other, driver).tolist()


def test_alignment_is_symmetric():
    a, b = np.array([2, 3, 7, 9, 12]), np.array([3, 5, 6, 12])
    la, lb, ga, gb = alignment.align(a, b)
    ma, mb, ha, hb = alignment.align(b, a)
    assert list(zip(la, lb)) == list(zip(mb, ma)) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 3), (4, 3)]
    assert (ga.tolist(), gb.tolist()) == (hb.tolist(), ha.tolist()) == ([2, 5], [1, 4])
