"""Token ids: ORC files, packing, and the encoder against the tokenizers library."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest

from shelfspark.llm import bpe, digests, orc_tokens, packing
from shelfspark.llm.queries import QUERIES
from shelfspark.llm.tokens import TextEncoder, read_tokenizer
from shelfspark.session import shared_dir

LETTERS = list("abcdefghij ETAOIN  '.,!?\n\t\x1c\x85\xa0 éèßÀÿ×÷ÇñΣσςİı½²٣一日語한é̀́_-<|>0123456789\x00\xad😀")


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    made = ["", " ", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "it's we'll I'M ''s", "a" * 3000, "é" * 500, "ΑΣ ΟΔΟΣ"]
    return made + ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def test_encoders_equal_the_library(tokenizer, tokenizer_path):
    spec = read_tokenizer(tokenizer_path)
    small, own = TextEncoder(spec, cache_words=50), bpe.WordBpe(spec, cache_words=200)
    texts = random_texts(1500)
    got = [x for i in range(0, len(texts), 100) for x in own.encode_texts(texts[i:i + 100])]
    for text, mine in zip(texts, got):
        want = ids_of(tokenizer, text)
        assert np.frombuffer(small.encode(text), "<u4").tolist() == want
        assert np.frombuffer(mine, "<u4").tolist() == want
        assert own.decode(want) == tokenizer.decode(want, skip_special_tokens=False)


def test_a_column_of_texts_equals_the_library(tokenizer, tokenizer_path):
    encoder, texts = TextEncoder(read_tokenizer(tokenizer_path)), [None, "x", *random_texts(1500), None, "a\x01b \x00 c\x00", "y" * 1001]
    assert encoder._joined is not None
    joined = encoder._joined
    for encoder._joined in (joined, None):
        ids, sizes = encoder.encode_column(pa.array(texts, pa.string()).slice(1))
        assert sizes.tolist() == [len(ids_of(tokenizer, t)) for t in texts[1:]]
        assert ids.tolist() == [i for t in texts[1:] for i in ids_of(tokenizer, t)]
        assert [x.tolist() for x in encoder.encode_column(pa.array([], pa.string()))] == [[], []]
        assert [x.tolist() for x in encoder.encode_column(pa.array([None, " "], pa.string()))] == [[], [0, 0]]


def test_plain_words_of_a_column_are_encoded_together(tokenizer, tokenizer_path, monkeypatch):
    called = []
    monkeypatch.setattr(TextEncoder, "_word", lambda self, word: called.append(word) or b"")
    ids, sizes = TextEncoder(read_tokenizer(tokenizer_path)).encode_column(pa.array(["It's 12,5 Été!", "été it's", "日 日"]))
    assert called == ["日"]
    assert ids.tolist() == ids_of(tokenizer, "It's 12,5 Été! été it's") and sizes[2] == 0


def test_a_vocabulary_whose_entries_are_not_their_own_encoding_goes_word_by_word(tokenizer_path):
    spec = json.loads(read_tokenizer(tokenizer_path))
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    last = max(vocabulary.values())
    vocabulary["h~"], vocabulary["th~"] = last + 1, last + 2
    shape = list if isinstance(merges[0], list) else " ".join
    spec["model"]["merges"] = [*merges, shape(["h", "~"]), shape(["t", "h~"])]  # "th" is merged first: "t" never meets "h~"
    spec["added_tokens"] = []
    assert last + 1 == 512 + len(merges)
    assert TextEncoder(json.dumps(spec))._joined is None


def test_segment_tree_takes_the_leftmost_lowest_rank(tokenizer_path):
    own = bpe.WordBpe(read_tokenizer(tokenizer_path))
    rank = {int(k): int(r) for k, r in zip(own._keys, own._ranks)}
    words = ["abcabcabc", "aaaaaaa", "thethethe", "x", "zq" * 40]

    def plain(word):
        symbols = [int(own._byte[b]) for b in word.encode()]
        symbols[-1] = int(own._last_byte[word.encode()[-1]])
        while True:
            found = [(rank[a << 32 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 32 | b in rank]
            if not found:
                return symbols
            r, i = min(found)
            symbols[i:i + 2] = [int(own._merged[r])]

    got = own.merge_all(set(words))
    assert {w: np.frombuffer(got[w], "<u4").tolist() for w in words} == {w: plain(w) for w in words}


def test_decode_skips_unknown_ids(tokenizer_path):
    own = bpe.WordBpe(read_tokenizer(tokenizer_path))
    assert own.decode([99_999_999]) == "" and own.decode([]) == ""


def check_orc(spark, tokenizer, docs, rows):
    path = shared_dir(spark, "test", "orc", unique=True)
    orc_tokens.write_token_orc(docs, path, tokenizer_path=rows["path"], end_id=2)
    got = orc_tokens.read_token_orc(spark, path).orderBy("start").collect()
    texts = sorted(((i is not None, i or 0, t is not None, t or ""), i, t) for i, t in rows["docs"])
    start = 0
    for g, (_, i, t) in zip(got, texts):
        want = [*ids_of(tokenizer, t), 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (i, start, len(want), want)
        start += len(want)
    assert len(got) == len(texts)
    return path


def test_orc_round_trip_of_odd_rows(spark, tokenizer, tokenizer_path, odd_docs, no_docs):
    from tests.llm.conftest import ODD_TEXTS

    check_orc(spark, tokenizer, odd_docs, {"path": tokenizer_path, "docs": ODD_TEXTS})
    check_orc(spark, tokenizer, no_docs, {"path": tokenizer_path, "docs": []})


def test_orc_files_are_ordered_indexed_and_pruned(spark, sf_dir, tokenizer_path):
    path = shared_dir(spark, "test", "orc", unique=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    orc_tokens.write_token_orc(docs, path, tokenizer_path, partitions=2, stripe_bytes=1 << 16, row_index_stride=1000)
    import glob

    files = sorted(glob.glob(f"{path}/*.orc"))
    ids = [orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist() for f in files]
    assert [x for f in ids for x in f] == sorted(x for f in ids for x in f)
    jvm = spark._jvm
    options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), options)
    assert reader.getRowIndexStride() == 1000
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())}
    assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
    one = orc_tokens.read_token_orc(spark, path, doc_ids=[17, 42])
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString()
    every = {r.doc_id: r for r in orc_tokens.read_token_orc(spark, path).collect()}
    assert {r.doc_id: r for r in one.collect()} == {i: every[i] for i in (17, 42)}


def test_op1_query(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op1_orc_token_ids"](spark, sf_dir).collect()}
    start = 0
    for r in docs:
        ids = np.array([*ids_of(tokenizer, r.text), 2], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_plain_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 2, 3, 5, 7, 11, 19, 20, rnd.randint(1, 20)]) for _ in range(300)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_best_fit_decreasing(histogram, 20)
    used = defaultdict(int)
    for length, _, first, _, count in plan.tolist():
        for s in range(first, first + count):
            used[s] += length
    assert sorted(20 - u for u in used.values()) == plain_best_fit(lengths, 20)
    assert packing.plan_best_fit_decreasing({}, 20).shape == (0, 5)


def check_packed(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_odd_rows(spark, tokenizer, tokenizer_path, odd_docs, no_docs):
    from tests.llm.conftest import ODD_TEXTS

    pieces = packing.token_pieces(odd_docs, tokenizer_path, capacity=64, end_id=0)
    rows = packing.best_fit_pack(pieces, capacity=64).collect()
    want = sorted((str(i), p // 64, tuple(ids[p:p + 64])) for i, t in ODD_TEXTS
                  for ids in [[*ids_of(tokenizer, t), 0]] for p in range(0, len(ids), 64))
    assert sorted((str(r.doc_id), r.piece, tuple(r.ids)) for r in rows) == want
    assert all(r.start == 64 * r.piece and r.length == len(r.ids) for r in rows)
    assert check_packed(rows, 64) == len(plain_best_fit([r.length for r in rows], 64))
    assert packing.best_fit_pack(packing.token_pieces(no_docs, tokenizer_path), capacity=64).collect() == []


def test_packing_keeps_other_columns_and_refuses_bad_lengths(spark):
    items = spark.createDataFrame([(3, "a"), (3, "a"), (8, None), (8, "b"), (5, "c")], "length int, offset string")
    rows = packing.best_fit_pack(items.withColumn("note", items["offset"]), capacity=8).collect()
    assert sorted((r.length, str(r.note)) for r in rows) == [(3, "a"), (3, "a"), (5, "c"), (8, "None"), (8, "b")]
    assert check_packed(rows, 8) == 4
    with pytest.raises(Exception, match="lengths must lie in"):
        packing.best_fit_pack(spark.createDataFrame([(9,)], "length int"), capacity=8).collect()


def test_op3_query(spark, sf_dir, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_best_fit_packing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ids = np.array([*ids_of(tokenizer, docs[r.doc_id]), 0], "<u4")[r.start:r.start + 2048]
        assert (r.start, r.length, r.ids_crc32) == (2048 * r.piece, len(ids), zlib.crc32(ids.tobytes()))
    assert check_packed(rows, 2048) == len(plain_best_fit([r.length for r in rows], 2048))


def test_op10_query_and_odd_rows(spark, sf_dir, tokenizer, tokenizer_path, odd_docs, no_docs):
    import hashlib

    from tests.llm.conftest import ODD_TEXTS

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op10_bpe_round_trip"](spark, sf_dir).collect():
        ids = ids_of(tokenizer, docs[r.doc_id])
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                hashlib.sha256(decoded.encode()).hexdigest())
    rows = bpe.decode_ids(bpe.encode_documents(odd_docs, tokenizer_path), tokenizer_path).collect()
    want = sorted((str(i), tuple(ids_of(tokenizer, t))) for i, t in ODD_TEXTS)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in rows) == want
    assert all(r.decoded == tokenizer.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert bpe.encode_documents(no_docs, tokenizer_path).collect() == []
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_ids(nulls, tokenizer_path).collect()] == ["", ""]


def test_crc_of_sliced_lists(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, [7])], "k int, ids array<int>")
    got = {r.k: (r.n_ids, r.ids_crc32) for r in digests.with_ids_crc32(df).collect()}
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in ((1, [1, 2]), (2, []), (3, [7]))}
