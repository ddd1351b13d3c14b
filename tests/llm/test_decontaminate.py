"""Benchmark decontamination: against a plain version, the parts of a split set, and removal."""

import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate
from shelfspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, LONG), (10, LONG.upper()), (2, "Short, item!"), (3, None), (4, "..."), (None, "item without an id"), (5, "été"),
         (2, "Short, item!"), (7, "ten eleven twelve one two three four five six seven eight")]
TEXTS = [
    (1, f"Before. {LONG}! After"), (2, "a short ITEM, short item short"), (3, None), (4, ""), (5, "-- .. --"),
    (6, LONG.replace("six", "6")), (6, f"{LONG} {LONG}"), (None, "an item without an id, ÉTÉ été"), (7, "x" * 30_000),
    (8, ("filler " * 50_000) + LONG), (9, "Short, item!"), (9, "Short, item!"), (11, "(" + LONG.title() + ")"),
    (12, "short-item " * 3000),
]


def lower(word):
    return "".join(c.lower() if c.isascii() else c for c in word)


def plain(texts, items, size=10):
    windows = {}
    for item_id, text in items:
        words = [lower(w) for w in WORD.findall(text or "")]
        k = min(size, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            windows.setdefault(tuple(words[i:i + k]), set()).add("" if item_id is None else str(item_id))
    sizes, found = {len(w) for w in windows}, []
    for doc_id, text in texts:
        words, hit, named = [lower(w) for w in WORD.findall(text or "")], set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                of = windows.get(tuple(words[i:i + k]))
                if of:
                    hit.update(range(i, i + k))
                    named |= of
        found.append((doc_id, len(words), tuple(sorted(hit)), tuple(sorted(named))))
    return sorted(found, key=repr)


def found_rows(df):
    return sorted(((r.doc_id, r.n_words, tuple(w for s in r.spans for w in range(s["first"], s["end"])), tuple(r.item_ids))
                   for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in TEXTS], "doc_id long, text string, size string, h int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, words int")


@pytest.mark.parametrize("set_rows", [1 << 22, 3])
def test_odd_texts_equal_the_plain_version(docs, items, set_rows):
    found = decontaminate.find_contamination(docs, items, set_rows=set_rows)
    assert found_rows(found) == plain(TEXTS, ITEMS)
    assert found.where(F.expr("n_hit <> aggregate(spans, 0, (s, x) -> s + x.end - x.first)")).isEmpty()


def test_empty_tables(spark, docs, items, no_docs):
    assert decontaminate.find_contamination(no_docs, items).collect() == []
    clean = decontaminate.find_contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(TEXTS) and not any(r.n_hit or r.item_ids for r in clean)


def test_the_query_equals_the_plain_version(spark, sf_dir):
    texts, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()]
                    for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = [(d, n, len(hit), len(ids), sha256(",".join(ids).encode()).hexdigest(), bool(hit)) for d, n, hit, ids in plain(texts, items)]
    got = QUERIES["op12_benchmark_decontamination"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(w[-1] for w in want)


def test_removal(docs, items):
    spans = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs, items).collect()}
    assert spans[1] == "Before! After" and spans[11] == ")" and spans[9] == "!"
    assert spans[8] == "filler " * 49_999 + "filler" and spans[3] is None and spans[7] == "x" * 30_000
    assert spans[2] == "a short" or spans[2].strip() == "a short"
    kept = decontaminate.remove_contamination(docs, items, drop_share=0)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]


def test_no_python_on_the_way(spark, docs, items):
    plan = decontaminate.find_contamination(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
