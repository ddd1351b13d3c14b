"""Language identification, page content, near-duplicates, repeated strings and the pipeline."""

import bisect
import hashlib
import html
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import common, html_content, langid, packing, prob_minhash, suffix_dedup, tokens
from shelfspark.llm.components import connected_components
from shelfspark.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS

# ---------------------------------------------------------------- language


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 30])
def test_code_words_tell_languages_apart(n):
    code = langid.code_words(n)
    assert set(np.unique(code)) <= {-1, 1}
    assert all((a != b).any() for a, b in itertools.combinations(code, 2))
    assert (np.abs(code.sum(axis=0)) < n).all()  # every bit splits the languages


def test_op2_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_ecoc_language"](spark, sf_dir).collect()
    import zlib

    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = langid.train_language_model(
        spark.createDataFrame([(i, f"the {w} and the other thing", "en") for i, w in enumerate("abcdefgh")]
                              + [(100 + i, f"le {w} et une autre chose dans", "fr") for i, w in enumerate("abcdefgh")]
                              + [(None, "nothing", "en"), (300, None, "en"), (301, "x", None), (302, "...", "fr")],
                              "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    rows = langid.identify_languages(odd_docs, model).collect()
    texts = Counter((str(i), t) for i, t in ODD_TEXTS)
    assert Counter((str(r.doc_id), r.text) for r in rows) == texts
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter) and 0 <= r.score <= 1
    assert langid.identify_languages(no_docs, model).collect() == []
    none = langid.train_language_model(no_docs)
    assert none.languages == [] and {r.lang_pred for r in langid.identify_languages(odd_docs, none).collect()} == {"und"}
    one = langid.train_language_model(odd_docs)
    assert one.languages == ["en"] and {r.lang_pred for r in langid.identify_languages(odd_docs, one).collect()} == {"en", "und"}


def test_features_read_whole_texts():
    text = "abc def " * 60_000
    assert np.allclose(langid.features(text), langid.features("abc def " * 30_000 + "abc def " * 30_000))
    assert not np.allclose(langid.features(text), langid.features(text + "zzyzx " * 60_000))


# ---------------------------------------------------------------- pages


def marked_content(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", body))
    return " ".join(html.unescape(body).split())


def test_op8_query_equals_marked_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op8_html_content"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, marked_content(pages[r.page_id].html), len(r.text))


BOILERPLATE = (
    "<html><head><title>T</title><style>p{}</style><script>if (a<b) x('</p>')</script></head><body><header>Site name</header>"
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>Other page</a></li></ul></nav><div class=\"ad banner\">Buy this now</div>"
    "<article>{}</article><aside>Around the web</aside><form><input><label>Mail</label></form>"
    "<div id='comments'><p>first!</p><p>nice words here</p></div><footer>&copy; site</footer></body></html>")


def test_content_of_odd_pages(spark):
    body = ("<h1>Caf&eacute; &amp; more</h1><p>One\n two  <b>th</b>ree</p><!-- <p>no</p> --><p>four<br>five <a href=x>six</a>"
            "<div class=\"share\">Share me</div><p>" + "long text " * 4000 + "</p>")
    want = "Café & more One two three four five six " + ("long text " * 4000).strip()
    pages = [(i, "u", BOILERPLATE.replace("{}", f"<h1>Page {i}</h1><p>{'some words of text ' * 9}</p>")) for i in range(40)]
    pages += [(100, "u", BOILERPLATE.replace("{}", body)), (101, "u", None), (102, "u", ""), (103, "u", "<html><body></body>"),
              (104, "u", "just text"), (None, None, "<p>cut off &am"), (106, "u", "<p>open <b>never closed"), (106, "u", "a < b")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = {}
    for r in html_content.extract_content(df).collect():
        rows.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert rows[3][0].text == "Page 3 " + ("some words of text " * 9).strip()
    assert rows[100][0].text == want
    assert [rows[i][0].text for i in (101, 102, 103)] == ["", "", ""]
    assert len(rows[106]) == 2
    assert html_content.extract_content(df.limit(0)).collect() == []


@pytest.mark.parametrize("before", [
    "<svg-icon name=x></svg-icon>", "<select-box>", "<svg class=i/>", "<svg aria-label='a > b' />", "<svg/>",
    "<svg class='a/b'><title>no</title></svg>", "<select><option>no</select>", "<script src='x/'>no</script>"])
def test_raw_elements_end_where_they_end(before):
    page = f"<body>{before}<article><p>{'words of the article ' * 9}{before}</p></article><svg></svg><select></select></body>"
    assert html_content.content(page, html_content.Weights({})) == ("words of the article " * 9).strip()


WRAPPERS = [
    '<body class="has-sidebar"><nav>Home</nav>{}</body>', '<body><main class="with-sidebar">{}</main></body>',
    '<body><article class="post comments-open">{}</article></body>', '<body><div id="no-sidebar"><article>{}</article></div></body>',
    '<body><main><div class="has-widget"><article>{}</article></div></main></body>',
    '<body><form action="/"><div>{}</div></form></body>', '<body><div id="no-sidebar">{}</div><div class="ad">Buy this now</div></body>']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_names_of_wrappers_do_not_cut_the_page(spark, wrapper):
    text = "some words of text " * 30
    inner = f"<h1>A page of words</h1><p>{text}</p><div class='share'>Share me</div><p>{text}</p>"
    page = wrapper.replace("{}", inner)
    labelled = [(i, BOILERPLATE.replace("{}", f"<h1>Page {i}</h1><p>{text}</p>")) for i in range(40)]
    fitted = html_content.fit_weights(spark.createDataFrame(labelled, "page_id long, html string"))
    assert html_content.content(page, fitted) == " ".join(f"A page of words {text} {text}".split())
    assert html_content.content(page.replace("<h1>A page of words</h1>", ""), html_content.Weights({})) == " ".join(f"{text} {text}".split())


@pytest.mark.parametrize("attribute", ['data-id="comments"', 'data-role="banner"', "aria-class=promo", "title='class=ad'"])
def test_names_come_from_whole_attributes(attribute):
    text = "some words of text " * 9
    page = f"<body><article><p>{text}</p><p {attribute}>{text}</p><p id = 'comments'>No</p></article></body>"
    assert html_content.content(page, html_content.Weights({})) == " ".join((text + text).split())


@pytest.mark.parametrize("opened, closed", [
    ("<div class=ad>", ""), ("<div class=ad>w", "</div>"), ("<b>", "</i>"), ("<p><div>", "<p></p>"), ("<div id=share><main>", ""),
    ("<form><article class=comment>", "<p>"), ("<b>", "<p></p>"), ("<nav class=ad>", "</nav>")])
def test_deeply_nested_and_unclosed_pages_take_linear_time(opened, closed):
    import time
    text = "some words of text " * 9
    page = f"<article><p>{text}</p></article>{opened * 50_000}{closed * 50_000}"
    began = time.monotonic()
    assert text.strip() in html_content.content(page, html_content.Weights({}))
    assert time.monotonic() - began < 20


def test_comments_marked_as_articles_are_no_content():
    text = "some words of text " * 30
    page = f"<main><article><p>{text}</p></article><div id='comments'><article class='comment'><p>first!</p></article></div></main>"
    assert html_content.content(page, html_content.Weights({})) == text.strip()


def test_all_of_few_marked_pages_are_fitted(spark):
    """What few marked pages say does not depend on how many pages without marks stand beside them."""
    marked = [(i, BOILERPLATE.replace("{}", f"<h1>Page {i}</h1><p>{'some words of text ' * 9}</p>")) for i in range(12)]
    plain = [(100 + i, "<article-list><p>other</p></article-list>") for i in range(4000)]
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, html string")
    alone, beside = (html_content.fit_weights(frame(x), sample_pages=64) for x in (marked, marked + plain))
    assert alone.word and (alone.word, alone.tag) == (beside.word, beside.tag)
    same = spark.range(4000).select(F.lit(marked[0][1]).alias("html"))  # one hash for all rows
    assert html_content.fit_weights(same, sample_pages=64).word


def test_best_stretch_is_the_maximum_sum():
    rnd = random.Random(2)
    weights = html_content.Weights({})
    for _ in range(200):
        page = "".join(rnd.choice(["<p>", "</p>", "<div>", "</div>", "w ", "w w w ", "<i>"]) for _ in range(rnd.randint(0, 14)))
        parts = list(html_content.read_page(page))
        scores = [weights.of_tag(k) if kind == "tag" else len(t.split()) * weights.of_word(k, never) for kind, k, t, _, never in parts]
        best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        assert (html_content.content(page, weights) != "") == (best > 0)


# ---------------------------------------------------------------- near-duplicates


def shingles(text, size=5):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    size = min(size, len(words))
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def plain_similarity(a, b):
    if not a or not b:
        return 0.0
    keys = a.keys() | b.keys()
    jaccard = len(a.keys() & b.keys()) / len(keys)
    probability = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in keys) for i in a.keys() & b.keys())
    return max(jaccard, probability)


def plain_classes(docs):
    """doc_id -> smallest id of its class, by comparing all documents that share a shingle."""
    bags = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sorted(bags):
        for s in bags[i]:
            holders[s].append(i)
    for i in sorted(bags):
        shared = Counter(j for s in bags[i] for j in holders[s] if j < i)
        for j, n in shared.items():
            if find(i) != find(j) and plain_similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in docs}


def test_similarity_is_the_probability_jaccard():
    rnd = random.Random(6)
    for _ in range(60):
        a = " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
        b = " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
        mine = prob_minhash.similarity(prob_minhash._counted(a, 2), prob_minhash._counted(b, 2))
        assert mine == pytest.approx(plain_similarity(shingles(a, 2), shingles(b, 2)))


def test_registers_agree_with_the_probability_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 2 ** 63, size=60).astype(np.uint64)
    a, b = (ids[:45], np.arange(1, 46) % 4 + 1), (ids[10:], np.arange(1, 51) % 3 + 1)
    x, y = dict(zip(*(z.tolist() for z in a))), dict(zip(*(z.tolist() for z in b)))
    true = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})
    signature = prob_minhash.prob_minhash([a, b, (ids[:1], np.array([3]))], 4000)
    assert np.mean(signature[0] == signature[1]) == pytest.approx(true, abs=0.03)
    assert (signature[2] == ids[0]).all()


def near_copies():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    docs, n = {}, 0
    for size in (12, 60, 200):
        base = [word() for _ in range(size)]
        for copy in range(12):
            words = list(base)
            if copy and size > 12:
                words[rnd.randrange(size)] = word()
            docs[n] = " ".join(words) if copy % 3 else " ".join(words).upper() + "!"
            n += 1
    chain = [word() for _ in range(100)]  # each near to the next only
    for step in range(6):
        docs[n] = " ".join(chain)
        chain = chain[2:] + [word(), word()]
        n += 1
    for _ in range(30):
        docs[n] = " ".join(word() for _ in range(50))
        n += 1
    docs |= {n: None, n + 1: "", n + 2: "...", n + 3: "one", n + 4: "One!", n + 5: "x " * 5000, n + 6: "x " * 5001}
    return docs


def test_classes_equal_brute_force(spark):
    docs = near_copies()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs.items()] + [(None, "one", "clash", 1), (3, docs[3], "clash", 1)],
                               "doc_id long, text string, key string, hub long").repartition(3)
    rows = prob_minhash.near_duplicates(df).collect()
    assert len(rows) == len(docs) + 2
    assert {r.doc_id: r.class_id for r in rows} == {**plain_classes(docs), None: None}


def test_large_buckets_of_texts_that_share_a_passage(spark):
    """Many texts share most of their words and are not near; a few of them are."""
    rnd = random.Random(12)
    words = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(10 ** 6)) for _ in range(n)]
    core, docs = words(60), {}
    for i in range(120):
        docs[i] = " ".join(core + words(16))
    for i in range(120, 150):  # near to one of them
        parts = docs[i - 120].split()
        parts[3] = "other"
        docs[i] = " ".join(parts)
    for i in range(150, 155):  # mostly core: near to each other
        docs[i] = " ".join(core + words(3))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(df).collect()} == plain_classes(docs)


def repeated_lines():
    """Pairs with nearly equal shingle sets of which one text repeats a line many times."""
    rnd = random.Random(21)
    words = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(10 ** 6)) for _ in range(n)]
    docs = {}
    for i, (size, times) in enumerate([(504, 100)] * 8 + [(304, 200)] * 8):
        base, line = words(size), words(14)
        docs[2 * i], docs[2 * i + 1] = " ".join(base + line), " ".join(base + line * times)
    return docs


def test_classes_of_texts_that_repeat_a_line(spark):
    docs = repeated_lines()
    assert plain_classes(docs) == {i: i - i % 2 for i in docs}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(df).collect()} == plain_classes(docs)


def test_classes_of_odd_and_no_rows(spark, odd_docs, no_docs):
    rows = prob_minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == len(ODD_TEXTS) and {r.class_id for r in rows if r.doc_id == 5} == {5}
    assert prob_minhash.near_duplicates(no_docs).collect() == []


def test_op9_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in QUERIES["op9_prob_minhash"](spark, sf_dir).collect()} == plain_classes(docs)


def test_rows_that_share_an_id(spark):
    """Classes go by row: every distinct text keeps a row, whatever its id."""
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(80))
    rows = [(3, words("a"), "x"), (5, words("a") + " end", "x"), (5, words("b"), "x"), (3, words("c"), "x"), (3, words("d"), "x"),
            (7, words("a").upper(), "x"), (5, words("b"), "x"), (8, "?!", "x"), (8, "", "x"), (None, words("a"), "x"), (3, "..", "x"),
            (2, words("d") + " more", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(3)
    kept = prob_minhash.one_of_each_class(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(3, words("a")), (5, words("b")), (3, words("c")), (2, words("d") + " more"), (8, "?!"), (8, ""), (None, words("a")), (3, "..")],
        key=repr)
    found = {(r.doc_id, r.class_id) for r in prob_minhash.near_duplicates(df).collect()}
    assert found == {(3, 3), (5, 3), (5, 5), (7, 3), (8, 8), (None, None), (3, 2), (2, 2)}


def test_blocks_join_what_is_near(spark, monkeypatch):
    """A cluster dealt into many small blocks has the classes of brute force; its links are no more than needed."""
    rnd = random.Random(4)
    words = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(10 ** 6)) for _ in range(n)]
    core, docs = words(50), {}
    for i in range(90):
        docs[i] = " ".join(core + words(rnd.choice([2, 6, 12])) + (["again"] * rnd.choice([0, 0, 30])))
    members = spark.createDataFrame([(i, i, 0) for i in docs], "id long, label long, cluster long")
    texts = spark.createDataFrame(list(docs.items()), "id long, text string")
    links = prob_minhash._links_between_blocks(members, texts, 0.8, 5, block_rows=20).collect()
    labels = {r.id: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {i: labels.get(i, i) for i in docs} == plain_classes(docs)
    assert len(links) <= 15 * len(docs)
    assert not prob_minhash._links_between_blocks(members.withColumn("label", F.lit(0)), texts, 0.8, 5).collect()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 299), (299, 300)]
    labels = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.label for r in labels} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 299: 299, 300: 299}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- repeated strings


def plain_removal(docs, window):
    """(id, text) in order -> (n_bytes, kept, spans) by looking up every window."""
    seen, found = set(), []
    for _, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            piece = data[p:p + window]
            if piece in seen:
                gone[p:p + window] = b"\1" * window
            seen.add(piece)
        spans, at = [], 0
        for value, group in itertools.groupby(gone):
            n = len(list(group))
            if value:
                spans.append((at, at + n))
            at += n
        found.append((len(data), bytes(b for b, g in zip(data, gone) if not g), spans))
    return found


def random_repeats(seed):
    rnd = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdé "
    passages = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 80))) for _ in range(6)]
    docs = [(i, "".join(rnd.choice(passages) if rnd.random() < 0.5 else rnd.choice(letters) * rnd.randint(1, 30)
                        for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    return docs + [(60, None), (61, ""), (62, passages[0] * 30)]


@pytest.mark.parametrize("seed", range(6))
def test_removal_equals_brute_force(spark, seed):
    docs = random_repeats(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, block string").repartition(4)
    df = df.withColumnRenamed("block", "extra")
    rows = suffix_dedup.remove_repeats(df, window=20, gram=6, block_bytes=1200, range_bytes=1500).collect()
    got = {r.doc_id: (r.n_bytes, bytes(r.kept), [tuple(s) for s in r.removed]) for r in rows}
    assert got == {i: x for (i, _), x in zip(docs, plain_removal(docs, 20))}
    assert {r.extra for r in rows} == {"clash"}


def test_removal_of_odd_and_no_rows(spark, odd_docs, no_docs):
    rows = suffix_dedup.remove_repeats(odd_docs).collect()
    assert len(rows) == len(ODD_TEXTS)
    by_text = dict(zip([r.doc_id for r in rows], rows))
    assert by_text[9].n_bytes == 30_000 and bytes(by_text[9].kept) == b"x"  # every later window starts earlier too
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def test_long_documents_in_slices(spark):
    rnd = random.Random(1)
    tail = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    long = "".join(rnd.choice("abcdefgh") for _ in range(600_000)) + tail
    df = spark.createDataFrame([(2, "zz" + tail + "yy"), (1, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, block_bytes=100_000).collect()}
    assert bytes(got[2].kept) == b"zzyy" and bytes(got[1].kept) == long.encode()


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(4)
    for count in (1, 2, 3, 7, 8):
        lists = [sorted("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))).encode() for _ in range(rnd.randint(1, 40)))
                 for _ in range(count)]
        runs = [suffix_dedup.Run(suffix_dedup.front_code(x, np.zeros(len(x), suffix_dedup._ITEM))) for x in lists]
        got, last = [], b""
        for run, shared in suffix_dedup.merge_runs(runs):
            prefix = next((i for i, (a, b) in enumerate(zip(last, run.text)) if a != b), min(len(last), len(run.text)))
            assert shared == prefix or not got
            got.append(run.text)
            last = run.text
        assert got == sorted(itertools.chain(*lists))


def test_op7_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()}
    for (i, _), (n, kept, spans) in zip(docs, plain_removal(docs, 100)):
        assert got[i] == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


# ---------------------------------------------------------------- pipeline


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a word "), 1500).alias("text"))
    few = docs.limit(3)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for stage in (suffix_dedup.remove_repeats, prob_minhash.one_of_each_class, packing.best_fit_pack):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        if stage is packing.best_fit_pack:
            stage(spark.createDataFrame([(1,)], "length int")).count()
        else:
            stage(few).count()
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        sizes = [r.n for r in sizes.collect()]
        assert sum(sizes) > 20e6 and max(sizes) < 6e6


def test_a_step_drops_what_other_steps_left_in_its_worker(tokenizer_path):
    spec = tokens.read_tokenizer(tokenizer_path)
    first = tokens.worker_encoder(spec)
    assert tokens.worker_encoder(spec) is first
    step = common.lean(lambda batches: (len(common.worker_cache()) for _ in batches))
    held = [k for k in common.worker_cache() if not isinstance(k, tuple)]
    assert list(step(iter("ab"))) == [len(held)] * 2
    assert tokens.worker_encoder(spec) is not first


def test_blocks_get_the_rows_of_all_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_DEALT_BYTES", 2000)
    docs = spark.range(0, 300, 1, 2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        blocks = suffix_dedup.pack_blocks(docs, 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(i for b in blocks for i in suffix_dedup.read_block(b.data)["doc_id"].to_pylist()) == [*range(300)]
    assert len(blocks) == 4


def test_pipeline_equals_brute_force(spark, sf_dir, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    classes = plain_classes(docs)
    kept = [(i, docs[i]) for i in sorted(docs) if classes[i] == i]
    texts = {i: left.decode("utf-8", "ignore") for (i, _), (_, left, _) in zip(kept, plain_removal(kept, 100))}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += r.ids
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
    room = []  # best-fit decreasing over a sorted list of what is left in each sequence
    for length in sorted((r.length for r in rows), reverse=True):
        at = bisect.bisect_left(room, length)
        bisect.insort(room, (room.pop(at) if at < len(room) else 2048) - length)
    assert len(used) == len(room)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:])) and places[0][1] == 0


def test_stages_keep_columns_and_odd_rows(spark, odd_docs, no_docs, sf_dir):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs.select(columns), no_docs.select(columns)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns
        rows = docs.collect()
        packed = packing.best_fit_pack(packing.token_pieces(docs, corpus_pipeline.tokenizer_path())).collect()
        assert len({(r.doc_id, r.piece) for r in packed}) >= len({r.doc_id for r in rows})
    assert rows == []


def test_stage_decisions(spark, odd_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    known = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert sorted(str(r.doc_id) for r in known.collect()) == sorted(
        str(i) for i, t in ODD_TEXTS if any(c.isalpha() for c in t or ""))
    one = corpus_pipeline.one_of_each_class(spark, known, sf_dir).collect()
    assert Counter(str(r.doc_id) for r in one) == Counter(["5", "None", "9", "4", "4", "11", "12"])
    assert known.where(F.col("lang").isNull()).count() == 0
