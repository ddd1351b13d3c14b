"""Main text of web pages as the maximum-scoring stretch of words and tags.

A page is read as a sequence of words and tags.  Words score positive and tags
negative; how much comes from labelled pages: a tag that stands outside the
content costs more the surer it does, and a word counts by the element it
stands in (words of elements that hold no content on labelled pages score
below zero).  One linear scan finds the contiguous stretch with the highest
sum.  Its text is the page's content, without the elements that are never
content (scripts, styles, menus and the like) and without the unlikely ones
(forms, and what class, id or role calls adverts, comments and the like) that
lie within the stretch.  Words of unlikely elements count less, by how often the
name stands around content on labelled pages; an unlikely element that holds the
whole stretch is a wrapper and cuts nothing, and neither does one of html, body,
main or article or one around a marked article.

Pages whose markup names the content (``article`` or ``main``) serve as
labelled pages: at most ``sample_pages`` of them, for fitting only; every page
is then judged by the fitted weights alone.

Edge cases: null and empty html and pages without words have the empty text;
cut-off pages, unclosed elements, comments and scripts end with the page; a
page of any length is read whole; without labelled pages words score 1 and
tags -1; equal rows are judged alike; an empty table gives no rows; other
columns are kept, ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    r"|<(script|style|template|noscript|svg|iframe|textarea|select)(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^<>]*+>?"
    r"|[^<]++|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?|"[^"]*+"|'[^']*+'""")
_NAMED = frozenset(("class", "id", "role"))
#: Elements that stand within a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article's text.
NEVER = frozenset("head title nav aside footer button menu dialog".split())
#: Words in class, id or role that mark what is seldom part of an article's text.
NEVER_NAMED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent disqus footer login masthead menu modal nav navbar navigation newsletter notice notices popup promo "
    "promoted related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_CONTENT = frozenset(("article", "main"))
_WHOLE = _CONTENT | {"html", "body"}
#: Share of content in an unlikely element: the one assumed, as seen in so many words, and the least.
_LIKELY, _LIKELY_WORDS, _LEAST_LIKELY = 0.25, 8, 0.05


def _names(attributes: str) -> list[str]:
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1] and m[1].lower() in _NAMED:
            found += re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())
    return [x for x in found if x]


class _Unlikely:
    """An element that is seldom or never content, linked to the next such element around it (``outer``).

    ``outside``: it stands outside marked content; ``wraps``: marked content stands
    in it.  At the page's end ``up`` is the next element around it that is no wrapper.
    """

    __slots__ = ("names", "outside", "wraps", "outer", "never", "in_never", "outside_names", "nearest_outside", "up")

    def __init__(self, names: frozenset[str], outside: bool, outer: _Unlikely | None, never: bool = False) -> None:
        self.names, self.outside, self.wraps, self.outer, self.never = names, outside, False, outer, never
        self.in_never = never or (outer is not None and outer.in_never)
        around = outer.outside_names if outer else frozenset()
        self.outside_names = around if not outside or names <= around else around | names
        self.nearest_outside = self if outside else outer.nearest_outside if outer else None
        self.up = outer

    @property
    def kept(self) -> _Unlikely | None:
        return self if self.never or not self.wraps else self.up


def _mark_wrappers(around: _Unlikely | None) -> None:
    """``around`` and all around it hold marked content; those marked before end the walk, as all around them are marked."""
    while around is not None and not around.wraps:
        around.wraps = True
        around = around.outer


class _Open(NamedTuple):
    """An open element: ``words`` and ``key`` are the keys of its words and of its tag, ``paragraph`` the place of a
    paragraph that a next one would end."""

    name: str
    words: str
    inside: bool
    around: _Unlikely | None
    key: str
    paragraph: int | None


_PAGE = _Open("", "", False, None, "", None)


def _parts(page: str, made: list[_Unlikely]) -> Iterator[tuple[str, str, str, bool, _Unlikely | None]]:
    """As ``read_page``, with the nearest unlikely element, wrappers too (known as such at the page's end).

    ``made`` gets every unlikely element, outer ones first.  The time is linear in
    the page, however deeply it nests and whatever is left open.
    """
    stack: list[_Open] = []
    open_names: Counter = Counter()

    def close(at: int) -> None:
        for x in stack[at:]:
            open_names[x.name] -= 1
        del stack[at:]

    for m in _TOKEN.finditer(page):
        token = m[0]
        top = stack[-1] if stack else _PAGE
        if token[0] != "<" or token == "<":
            yield "text", top.words, token, top.inside, top.around
            continue
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            key = name
            if open_names[name] > 0:
                at = len(stack) - 1
                while stack[at].name != name:
                    at -= 1
                key = stack[at].key
                close(at)
            outer = bool(stack) and stack[-1].inside
            yield "tag", f"/{key}", "", top.inside and outer, None
            continue
        inside, around = top.inside, top.around
        names = _names(m[4]) if m[4] else []
        block = top.words.rpartition("@")[2]
        key = f"{name}@{block}" if name in INLINE else ".".join([name, *names[:2]])
        yield "tag", key, "", inside, around
        if name in VOID or m[4].endswith("/"):
            continue
        if name == "p" and top.paragraph is not None:  # a paragraph ends where the next begins
            close(top.paragraph)
        marks = name in _CONTENT or "main" in names
        unlikely = NEVER_NAMED.intersection(names)
        if marks and around is not None:  # a comment marked as an article does not make the comments around it content
            _mark_wrappers(around.nearest_outside if unlikely else around)
        if name in NEVER or (name == "header" and not inside):
            if around is None or not around.in_never:
                made.append(around := _Unlikely(frozenset(), False, around, never=True))
        elif not marks and name not in _WHOLE and (unlikely or name == "form"):
            made.append(around := _Unlikely(unlikely | {"form"} if name == "form" else unlikely, not inside, around))
        words = key if name not in INLINE or name == "a" else stack[-1].words if stack else ""
        paragraph = len(stack) if name == "p" else stack[-1].paragraph if stack and name in INLINE else None
        stack.append(_Open(name, words, inside or marks, around, key, paragraph))
        open_names[name] += 1


def _read(page: str) -> tuple[list[tuple[str, str, str, bool, _Unlikely | None]], list[_Unlikely]]:
    """The parts of a page without wrappers around them, and all unlikely elements, outer ones first."""
    made: list[_Unlikely] = []
    parts = list(_parts(page, made))
    for x in made:
        x.up = x.outer.kept if x.outer else None
    return [(kind, key, text, inside, x.kept if x else None) for kind, key, text, inside, x in parts], made


def read_page(page: str) -> Iterator[tuple[str, str, str, bool, _Unlikely | None]]:
    """Parts of a page in order: (kind, key, text, inside marked content, nearest unlikely element around it).

    Kind is ``text`` (key: the element it stands in) or ``tag`` (key: the tag).
    Keys of links and other inline tags name the block around them: ``a@li``.
    """
    yield from _read(page)[0]


class Weights:
    """Scores of words by element and of tags."""

    def __init__(self, counts: dict[tuple[str, str], tuple[int, int]]) -> None:
        self.word: dict[str, float] = {}
        self.tag: dict[str, float] = {}
        self.likely: dict[str, float] = {}
        for (kind, key), (inside, outside) in counts.items():
            odds = math.log((inside + 0.5) / (outside + 0.5))
            if kind == "text":
                self.word[key] = max(-2.0, min(2.0, odds))
            elif kind == "name":
                share = (inside + _LIKELY * _LIKELY_WORDS) / (inside + outside + _LIKELY_WORDS)
                self.likely[key] = max(_LEAST_LIKELY, share)
            else:
                self.tag[key] = -0.25 - 4.0 * max(0.0, min(8.0, -odds))
        self.fitted = bool(counts)

    def of_word(self, key: str, around: _Unlikely | None = None, share: float = 1.0) -> float:
        """Words that are never content score 0 where they stand amid content, else below; others count by their ``share``."""
        never = around is not None and around.in_never
        score = self.word.get(key)
        if score is None:
            block = key.rpartition("@")[2]
            score = self.word.get(block, self.word.get(block.partition(".")[0], -1.0 if never else 1.0))
        if score <= 0:
            return score
        return 0.0 if never else score * share

    def shares(self, made: list[_Unlikely], wrappers: set[_Unlikely]) -> dict[_Unlikely | None, float]:
        """Per unlikely element the least share of content of it and all around it but ``wrappers``."""
        found: dict[_Unlikely | None, float] = {None: 1.0}
        for x in made:
            own = 1.0 if x in wrappers or not x.names else min(self.likely.get(n, _LIKELY) for n in x.names)
            found[x] = min(own, found[x.up])
        return found

    def of_tag(self, key: str) -> float:
        return self.tag.get(key, -1.0 if "@" in key else self.tag.get(key.partition(".")[0], -1.0))


def _best_range(parts: list[tuple], weights: Weights, shares: dict[_Unlikely | None, float]) -> tuple[int, int]:
    best = total = 0.0
    start = 0
    best_range = (0, 0)
    for i, (kind, key, text, _, around) in enumerate(parts):
        if kind == "tag":
            total += weights.of_tag(key)
        else:
            total += len(text.split()) * weights.of_word(key, around, shares[around])
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_range = total, (start, i + 1)
    return best_range


def _around_all(chosen: list[tuple], made: list[_Unlikely]) -> set[_Unlikely]:
    """The unlikely elements in which all words of ``chosen`` stand."""
    places = Counter(around for kind, _, text, _, around in chosen if kind == "text" and not text.isspace())
    total = sum(places.values())
    found = set()
    for x in reversed(made):
        if n := places[x]:
            if n == total:
                found.add(x)
            places[x.up] += n
    return found


def content(page: str | None, weights: Weights) -> str:
    """The text of the best stretch, white space turned into single spaces."""
    if not page:
        return ""
    parts, made = _read(page)
    wrappers: set[_Unlikely] = set()
    while True:  # a wrapper found is content: its words count in full from then on
        chosen = parts[slice(*_best_range(parts, weights, weights.shares(made, wrappers)))]
        found = _around_all(chosen, made) - wrappers
        if not found:
            break
        wrappers |= found
    wanted = {None}  # elements whose words are content: they and all around them are wrappers
    for x in made:
        if x in wrappers and x.up in wanted:
            wanted.add(x)
    out = []
    for kind, key, text, _, around in chosen:
        if kind == "tag":
            if "@" not in key and key.lstrip("/") not in INLINE:
                out.append(" ")
        elif around in wanted:
            out.append(html_lib.unescape(text))
    return " ".join("".join(out).split())


def fit_weights(pages: DataFrame, html_column: str = "html", sample_pages: int = 512) -> Weights:
    """Weights from ``sample_pages`` pages whose markup names the content, or all of them where there are fewer."""
    marked = pages.where(F.lower(html_column).rlike(r"<(article|main)[\s/>]"))
    total = marked.count()
    one_in = max(1, total // (2 * sample_pages))
    spread = F.xxhash64(*[F.col(c) for c, kind in pages.dtypes if c != html_column and not kind.startswith("map")], F.lit(1))
    least = marked.select(F.col(html_column).alias("html"), spread.alias("h"))
    likely = least.where(F.pmod("h", F.lit(one_in)) == 0)  # tasks hand on about twice the pages asked for
    if one_in > 1 and likely.limit(sample_pages).count() < sample_pages:  # rows with equal columns have one hash
        likely = least
    sample = likely.orderBy("h", "html").limit(sample_pages).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for page in b.column(0):
                for kind, key, text, inside, around in _parts(page.as_py(), []):
                    n = len(text.split()) if kind == "text" else 1
                    if kind == "text" and around:
                        for x in around.outside_names:
                            seen["name", x, inside] += n
                    for k in {key, key if "@" in key else key.partition(".")[0]}:
                        seen[kind, k, inside] += n
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array([k[2] for k in seen]),
                 pa.array(list(seen.values()), pa.int64())], names=["kind", "key", "inside", "n"])

    counted = sample.mapInArrow(count, "kind string, key string, inside boolean, n long")
    sums = counted.groupBy("kind", "key").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))))
    return Weights({(r[0], r[1]): (r[2], r[3]) for r in sums.collect()})  # tags of at most sample_pages pages


def extract_content(pages: DataFrame, html_column: str = "html", weights: Weights | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html column."""
    weights = weights or fit_weights(pages, html_column)
    kept = [f for f in pages.schema.fields if f.name not in (html_column, "text", "n_chars")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [content(p.as_py(), weights) for p in part.column(b.schema.get_field_index(html_column))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(b.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, html_column).mapInArrow(extract, schema)
