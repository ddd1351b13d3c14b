"""Property tests: Spark cleaners agree with plain-Python statements of the
same rules on random messy strings (batched, one DataFrame per example)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import cleaning as C

ALPHABET = "0123456789.,₹$% abcXYZ-|\t"
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=12)), min_size=30, max_size=60)
NUM = re.compile(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def py_clean_price(s):
    if s is None:
        return None
    t = re.sub(r"[₹$,]", "", s)
    return float(t) if NUM.match(t) else None


def py_first_number(s):
    if s is None:
        return None
    m = re.search(r"(\d+\.?\d*)", s)
    return float(m.group(1)) if m else None


def py_count(s):
    if s is None:
        return None
    m = re.search(r"(\d+)", re.sub(r"[,\s]", "", s))
    return int(m.group(1)) if m else None


def py_segments(s):
    if not s:
        return 0
    return len([p for p in s.split(",") if p.strip()])


def _run(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return df.select(C.clean_price("x"), C.clean_rating("x"), C.clean_rating_count("x"),
                     C.count_segments("x")).collect()


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_cleaners_match_python(spark, values):
    for v, (price, rating, cnt, seg) in zip(values, _run(spark, values)):
        assert price == py_clean_price(v)
        assert rating == py_first_number(v)
        assert cnt == py_count(v)
        assert seg == py_segments(v)
