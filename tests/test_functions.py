"""Scalar Column functions: table-driven edge cases."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import cleaning as C
from shelfspark.functions.bins import price_tier
from shelfspark.functions.numeric import format_fixed, round_half_up
from shelfspark.functions.text import point_id, tokens
from shelfspark.operators.enrich import category_parts
from shelfspark.operators.model import confidence_score


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [
    ("₹1,299", 1299.0), ("$99.99", 99.99), ("1,234,567", 1234567.0), ("not a price", None), (None, None),
    ("1d", None), ("", None),
])
def test_clean_price(spark, raw, expected):
    assert one(spark, C.clean_price, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("4.5 out of 5 stars", 4.5), ("5", 5.0), ("|", None), (None, None), ("-3.5", 3.5),
])
def test_clean_rating(spark, raw, expected):
    assert one(spark, C.clean_rating, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("1,234 ratings", 1234), ("10,000", 10000), ("24269.0", 24269), ("none", None), (None, None),
])
def test_clean_rating_count(spark, raw, expected):
    assert one(spark, C.clean_rating_count, raw) == expected


@pytest.mark.parametrize("raw,expected", [("50%", 50.0), ("Save 30%", 30.0), ("no", None)])
def test_clean_discount(spark, raw, expected):
    assert one(spark, C.clean_discount, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("Computers&Accessories|Cables|USBCables", ("Computers&Accessories", "Cables", 3)),
    ("Electronics", ("Electronics", "Electronics", 1)),
    (" A | B ", ("A", "B", 2)),
    (None, ("Unknown", "Unknown", 0)),
    ("", ("Unknown", "Unknown", 0)),
])
def test_parse_category(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "c string")
    m, s, d = category_parts(F.col("c"))
    assert tuple(df.select(m, s, d).first()) == expected


@pytest.mark.parametrize("raw,expected", [("Hello World", 11), ("", 0), (None, 0), ("héllo", 5)])
def test_text_length(spark, raw, expected):
    assert one(spark, C.text_length, raw) == expected


@pytest.mark.parametrize("raw,expected", [("a,b,c", 3), ("a,,b", 2), (None, 0), ("", 0), (" , ", 0)])
def test_count_segments(spark, raw, expected):
    assert one(spark, C.count_segments, raw) == expected


@pytest.mark.parametrize("price,tier", [
    (0.0, "unknown"), (-5.0, "unknown"), (None, "unknown"), (500.0, "budget"), (500.01, "mid"),
    (2000.0, "mid"), (10000.0, "premium"), (10000.01, "luxury"),
])
def test_price_tier(spark, price, tier):
    assert one(spark, price_tier, price, "double") == tier


@pytest.mark.parametrize("p,r,c,expected", [(500.0, 4.0, 100, 1.0), (5.0, 6.0, 2, 0.45), (5.0, 4.0, 100, 0.8),
                                            (500.0, 0.5, 1, 0.56), (200000.0, 9.0, 0, 0.45)])
def test_confidence_score(spark, p, r, c, expected):
    df = spark.createDataFrame([(p, r, c)], "p double, r double, c long")
    assert df.select(confidence_score(F.col("p"), F.col("r"), F.col("c"))).first()[0] == expected


def test_round_half_up_ties(spark):
    df = spark.createDataFrame([(35.175,), (0.125,), (2.675,), (None,)], "x double")
    got = [r[0] for r in df.select(round_half_up("x", 2)).collect()]
    assert got[:3] == [35.18, 0.13, 2.68] and got[3] is None


def test_format_fixed_matches_python(spark):
    random.seed(7)
    vals = [7381.685, 7418.625, 12.345, 2.675, 1.005, 0.125] + [random.uniform(0, 10000) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (1, 2):
        got = [r[0] for r in df.select(format_fixed(F.col("x"), d)).collect()]
        assert got == [f"%.{d}f" % v for v in vals]


def test_uuid5_matches_python(spark):
    ids = ["123", "B07XYZ", "héllo", "", "a" * 100, "550e8400-e29b-41d4-a716-446655440000",
           "{550E8400-E29B-41D4-A716-446655440000}"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [r[0] for r in df.select(point_id("id")).collect()]
    want = []
    for i in ids:
        try:
            want.append(str(uuid.UUID(i)))
        except ValueError:
            want.append(str(uuid.uuid5(uuid.NAMESPACE_DNS, i)))
    assert got == want


def test_tokens(spark):
    df = spark.createDataFrame([("It's a GREAT product's day, 2024 déjà-vu",)], "t string")
    assert df.select(tokens("t")).first()[0] == ["it", "a", "great", "product", "day", "2024", "déjà", "vu"]


def test_log1p_matches_math(spark):
    df = spark.createDataFrame([(0,), (9,), (49999,)], "c long")
    got = [r[0] for r in df.select(F.log1p(F.col("c").cast("double"))).collect()]
    assert all(abs(a - math.log1p(b)) < 1e-12 for a, b in zip(got, [0, 9, 49999]))
