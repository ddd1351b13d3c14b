"""Scalar cleaners for raw catalog text, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.numeric import parse_double

_FIRST_NUMBER = r"(\d+\.?\d*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_price(c: Column | str) -> Column:
    """Delete ``₹ $ ,`` then parse a double; unparseable text → null."""
    stripped = F.regexp_replace(_col(c).cast("string"), "[₹$,]", "")
    return parse_double(stripped)


def _first_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c).cast("string"), _FIRST_NUMBER, 1), F.lit(""))


def clean_rating(c: Column | str) -> Column:
    """First ``\\d+\\.?\\d*`` run as a double (sign is lost), else null."""
    return _first_number(c).try_cast("double")


def clean_discount(c: Column | str) -> Column:
    """First numeric run as a double: ``'Save 30%'`` → 30.0."""
    return _first_number(c).try_cast("double")


def clean_rating_count(c: Column | str) -> Column:
    """Delete commas and whitespace, then the first digit run as a long."""
    squeezed = F.regexp_replace(_col(c).cast("string"), r"[,\s]", "")
    digits = F.nullif(F.regexp_extract(squeezed, r"(\d+)", 1), F.lit(""))
    return digits.try_cast("bigint")


def strip_non_numeric(c: Column | str) -> Column:
    """Keep only digits and dots, then parse (notebook price clean)."""
    return F.nullif(F.regexp_replace(_col(c).cast("string"), r"[^\d.]", ""), F.lit("")).try_cast("double")


def strip_percent(c: Column | str) -> Column:
    """Delete ``%`` then parse a double."""
    return parse_double(F.regexp_replace(_col(c).cast("string"), "%", ""))


def coerce_numeric(c: Column | str, fill: float | None = None) -> Column:
    """Non-numeric text → null (or ``fill`` when given)."""
    v = parse_double(_col(c).cast("string"))
    return F.coalesce(v, F.lit(fill)) if fill is not None else v


def text_length(c: Column | str) -> Column:
    """Code-point length; null → 0."""
    return F.coalesce(F.length(_col(c)), F.lit(0)).cast("bigint")


def count_segments(c: Column | str, sep: str = ",") -> Column:
    """Number of non-blank ``sep``-separated segments; null or empty → 0."""
    c = _col(c)
    parts = F.filter(F.split(c, sep, -1), lambda x: x.rlike(r"\S"))
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.size(parts)).cast("bigint")


def strip_ws(c: Column | str) -> Column:
    """Trim all leading/trailing whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")
