"""Numeric helpers with engine-independent results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A float parse guard: Spark's cast accepts suffixes such as '1d' that a
# strict decimal reader rejects, so only plain decimal/exponent text passes.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def round_half_up(c: Column | str, digits: int = 2) -> Column:
    """Round half away from zero-ish on the binary value: floor(x*10^d + 0.5 + 1e-7)/10^d.

    Plain ``round`` differs at ties between engines (decimal text vs binary
    value), so compared outputs use this form.  Null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return (F.floor(c * F.lit(scale) + F.lit(0.5) + F.lit(1e-7)).cast("double") / F.lit(scale))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` that yields null instead of failing on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def parse_double(c: Column) -> Column:
    """Strict text → double: null when the text is not a plain number."""
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def format_fixed(c: Column, digits: int, pattern: str = "%s") -> Column:
    """``pattern`` with ``%s`` replaced by ``c`` printed with ``digits`` decimals.

    Rounds the *exact binary value* to nearest, ties to even — what Python's
    and C's ``%.{d}f`` print.  ``format_string`` alone rounds the shortest
    decimal text half-up (7418.625 → .63, Python → .62).  The product
    x·10^d is made error-free with Dekker's split, so a product that rounds
    onto a .5 boundary is resolved by the sign of its rounding error.
    """
    s = F.lit(float(10 ** digits))
    x = c.cast("double")
    p = x * s
    hi = F.lit(134217729.0) * x
    xh = hi - (hi - x)
    xl = x - xh
    err = (xh * s - p) + xl * s
    fl = F.floor(p).cast("double")
    tie = (p - fl) == F.lit(0.5)
    r = F.when(tie & (err > 0), fl + F.lit(1.0)).when(tie & (err < 0), fl).otherwise(F.rint(p))
    return F.format_string(pattern.replace("%s", f"%.{digits}f"), r / s)
