"""Column-level functions: each returns a native ``Column`` expression.

Nothing here runs Python per row; every function composes built-in
``pyspark.sql.functions`` so it stays inside whole-stage codegen.
"""

from shelfspark.functions.cleaning import (
    clean_discount,
    clean_price,
    clean_rating,
    clean_rating_count,
    coerce_numeric,
    count_segments,
    strip_non_numeric,
    strip_percent,
    text_length,
)
from shelfspark.functions.bins import price_tier, right_closed_bin
from shelfspark.functions.numeric import round_half_up, safe_ratio

__all__ = [
    "clean_discount", "clean_price", "clean_rating", "clean_rating_count",
    "coerce_numeric", "count_segments", "strip_non_numeric", "strip_percent",
    "text_length", "price_tier", "right_closed_bin", "round_half_up", "safe_ratio",
]
