"""Right-closed binning as CASE chains (Bucketizer/width_bucket are left-closed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.constants import PRICE_TIER_EDGES, PRICE_TIER_LABELS


def right_closed_bin(c: Column, edges: Sequence[float], labels: Sequence[str]) -> tuple[Column, Column]:
    """Return ``(bin_no, label)`` for bins ``(e[i], e[i+1]]``; outside/null → null.

    ``bin_no`` is 0-based and keeps bin order, so an ordered output and empty
    bins survive.
    """
    no = label = None
    for i in range(len(labels)):
        cond = (c > F.lit(edges[i])) & (c <= F.lit(edges[i + 1]))
        no = F.when(cond, F.lit(i)) if no is None else no.when(cond, F.lit(i))
        label = F.when(cond, F.lit(labels[i])) if label is None else label.when(cond, F.lit(labels[i]))
    return no, label


def bins_frame(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """Small fixed table ``(bin_no, bin)`` of all bins, for keeping empty bins."""
    return spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "bin_no int, bin string")


def price_tier(c: Column | str) -> Column:
    """budget (0,500] · mid (500,2000] · premium (2000,10000] · luxury >10000; else unknown."""
    c = F.col(c) if isinstance(c, str) else c
    _, label = right_closed_bin(F.coalesce(c, F.lit(0.0)), PRICE_TIER_EDGES, PRICE_TIER_LABELS)
    return F.coalesce(label, F.lit("unknown"))
