"""Connected components by smallest ids: label exchange with pointer jumping, one stored table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in ``edges`` (a long, b long); the label is its component's smallest id.

    Each round every id takes the smallest label among its neighbours and its
    own, then the label of that label.  Hubs with many neighbours cost a
    map-side aggregated minimum.  No edges give no rows.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    total = _sum(labels)
    while total is not None:
        near = (both.join(labels, both["a"] == labels["id"]).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near")))
        least = labels.join(near, "id").select("id", F.least("label", "near").alias("label"))
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = stored(least.join(further, "label").select("id", F.least("label", "further").alias("label")), "labels")
        now = _sum(labels)
        if now == total:
            break
        total = now
    return labels


def _sum(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
