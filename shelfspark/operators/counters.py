"""Rates of monotone counters that restart, as dashboards compute them from samples.

A series' samples in a window are ordered by time; a fall of the value is a
restart, which adds the value before it.  The increase between the first and
last sample is carried on to the window's edges where these are near (within
1.1 of the mean distance of samples, else half of it), but not before the time
at which the counter would have been zero.

Samples meet per series and window, never per series, so a series with most of
the samples is as many groups as it has windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SECOND = 1_000_000.0


def counter_samples(ev: DataFrame, labels: Sequence[str] = ("label",), restart_minute: int = 30) -> DataFrame:
    """(labels, ts, value): requests counted at each event since the last daily restart, ``restart_minute`` after midnight."""
    day = F.floor((F.unix_micros("ts") / F.lit(_SECOND) - F.lit(60.0 * restart_minute)) / F.lit(86400.0))
    since = Window.partitionBy(*labels, "_day").orderBy("ts", "event_id")
    return (ev.where(F.col("ts").isNotNull()).withColumn("_day", day)
            .select(*labels, "ts", F.row_number().over(since).cast("double").alias("value")))


def counter_rate(samples: DataFrame, labels: Sequence[str] = ("label",), value: str = "value", ts: str = "ts",
                 size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, labels, increase, resets, rate) per series and window with samples at two times.

    ``increase`` lies between the first and last sample; ``rate`` is per second,
    carried on to the edges.  Samples without a time or value are left out.
    """
    known = samples.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    placed = known.select(w.alias("w"), *labels, F.unix_micros(ts).alias("us"), F.col(value).cast("double").alias("v"))
    before = F.lag("v").over(Window.partitionBy("w", *labels).orderBy("us", "v"))
    fell = placed.withColumn("lost", F.when(F.col("v") < before, before))
    at = F.struct("us", "v")
    sums = fell.groupBy("w", *labels).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"),
        F.coalesce(F.sum("lost"), F.lit(0.0)).alias("lost"), F.count("lost").alias("resets"))
    seconds = lambda c: c / F.lit(_SECOND)
    start, end = F.unix_micros("w.start"), F.unix_micros("w.end")
    steps = (sums.where(F.col("first.us") < F.col("last.us"))
             .withColumn("increase", F.col("last.v") - F.col("first.v") + F.col("lost"))
             .withColumn("sampled", seconds(F.col("last.us") - F.col("first.us")))
             .withColumn("mean", F.col("sampled") / (F.col("n") - 1)))
    near = F.col("mean") * F.lit(1.1)

    def edge(distance):
        return F.when(distance >= near, F.col("mean") / F.lit(2.0)).otherwise(distance)

    zero = F.when((F.col("increase") > 0) & (F.col("first.v") >= 0), F.col("sampled") * (F.col("first.v") / F.col("increase")))
    ahead = F.least(edge(seconds(F.col("first.us") - start)), zero)  # least() skips null
    covered = F.col("sampled") + ahead + edge(seconds(end - F.col("last.us")))
    rate = F.col("increase") * (covered / F.col("sampled")) / seconds(end - start)
    return steps.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels,
                        "increase", "resets", rate.alias("rate"))
