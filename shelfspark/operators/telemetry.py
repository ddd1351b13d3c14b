"""Request telemetry roll-ups over an event table: counters, histograms,
gauges, windowed rates, quantiles, heatmaps, error ratios and sustained-alert
islands.  The same functions run on batch DataFrames and on streaming ones
(see ``shelfspark.streaming``) wherever Structured Streaming allows it.

Event table shape (``events`` adapter): ``ts`` (timestamp), ``event_id``,
``user_id``, ``label`` (endpoint), ``latency`` (seconds), ``is_error``,
``grounded``, ``results`` and ``category``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.constants import LATENCY_BUCKETS


def request_events(events: DataFrame) -> DataFrame:
    """``events`` table → request events.

    label = event_type; latency = value ms → s; error = event_type 'error';
    results = props.k; grounded = results > 50; category = 'k<tens>'.
    ``ts`` is cast to TIMESTAMP (watermarks need it; the parquet type is NTZ).
    """
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id",
        F.col("event_type").alias("label"),
        (F.col("value") / F.lit(1000.0)).alias("latency"),
        (F.col("event_type") == "error").alias("is_error"),
        k.alias("results"),
        (k > 50).alias("grounded"),
        F.concat(F.lit("k"), (F.floor(k / 10) * 10).cast("string")).alias("category"),
    )


def metric_counter_totals(ev: DataFrame, labels: Sequence[str] = ("label",)) -> DataFrame:
    return ev.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"))


def metric_histograms(ev: DataFrame, value: str = "latency", buckets: Sequence[float] = LATENCY_BUCKETS,
                      labels: Sequence[str] = ("label",)) -> DataFrame:
    """Cumulative ``le`` buckets (+Inf), sum and count per label set, one pass."""
    v = F.col(value)
    aggs = [F.count_if(v <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(buckets)]
    agg = ev.groupBy(*labels).agg(*aggs, F.count(v).alias("_n"), F.sum(v).alias("_sum"))
    rows = F.array(*[F.struct(F.lit(str(float(b))).alias("le"), F.col(f"_b{i}").alias("bucket_count"))
                     for i, b in enumerate(buckets)], F.struct(F.lit("+Inf").alias("le"), F.col("_n").alias("bucket_count")))
    return agg.select(*labels, F.col("_n").alias("count"), F.col("_sum").alias("sum"), F.inline(rows))


def metric_gauge_latest(ev: DataFrame, value: str = "latency", labels: Sequence[str] = ("label",)) -> DataFrame:
    """Last value per label set (latest ``ts``, ties by ``event_id``)."""
    return ev.groupBy(*labels).agg(
        F.max_by(F.col(value), F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


def track_prediction_event(ev: DataFrame) -> DataFrame:
    """Counters always; value statistics only over successful events."""
    ok = ~F.col("is_error")
    return ev.groupBy("label").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("errors"),
        F.avg(F.when(ok, F.col("latency"))).alias("mean_latency_success"),
        F.sum(F.when(ok, F.col("results"))).cast("bigint").alias("results_success"))


def track_qa_event(ev: DataFrame) -> DataFrame:
    """Counters by grounded/status; result count on success; score only when > 0."""
    ok = ~F.col("is_error")
    return ev.groupBy("grounded", F.when(ok, "success").otherwise("error").alias("status")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(ok, F.col("results"))).cast("bigint").alias("results"),
        F.avg(F.when(F.col("latency") > 0, F.col("latency"))).alias("mean_positive_latency"))


def _win(size: str, slide: str | None = None) -> Column:
    return F.window("ts", size, slide) if slide else F.window("ts", size)


def rate_5m(ev: DataFrame, slide: str = "1 minute", labels: Sequence[str] = ("label",)) -> DataFrame:
    """Per-second rate over a sliding 5-minute window (count / 300)."""
    return (ev.groupBy(_win("5 minutes", slide).alias("w"), *labels)
              .agg((F.count(F.lit(1)) / F.lit(300.0)).alias("rate"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "rate"))


def latency_quantile(ev: DataFrame, q: float = 0.95, size: str = "5 minutes", exact: bool = True,
                     labels: Sequence[str] = ()) -> DataFrame:
    """Latency quantile per tumbling window: exact ``percentile`` (batch) or
    ``percentile_approx`` (bounded state, streaming)."""
    v = F.col("latency")
    agg = F.percentile(v, F.lit(q)) if exact else F.percentile_approx(v, F.lit(q), 10000)
    return (ev.groupBy(_win(size).alias("w"), *labels).agg(agg.alias("quantile"))
              .select(F.col("w.start").alias("window_start"), *labels, "quantile"))


def bucket_quantile(ev: DataFrame, q: float = 0.95, size: str = "5 minutes",
                    buckets: Sequence[float] = LATENCY_BUCKETS, labels: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative bucket counts, linear inside the bucket (the
    histogram-quantile rule): rank = q·count; first bucket whose cumulative
    count reaches the rank; interpolate from the previous bound (0 for the
    first); a rank in +Inf returns the last finite bound."""
    v = F.col("latency")
    cum = F.array(*[F.count_if(v <= F.lit(float(b))) for b in buckets], F.count(F.lit(1)))
    agg = ev.groupBy(_win(size).alias("w"), *labels).agg(cum.alias("cum"))
    bounds = F.array(*[F.lit(float(b)) for b in buckets])
    n = len(buckets)
    rank = F.lit(q) * F.element_at("cum", n + 1).cast("double")
    idx = F.array_position(F.transform("cum", lambda c: c.cast("double") >= rank), F.lit(True)).cast("int")
    prev_cum = F.when(idx > 1, F.element_at("cum", F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0)).cast("double")
    lower = F.when(idx > 1, F.element_at(bounds, F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0.0))
    upper = F.element_at(bounds, F.least(idx, F.lit(n)))
    in_bucket = F.element_at("cum", idx).cast("double") - prev_cum
    est = F.when(idx > n, F.element_at(bounds, n)).otherwise(
        lower + (upper - lower) * F.try_divide(rank - prev_cum, in_bucket))
    return agg.select(F.col("w.start").alias("window_start"), *labels, est.alias("quantile"))


def latency_heatmap(ev: DataFrame, size: str = "5 minutes", buckets: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Request count per (window, latency bucket); bucket = smallest ``le`` ≥ latency."""
    bounds = [float(b) for b in buckets]
    le = None
    for b in bounds:
        cond = F.col("latency") <= F.lit(b)
        le = F.when(cond, F.lit(str(b))) if le is None else le.when(cond, F.lit(str(b)))
    le = le.otherwise(F.lit("+Inf"))
    return (ev.groupBy(_win(size).alias("w"), le.alias("le")).agg(F.count(F.lit(1)).alias("count"))
              .select(F.col("w.start").alias("window_start"), "le", "count"))


def error_ratio(ev: DataFrame, size: str = "5 minutes") -> DataFrame:
    return (ev.groupBy(_win(size).alias("w"))
              .agg(F.try_divide(F.count_if("is_error").cast("double"), F.count(F.lit(1)).cast("double")).alias("ratio"))
              .select(F.col("w.start").alias("window_start"), "ratio"))


def rate_by_label(ev: DataFrame, label: str = "status", slide: str = "1 minute") -> DataFrame:
    """Rate per status (success/error) or grounded flag over sliding 5 minutes."""
    e = ev.withColumn("status", F.when(F.col("is_error"), "error").otherwise("success"))
    return rate_5m(e, slide, (label,))


def totals_by_category(ev: DataFrame) -> DataFrame:
    return ev.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def avg_results_per_query(ev: DataFrame, size: str = "5 minutes") -> DataFrame:
    return (ev.groupBy(_win(size).alias("w")).agg(F.avg("results").alias("avg_results"))
              .select(F.col("w.start").alias("window_start"), "avg_results"))


def grounded_share(ev: DataFrame, size: str = "5 minutes") -> DataFrame:
    return (ev.groupBy(_win(size).alias("w")).agg(F.avg(F.col("grounded").cast("int")).alias("grounded_share"))
              .select(F.col("w.start").alias("window_start"), "grounded_share"))


def alert_islands(steps: DataFrame, cond: Column, min_steps: int, name: str, step_seconds: int = 60) -> DataFrame:
    """Gap-and-island over evaluation steps (one row per step): runs of
    consecutive steps where ``cond`` holds for at least ``min_steps`` steps.

    The window runs over the per-step series (one row per minute per alert),
    whose size depends on the time range, not on the event volume.
    """
    t = steps.where(cond).select("step_start", (F.unix_timestamp("step_start") / step_seconds).cast("bigint").alias("k"))
    w = Window.partitionBy(F.lit(name)).orderBy("k")
    isl = t.withColumn("grp", F.col("k") - F.row_number().over(w))
    return (isl.groupBy("grp").agg(F.min("step_start").alias("start"), F.max("step_start").alias("last_step"),
                                   F.count(F.lit(1)).alias("steps"))
               .where(F.col("steps") >= min_steps)
               .select(F.lit(name).alias("alert"), "start",
                       (F.col("last_step") + F.expr(f"INTERVAL {step_seconds} SECONDS")).alias("end"), "steps"))


def alert_sustained(ev: DataFrame, error_threshold: float = 0.1, error_minutes: int = 5,
                    p95_threshold: float = 2.0, p95_minutes: int = 5) -> DataFrame:
    """Error ratio > threshold or p95 latency > threshold, sustained for N
    consecutive one-minute steps."""
    steps = (ev.groupBy(F.window("ts", "1 minute").alias("w"))
               .agg(F.try_divide(F.count_if("is_error").cast("double"), F.count(F.lit(1)).cast("double")).alias("err"),
                    F.percentile("latency", F.lit(0.95)).alias("p95"))
               .select(F.col("w.start").alias("step_start"), "err", "p95"))
    a = alert_islands(steps, F.col("err") > error_threshold, error_minutes, "HighErrorRate")
    b = alert_islands(steps, F.col("p95") > p95_threshold, p95_minutes, "SlowResponses")
    return a.unionByName(b)


def request_duration(ev: DataFrame, start_label: str = "view", end_label: str = "purchase",
                     max_gap: str = "30 minutes", bucket: str = "30 minutes") -> DataFrame:
    """Pair each start event with the first end event of the same user within
    ``max_gap``; duration in seconds.

    An interval join keyed by (user, time bucket): an end can only match a
    start of its own bucket or the previous one, so a busy user's events are
    spread over many keys and only pairs inside the time bound are formed.
    """
    s = ev.where(F.col("label") == start_label).select(
        F.col("event_id").alias("start_id"), F.col("user_id").alias("u"), F.col("ts").alias("start_ts"),
        F.window("ts", bucket).start.alias("b"))
    e = ev.where(F.col("label") == end_label).select(
        F.col("event_id").alias("end_id"), F.col("user_id").alias("u2"), F.col("ts").alias("end_ts"),
        F.explode(F.array(F.window("ts", bucket).start,
                          F.window("ts", bucket).start - F.expr(f"INTERVAL {bucket}"))).alias("b2"))
    pairs = s.join(e, (F.col("u") == F.col("u2")) & (F.col("b") == F.col("b2"))
                   & (F.col("end_ts") >= F.col("start_ts"))
                   & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {max_gap}")))
    first = pairs.groupBy("start_id", "u", "start_ts").agg(F.min_by("end_id", F.struct("end_ts", "end_id")).alias("end_id"),
                                                           F.min("end_ts").alias("end_ts"))
    return first.select("start_id", F.col("u").alias("user_id"), "start_ts", "end_id", "end_ts",
                        (F.unix_micros("end_ts") - F.unix_micros("start_ts")).cast("double").alias("_us")).select(
        "start_id", "user_id", "start_ts", "end_id", "end_ts", (F.col("_us") / F.lit(1e6)).alias("duration_s"))
