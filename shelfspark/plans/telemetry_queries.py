"""Registered telemetry roll-ups (batch and streaming) and sinks."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from shelfspark.constants import LATENCY_BUCKETS
from shelfspark.functions.numeric import round_half_up
from shelfspark.operators import counters
from shelfspark.operators import sketches as K
from shelfspark.operators import telemetry as T
from shelfspark.plans.registry import query
from shelfspark.plans.sql import R2
from shelfspark.plans.sql import with_enriched as _catalog_sql
from shelfspark.session import materialized, shared_dir
from shelfspark.sinks.index import index_info, read_index, upsert_index
from shelfspark.sinks.logs import read_json_logs, write_json_logs
from shelfspark.sinks.metrics import counter_samples, gauge_samples, histogram_samples, read_metrics, write_metrics
from shelfspark.sources.tables import read_table
from shelfspark.streaming import telemetry_stream as S
from shelfspark.streaming.alert_stream import alert_changes, stateful_session

EV = """ev AS (SELECT ts, event_id, user_id, event_type AS label, value / 1000e0 AS latency,
         event_type = 'error' AS is_error, cast(json_extract_string(props, '$.k') AS integer) AS results,
         cast(json_extract_string(props, '$.k') AS integer) > 50 AS grounded,
         'k' || cast(cast(floor(cast(json_extract_string(props, '$.k') AS integer) / 10) * 10 AS bigint) AS varchar)
           AS category FROM events)"""


def W(sec: int, shift: str = "0") -> str:  # noqa: N802
    """Window start (naive timestamp) of ``ts`` for a tumbling window of ``sec`` seconds."""
    return f"make_timestamp(cast((floor(epoch_us(ts) / {sec}e6) - ({shift})) * {sec}e6 AS bigint))"


def ev(spark, sf_dir):
    return T.request_events(read_table(spark, sf_dir, "events"))


def ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("metric_counter_totals", oracle=f"WITH {EV} SELECT label, count(*) AS count FROM ev GROUP BY label")
def q_metric_counter_totals(spark, sf_dir):
    return T.metric_counter_totals(ev(spark, sf_dir))


def _hist_sql() -> str:
    parts = [f"SELECT label, '{float(b)}' AS le, count(*) FILTER (WHERE latency <= {float(b)}e0) AS bucket_count, "
             f"count(latency) AS count, {R2('sum(latency)', 9)} AS sum FROM ev GROUP BY label" for b in LATENCY_BUCKETS]
    parts.append(f"SELECT label, '+Inf', count(latency), count(latency), {R2('sum(latency)', 9)} FROM ev GROUP BY label")
    return f"WITH {EV} " + " UNION ALL ".join(parts)


@query("metric_histograms", oracle=_hist_sql())
def q_metric_histograms(spark, sf_dir):
    h = T.metric_histograms(ev(spark, sf_dir))
    return h.select("label", "le", "bucket_count", "count", round_half_up("sum", 9).alias("sum"))


@query("metric_gauge_latest", oracle=f"""WITH {EV} SELECT label, {R2('arg_max(latency, (ts, event_id))', 9)} AS value,
    max(ts) AS ts FROM ev GROUP BY label""")
def q_metric_gauge_latest(spark, sf_dir):
    g = T.metric_gauge_latest(ev(spark, sf_dir))
    return g.select("label", round_half_up("value", 9).alias("value"), ntz("ts"))


@query("track_prediction_event", oracle=f"""WITH {EV} SELECT label, count(*) AS requests,
    count(*) FILTER (WHERE NOT is_error) AS success, count(*) FILTER (WHERE is_error) AS errors,
    {R2('avg(CASE WHEN NOT is_error THEN latency END)', 9)} AS mean_latency_success,
    cast(sum(CASE WHEN NOT is_error THEN results END) AS bigint) AS results_success FROM ev GROUP BY label""")
def q_track_prediction_event(spark, sf_dir):
    t = T.track_prediction_event(ev(spark, sf_dir))
    return t.withColumn("mean_latency_success", round_half_up("mean_latency_success", 9))


@query("track_qa_event", oracle=f"""WITH {EV} SELECT grounded, CASE WHEN is_error THEN 'error' ELSE 'success' END AS status,
    count(*) AS requests, cast(sum(CASE WHEN NOT is_error THEN results END) AS bigint) AS results,
    {R2('avg(CASE WHEN latency > 0 THEN latency END)', 9)} AS mean_positive_latency FROM ev GROUP BY 1, 2""")
def q_track_qa_event(spark, sf_dir):
    t = T.track_qa_event(ev(spark, sf_dir))
    return t.withColumn("mean_positive_latency", round_half_up("mean_positive_latency", 9))


def _rate_sql(label: str = "label", label_expr: str = "label") -> str:
    return f"""WITH {EV}, sl AS (SELECT {label_expr} AS {label}, unnest(range(0, 5)) AS k, ts FROM ev)
SELECT {W(60, 'k')} AS window_start, {W(60, 'k')} + INTERVAL 5 MINUTE AS window_end, {label},
       {R2('count(*) / 300e0', 9)} AS rate FROM sl GROUP BY 1, 2, 3"""


def _rate_out(df, label="label"):
    return df.select(ntz("window_start"), ntz("window_end"), label, round_half_up("rate", 9).alias("rate"))


@query("rate_5m", oracle=_rate_sql())
def q_rate_5m(spark, sf_dir):
    return _rate_out(T.rate_5m(ev(spark, sf_dir)))


@query("counter_rate", oracle=f"""WITH {EV}, samples AS (
  SELECT label, epoch_us(ts) AS us, cast(row_number() OVER (PARTITION BY label, day ORDER BY ts, event_id) AS double) AS v
  FROM (SELECT *, floor((epoch_us(ts) / 1e6 - 1800e0) / 86400e0) AS day FROM ev)),
fell AS (SELECT *, lag(v) OVER (PARTITION BY label, hour ORDER BY us, v) AS prev
         FROM (SELECT *, cast(floor(us / 3600e6) AS bigint) AS hour FROM samples)),
sums AS (
  SELECT label, hour, count(*) AS n, min(us) AS t0, max(us) AS t1, arg_min(v, (us, v)) AS v0, arg_max(v, (us, v)) AS v1,
         coalesce(sum(prev) FILTER (WHERE v < prev), 0e0) AS lost, count(*) FILTER (WHERE v < prev) AS resets
  FROM fell GROUP BY label, hour),
steps AS (
  SELECT *, v1 - v0 + lost AS increase, (t1 - t0) / 1e6 AS sampled, (t1 - t0) / 1e6 / (n - 1) AS mean,
         (t0 - hour * 3600000000) / 1e6 AS head, ((hour + 1) * 3600000000 - t1) / 1e6 AS tail
  FROM sums WHERE t0 < t1),
edges AS (
  SELECT *, CASE WHEN head >= mean * 1.1e0 THEN mean / 2e0 ELSE head END AS head1,
         CASE WHEN tail >= mean * 1.1e0 THEN mean / 2e0 ELSE tail END AS tail1,
         CASE WHEN increase > 0 AND v0 >= 0 THEN sampled * (v0 / increase) END AS zero FROM steps)
SELECT make_timestamp(hour * 3600000000) AS window_start, make_timestamp((hour + 1) * 3600000000) AS window_end, label,
       increase, resets, {R2('increase * ((sampled + least(head1, coalesce(zero, head1)) + tail1) / sampled) / 3600e0', 9)} AS rate
FROM edges""")
def q_counter_rate(spark, sf_dir):
    """Hourly request rate from counters that restart every day at half past midnight."""
    rates = counters.counter_rate(counters.counter_samples(ev(spark, sf_dir)), size="1 hour")
    return rates.select(ntz("window_start"), ntz("window_end"), "label", "increase", "resets",
                        round_half_up("rate", 9).alias("rate"))


@query("rate_by_label", oracle=_rate_sql("status", "CASE WHEN is_error THEN 'error' ELSE 'success' END"))
def q_rate_by_label(spark, sf_dir):
    return _rate_out(T.rate_by_label(ev(spark, sf_dir)), "status")


@query("latency_quantile", oracle=f"""WITH {EV} SELECT {W(300)} AS window_start,
    {R2('quantile_cont(latency, 0.95)', 9)} AS quantile FROM ev GROUP BY 1""")
def q_latency_quantile(spark, sf_dir):
    q = T.latency_quantile(ev(spark, sf_dir))
    return q.select(ntz("window_start"), round_half_up("quantile", 9).alias("quantile"))


def _bucket_quantile_sql(q: float = 0.95) -> str:
    n = len(LATENCY_BUCKETS)
    cum = ", ".join([f"count(*) FILTER (WHERE latency <= {float(b)}e0)" for b in LATENCY_BUCKETS] + ["count(*)"])
    bounds = "[" + ", ".join(f"{float(b)}e0" for b in LATENCY_BUCKETS) + "]"
    return f"""WITH {EV}, a AS (SELECT {W(300)} AS window_start, [{cum}] AS cum FROM ev GROUP BY 1),
r AS (SELECT window_start, cum, {q}e0 * cum[{n + 1}] AS rank FROM a),
i AS (SELECT *, list_position(list_transform(cum, lambda c: cast(c AS double) >= rank), true) AS idx FROM r),
e AS (SELECT window_start, CASE WHEN idx > {n} THEN {bounds}[{n}]
    ELSE (CASE WHEN idx > 1 THEN {bounds}[idx - 1] ELSE 0e0 END)
       + ({bounds}[idx] - CASE WHEN idx > 1 THEN {bounds}[idx - 1] ELSE 0e0 END)
       * (rank - CASE WHEN idx > 1 THEN cast(cum[idx - 1] AS double) ELSE 0e0 END)
       / nullif(cast(cum[idx] AS double) - CASE WHEN idx > 1 THEN cast(cum[idx - 1] AS double) ELSE 0e0 END, 0e0)
    END AS quantile FROM i)
SELECT window_start, {R2('quantile', 9)} AS quantile FROM e"""


@query("bucket_quantile", oracle=_bucket_quantile_sql())
def q_bucket_quantile(spark, sf_dir):
    q = T.bucket_quantile(ev(spark, sf_dir))
    return q.select(ntz("window_start"), round_half_up("quantile", 9).alias("quantile"))


def _heat_sql() -> str:
    cases = " ".join(f"WHEN latency <= {float(b)}e0 THEN '{float(b)}'" for b in LATENCY_BUCKETS)
    return f"""WITH {EV} SELECT {W(300)} AS window_start, CASE {cases} ELSE '+Inf' END AS le, count(*) AS count
FROM ev GROUP BY 1, 2"""


@query("latency_heatmap", oracle=_heat_sql())
def q_latency_heatmap(spark, sf_dir):
    h = T.latency_heatmap(ev(spark, sf_dir))
    return h.select(ntz("window_start"), "le", "count")


@query("error_ratio", oracle=f"""WITH {EV} SELECT {W(300)} AS window_start,
    {R2('count(*) FILTER (WHERE is_error) / count(*)', 9)} AS ratio FROM ev GROUP BY 1""")
def q_error_ratio(spark, sf_dir):
    return T.error_ratio(ev(spark, sf_dir)).select(ntz("window_start"), round_half_up("ratio", 9).alias("ratio"))


@query("totals_by_category", oracle=f"WITH {EV} SELECT category, count(*) AS count FROM ev GROUP BY category")
def q_totals_by_category(spark, sf_dir):
    return T.totals_by_category(ev(spark, sf_dir))


@query("avg_results_per_query", oracle=f"""WITH {EV} SELECT {W(300)} AS window_start,
    {R2('avg(results)', 9)} AS avg_results FROM ev GROUP BY 1""")
def q_avg_results_per_query(spark, sf_dir):
    a = T.avg_results_per_query(ev(spark, sf_dir))
    return a.select(ntz("window_start"), round_half_up("avg_results", 9).alias("avg_results"))


@query("grounded_share", oracle=f"""WITH {EV} SELECT {W(300)} AS window_start,
    {R2('avg(cast(grounded AS integer))', 9)} AS grounded_share FROM ev GROUP BY 1""")
def q_grounded_share(spark, sf_dir):
    g = T.grounded_share(ev(spark, sf_dir))
    return g.select(ntz("window_start"), round_half_up("grounded_share", 9).alias("grounded_share"))


def _alert_sql() -> str:
    return f"""WITH {EV}, st AS (SELECT {W(60)} AS step_start,
    count(*) FILTER (WHERE is_error) / count(*) AS err, quantile_cont(latency, 0.95) AS p95 FROM ev GROUP BY 1),
t AS (SELECT 'HighErrorRate' AS alert, step_start FROM st WHERE err > 0.1e0
      UNION ALL SELECT 'SlowResponses', step_start FROM st WHERE p95 > 2e0),
k AS (SELECT alert, step_start, cast(epoch(step_start) / 60 AS bigint)
         - row_number() OVER (PARTITION BY alert ORDER BY step_start) AS grp FROM t)
SELECT alert, min(step_start) AS start, max(step_start) + INTERVAL 60 SECOND AS "end", count(*) AS steps
FROM k GROUP BY alert, grp HAVING count(*) >= 5"""


@query("alert_sustained", oracle=_alert_sql())
def q_alert_sustained(spark, sf_dir):
    a = T.alert_sustained(ev(spark, sf_dir))
    return a.select("alert", ntz("start"), ntz("end"), "steps")


@query("request_pair_join", oracle=f"""WITH {EV},
s AS (SELECT event_id, user_id, ts FROM ev WHERE label = 'view'),
e AS (SELECT event_id, user_id, ts FROM ev WHERE label = 'purchase')
SELECT s.event_id AS start_id, s.user_id, s.ts AS start_ts, arg_min(e.event_id, e.ts) AS end_id, min(e.ts) AS end_ts,
       {R2('(epoch_us(min(e.ts)) - epoch_us(s.ts)) / 1e6', 6)} AS duration_s
FROM s JOIN e ON s.user_id = e.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 30 MINUTE
GROUP BY s.event_id, s.user_id, s.ts""")
def q_request_pair_join(spark, sf_dir):
    d = T.request_duration(ev(spark, sf_dir))
    return d.select("start_id", "user_id", ntz("start_ts"), "end_id", ntz("end_ts"),
                    round_half_up("duration_s", 6).alias("duration_s"))


@query("request_duration", oracle=f"""WITH {EV},
s AS (SELECT event_id, user_id, ts FROM ev WHERE label = 'view'),
e AS (SELECT event_id, user_id, ts FROM ev WHERE label = 'purchase'),
p AS (SELECT s.event_id, min(e.ts) AS end_ts, s.ts FROM s JOIN e ON s.user_id = e.user_id AND e.ts >= s.ts
      AND e.ts <= s.ts + INTERVAL 30 MINUTE GROUP BY s.event_id, s.ts)
SELECT count(*) AS n, {R2('avg((epoch_us(end_ts) - epoch_us(ts)) / 1e6)', 6)} AS mean_duration_s FROM p""")
def q_request_duration(spark, sf_dir):
    d = T.request_duration(ev(spark, sf_dir))
    return d.agg(F.count(F.lit(1)).alias("n"), round_half_up(F.avg("duration_s"), 6).alias("mean_duration_s"))


# ---------------------------------------------------------------- streaming


@query("stream_rate_5m", oracle=_rate_sql())
def q_stream_rate_5m(spark, sf_dir):
    """The 5-minute rate through a file-source stream (watermark 10 min)."""
    return _rate_out(S.stream_rollup(spark, sf_dir, T.rate_5m, "rate_5m"))


@query("stream_error_ratio", oracle=f"""WITH {EV} SELECT {W(300)} AS window_start,
    {R2('count(*) FILTER (WHERE is_error) / count(*)', 9)} AS ratio FROM ev GROUP BY 1""")
def q_stream_error_ratio(spark, sf_dir):
    out = S.stream_rollup(spark, sf_dir, T.error_ratio, "error_ratio")
    return out.select(ntz("window_start"), round_half_up("ratio", 9).alias("ratio"))


@query("stream_request_pairs", oracle=f"""WITH {EV},
s AS (SELECT event_id, user_id, ts FROM ev WHERE label = 'view'),
e AS (SELECT event_id, user_id, ts FROM ev WHERE label = 'purchase')
SELECT s.event_id AS start_id, e.event_id AS end_id FROM s JOIN e ON s.user_id = e.user_id AND e.ts >= s.ts
   AND e.ts <= s.ts + INTERVAL 30 MINUTE""")
def q_stream_request_pairs(spark, sf_dir):
    return S.request_pairs_stream(spark, sf_dir).select("start_id", "end_id")


def _alert_changes_sql() -> str:
    return f"""WITH {EV}, wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS w FROM ev),
st AS (SELECT {W(60)} AS step_start, count(*) FILTER (WHERE is_error) / count(*) AS err,
    quantile_cont(latency, 0.95) AS p95 FROM ev GROUP BY 1),
t AS (SELECT 'HighErrorRate' AS alert, step_start FROM st, wm WHERE err > 0.1e0 AND step_start + INTERVAL 60 SECOND <= w
      UNION ALL SELECT 'SlowResponses', step_start FROM st, wm WHERE p95 > 2e0 AND step_start + INTERVAL 60 SECOND <= w),
k AS (SELECT alert, step_start, cast(epoch(step_start) / 60 AS bigint)
         - row_number() OVER (PARTITION BY alert ORDER BY step_start) AS grp FROM t),
i AS (SELECT alert, min(step_start) AS start, max(step_start) AS last, count(*) AS n FROM k GROUP BY alert, grp)
SELECT alert, 'pending' AS state, start, start + INTERVAL 60 SECOND AS "at", 1 AS steps FROM i
UNION ALL SELECT alert, 'firing', start, start + INTERVAL 300 SECOND, 5 FROM i WHERE n >= 5
UNION ALL SELECT alert, CASE WHEN n >= 5 THEN 'resolved' ELSE 'cleared' END, start, last + INTERVAL 60 SECOND, n
FROM i, wm WHERE last + INTERVAL 120 SECOND <= w"""


@query("stream_alerts", oracle=_alert_changes_sql())
def q_stream_alerts(spark, sf_dir):
    """Every change of an alert's state, from the event stream, as far as the watermark has come."""
    own = stateful_session(spark)
    changes = alert_changes(S.request_event_stream(own, sf_dir))
    found = S.run_to_table(changes, "alerts", "append", shared_dir(spark, "streams", "alerts", unique=True), reader=spark)
    return found.select("alert", "state", ntz("start"), ntz("at"), "steps")


# ---------------------------------------------------------------- sources & sinks


@query("src_json_logs", oracle=f"""WITH {EV} SELECT '/' || label AS path, count(*) AS n,
    {R2('sum(latency)', 9)} AS total_duration FROM ev WHERE is_error GROUP BY 1""")
def q_src_json_logs(spark, sf_dir):
    path = shared_dir(spark, "json_logs", hashlib.sha1(sf_dir.encode()).hexdigest()[:12])
    write_json_logs(ev(spark, sf_dir), path)
    logs = read_json_logs(spark, path, level="error")
    return logs.groupBy("path").agg(F.count(F.lit(1)).alias("n"), round_half_up(F.sum("duration"), 9).alias("total_duration"))


def _metrics_sql() -> str:
    hist = " UNION ALL ".join(
        f"SELECT 'histogram' AS kind, 'request_seconds_bucket' AS name, label, '{le}' AS le, cast(count(*) FILTER (WHERE {cond}) AS double) AS value FROM ev GROUP BY label"
        for le, cond in [*[(float(b), f"latency <= {float(b)}e0") for b in LATENCY_BUCKETS], ("+Inf", "latency IS NOT NULL")])
    return f"""WITH {EV} SELECT 'counter' AS kind, 'requests_total' AS name, label, NULL AS le, cast(count(*) AS double) AS value FROM ev GROUP BY label
UNION ALL {hist}
UNION ALL SELECT 'histogram', 'request_seconds_sum', label, NULL, {R2('sum(latency)', 6)} FROM ev GROUP BY label
UNION ALL SELECT 'histogram', 'request_seconds_count', label, NULL, cast(count(latency) AS double) FROM ev GROUP BY label
UNION ALL SELECT 'gauge', 'last_request_seconds', label, NULL, {R2('arg_max(latency, (ts, event_id))', 6)} FROM ev GROUP BY label"""


@query("sink_metrics", oracle=_metrics_sql())
def q_sink_metrics(spark, sf_dir):
    """Counters, histograms and gauges of two batches of requests, one of them sent twice, merged when read."""
    path = shared_dir(spark, "metrics", unique=True)
    early = F.hour("ts") < 12
    for batch, rows in (("early", early), ("late", ~early), ("early", early)):
        part = ev(spark, sf_dir).where(rows)
        write_metrics([
            counter_samples(T.metric_counter_totals(part), "requests_total", ["label"]),
            histogram_samples(T.metric_histograms(part), "request_seconds", ["label"]),
            gauge_samples(T.metric_gauge_latest(part), "last_request_seconds", ["label"])], path, batch)
    got = read_metrics(spark, path)
    return got.select("kind", "name", F.get_json_object("labels", "$.label").alias("label"), "le", round_half_up("value", 6).alias("value"))


_LEVELS = [0.5, 0.95, 0.99]


@query("latency_sketches", oracle=f"""WITH {EV}, q AS (SELECT unnest([0.5e0, 0.95e0, 0.99e0]) AS level)
SELECT label, level, count(latency) AS n, true AS within FROM ev, q GROUP BY label, level""")
def q_latency_sketches(spark, sf_dir):
    """Quantiles of each label from the streamed sketches of its 5-minute windows: how many values, and whether the
    share of values up to each quantile is within the sketches' rank error of its level."""
    windows = S.stream_rollup(spark, sf_dir, K.latency_sketches, "latency_sketches")
    found = K.sketch_quantiles(windows, ["label"], _LEVELS)
    flat = found.select("label", "n", F.posexplode("quantiles").alias("i", "value")).withColumn(
        "level", F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), F.col("i") + 1))
    ranks = ev(spark, sf_dir).select("label", "latency").join(F.broadcast(flat), "label")  # labels x levels rows
    held = ranks.groupBy("label", "level", "n").agg(
        F.count_if(F.col("latency") <= F.col("value")).alias("upto"), F.count_if(F.col("latency") < F.col("value")).alias("below"))
    rank, off = F.col("level") * F.col("n"), K.rank_error() * F.col("n") + 1
    return held.select("label", "level", "n", ((F.col("below") <= rank + off) & (F.col("upto") >= rank - off)).alias("within"))


@query("distinct_sketches", oracle=_catalog_sql("""SELECT 'product_id' AS "column", count(DISTINCT product_id) AS exact, true AS within FROM catalog
UNION ALL SELECT 'review_id', count(DISTINCT review_id), true FROM catalog
UNION ALL SELECT 'category', count(DISTINCT category), true FROM catalog"""))
def q_distinct_sketches(spark, sf_dir):
    """Distinct counts from sketches stored per load (one load sent twice), and whether each is within five
    standard errors of the exact count."""
    from shelfspark.sources.catalog import catalog_view
    columns, path = ["product_id", "review_id", "category"], shared_dir(spark, "distinct_sketches", unique=True)
    rows = catalog_view(spark, sf_dir)
    first = F.coalesce(F.col("line_number") <= 2, F.lit(True))
    for load, part in (("a", first), ("b", ~first), ("a", first)):
        K.write_distinct_sketches(rows.where(part), columns, path, load)
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in columns]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns])))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.lit(5 * K.distinct_error()) * F.col("exact") + 1
    return exact.join(K.read_distinct_sketches(spark, path), "column").select("column", "exact", near.alias("within"))


def _index_points(spark, sf_dir):
    """Every product document with its payload and its vector."""
    from shelfspark.plans.text_queries import product_index
    return product_index(spark, sf_dir).select("id", "point_id", "text", "main_category", "actual_price", "rating", "vector")


def _index_sql(body: str) -> str:
    from shelfspark.plans.sql import with_ctes
    from shelfspark.plans.text_queries import _PRODUCTS_CTE
    return with_ctes(_PRODUCTS_CTE, body)


@query("sink_vector_index", oracle=_index_sql(f"""SELECT main_category, count(*) AS points,
    {R2('sum(coalesce(rating, 0e0) + CASE WHEN part_key % 2 = 0 THEN 1e0 ELSE 0e0 END)', 6)} AS rating_sum,
    count(*) AS unit_vectors FROM lastrow GROUP BY main_category"""))
def q_sink_vector_index(spark, sf_dir):
    """A first load, then an upsert that sends products twice, the later row changed: the last write stays, with its vector."""
    root = shared_dir(spark, "vector_index", "points", unique=True)
    points = materialized(_index_points(spark, sf_dir), "index_points")  # read by both loads: texts are embedded once
    pts = points.withColumn("rating", F.coalesce("rating", F.lit(0.0)))
    upsert_index(spark, root, pts.withColumn("write", F.lit(0)), "write", recreate=True)
    even = pts.where(F.col("id").cast("bigint") % 2 == 0)
    stale = even.withColumns({"rating": F.lit(-9.0), "write": F.lit(1)})
    upsert_index(spark, root, stale.unionByName(even.withColumns({"rating": F.col("rating") + 1, "write": F.lit(2)})), "write")
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    return read_index(spark, root).groupBy("main_category").agg(
        F.count(F.lit(1)).alias("points"), round_half_up(F.sum("rating"), 6).alias("rating_sum"),
        F.count_if(F.abs(squares - 1) < 1e-9).alias("unit_vectors"))


@query("src_vector_index_info", oracle=_index_sql(
    "SELECT count(*) AS points, count(DISTINCT main_category) AS categories FROM lastrow"))
def q_src_vector_index_info(spark, sf_dir):
    root = shared_dir(spark, "vector_index", "info", unique=True)
    upsert_index(spark, root, _index_points(spark, sf_dir).withColumn("write", F.lit(0)), "write", recreate=True)
    return index_info(spark, root)
