"""Streamed alerts equal the batch form, whatever the order of files, across batches, gaps and restarts."""

import datetime as dt
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from shelfspark.operators import telemetry as T
from shelfspark.streaming import alert_stream as A
from shelfspark.streaming import telemetry_stream as S

START = dt.datetime(2024, 1, 1)
#: minutes in which every request fails; minute 30 has no requests, so it ends a run
BAD = {*range(3, 9), *range(15, 18), *range(25, 30), *range(31, 37), 50}
SILENT = {30, 45}


def requests(label="view", bad=BAD):
    rows = []
    for minute in range(60):
        if minute not in SILENT:
            for i in range(6):
                kind = "error" if minute in bad else label
                rows.append((START + dt.timedelta(minutes=minute, seconds=9 * i), minute * 10 + i, i, kind, 100.0, '{"k": 60}'))
    return rows


def tick(hours):
    """One late request that moves the watermark past all others."""
    return [(START + dt.timedelta(hours=hours), 1, 1, "view", 100.0, "{}")]


def write(spark, folder, rows, number):
    os.makedirs(f"{folder}/events.parquet", exist_ok=True)
    df = pd.DataFrame(rows, columns=["ts", "event_id", "user_id", "event_type", "value", "props"])
    path = f"{folder}/events.parquet/part-{number:03d}.parquet"
    df.astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)
    os.utime(path, (1_700_000_000 + 10 * number,) * 2)  # files arrive in this order


def changes(spark, folder, delay, path=None, by=(), rules=None):
    own = A.stateful_session(spark)
    ev = T.request_events(S.table_stream(own, str(folder), "events", 1)).withWatermark("ts", delay)
    out = S.run_to_table(A.alert_changes(ev, rules, by), "alerts", "append", path, reader=spark)
    return {tuple(r) for r in out.select("alert", *by, "state", "start", "at", "steps").collect()}


def batch_runs(spark, folder):
    ev = T.request_events(spark.read.parquet(f"{folder}/events.parquet"))
    return {tuple(r) for r in T.alert_sustained(ev).select("alert", "start", "end", "steps").collect()}


def runs(found, state="resolved"):
    return {(a, start, at, n) for a, s, start, at, n in found if s == state}


def test_files_in_any_order_equal_batch(spark, tmp_path):
    rows = requests()
    random.Random(3).shuffle(rows)
    for i in range(4):
        write(spark, tmp_path, rows[i::4], i)
    write(spark, tmp_path, tick(6), 9)
    found = changes(spark, tmp_path, "2 hours")
    assert runs(found) == batch_runs(spark, tmp_path) and len(runs(found)) == 3
    minutes = {n for *_, n in runs(found, "cleared")}
    assert minutes == {1, 3} and len(runs(found, "pending")) == 5 and len(runs(found, "firing")) == 3
    assert all(at - start == dt.timedelta(minutes=5) for _, start, at, _ in runs(found, "firing"))


def test_runs_go_on_across_batches_and_restarts(spark, tmp_path):
    rows, path = requests(), f"{tmp_path}/out"
    parts = [[r for r in rows if lo <= (r[0] - START).seconds // 60 < lo + 7] for lo in range(0, 60, 7)]
    for i, part in enumerate(parts[:4]):
        write(spark, tmp_path, part, i)
    first = changes(spark, tmp_path, "1 minute", path)
    assert ("HighErrorRate", "firing") in {(r[0], r[1]) for r in first}
    for i, part in enumerate(parts[4:], start=4):
        write(spark, tmp_path, part, i)
    write(spark, tmp_path, tick(6), 20)
    found = changes(spark, tmp_path, "1 minute", path)
    assert first <= found and runs(found) == batch_runs(spark, tmp_path) and len(runs(found)) == 3


def test_a_silent_minute_ends_a_run_by_its_timer(spark, tmp_path):
    quiet = [r for r in requests() if (r[0] - START).seconds // 60 < 30]  # the last run ends with the requests
    write(spark, tmp_path, quiet, 0)
    write(spark, tmp_path, tick(6), 1)
    found = changes(spark, tmp_path, "1 minute")
    last = START + dt.timedelta(minutes=30)
    assert any(at == last and n == 5 for _, _, at, n in runs(found))


def test_series_and_own_rules(spark, tmp_path):
    rows = requests() + requests("buy", set())
    write(spark, tmp_path, rows, 0)
    write(spark, tmp_path, tick(6), 1)
    busy = A.Rule("Busy", F.col("n") >= 6, 2)
    found = changes(spark, tmp_path, "1 minute", by=("label",), rules=[busy])
    assert {r[1] for r in found} == {"view", "buy", "error"}
    buys = sorted((r[3], r[5]) for r in found if r[1] == "buy" and r[2] == "resolved")
    assert [n for _, n in buys] == [30, 14, 14]


def test_an_empty_table_changes_nothing(spark, tmp_path):
    write(spark, tmp_path, tick(0), 0)
    assert changes(spark, tmp_path, "1 minute") == set()
