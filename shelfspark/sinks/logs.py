"""Structured JSON request logs: write from an event table, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = ("event string, timestamp timestamp, level string, request_id string, method string, path string, "
              "status_code int, duration double")


def write_json_logs(ev: DataFrame, path: str) -> str:
    """One JSON line per request event (request_events shape)."""
    logs = ev.select(
        F.when(F.col("is_error"), "request_failed").otherwise("request_completed").alias("event"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("is_error"), "error").otherwise("info").alias("level"),
        F.col("event_id").cast("string").alias("request_id"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("/"), F.col("label")).alias("path"),
        F.when(F.col("is_error"), 500).otherwise(200).alias("status_code"),
        F.col("latency").alias("duration"))
    logs.write.mode("overwrite").json(path)
    return path


def read_json_logs(spark: SparkSession, path: str, level: str | None = None, event: str | None = None) -> DataFrame:
    df = spark.read.schema(LOG_SCHEMA).json(path)
    if level is not None:
        df = df.where(F.col("level") == level)
    if event is not None:
        df = df.where(F.col("event") == event)
    return df
