"""Sinks: versioned vector index (upsert), metrics tables, JSON request logs."""

from shelfspark.sinks.index import index_info, read_index, upsert_index
from shelfspark.sinks.logs import read_json_logs, write_json_logs

__all__ = ["index_info", "read_index", "upsert_index", "read_json_logs", "write_json_logs"]
