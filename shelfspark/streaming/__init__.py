"""Structured Streaming forms of the telemetry roll-ups."""
