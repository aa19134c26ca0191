"""Reliability analytics for platform telemetry, as Spark plans."""
