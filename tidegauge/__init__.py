"""Telemetry quality checks, drift, alerts and detection scoring as Spark DataFrame jobs."""

__version__ = "0.1.0"
