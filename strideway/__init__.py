"""Spark-first analytics over long multi-recording time series."""

__version__ = "0.1.0"
