"""Spark-first analytics on financial and event bar series."""

__version__ = "0.1.0"
