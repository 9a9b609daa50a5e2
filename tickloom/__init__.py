"""Intraday time-series analytics expressed as Spark jobs."""
