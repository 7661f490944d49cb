"""Fluxmill: a Spark-first medallion engine for position-event streams."""
