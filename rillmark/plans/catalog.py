"""The registry of named queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillmark.plans import basic, fields, timeseries

QUERIES: dict = basic.QUERIES | timeseries.QUERIES | fields.QUERIES
SQL: dict = basic.SQL | timeseries.SQL | fields.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by consensus of sensors."""
    return timeseries.event_detect(spark, sf_dir)
