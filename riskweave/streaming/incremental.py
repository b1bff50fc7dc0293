"""Aggregates that grow as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def payment_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def running_frequency(payments: DataFrame, key: str = "npi") -> DataFrame:
    """Payments of each id so far; null ids are dropped. For complete or update mode."""
    return payments.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("payment_frequency"))


def windowed_rates(events: DataFrame, at: str, category: str, flag: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and flagged counts by window and category; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), category).agg(F.count("*").alias("n"), F.sum(flag).alias("n_flagged"))
