"""Readers for stored sailing tables in the clustered layout of ``store.write_clustered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.sources.schemas import HISTORY, SCHEDULE

_STORED = [T.StructField("_loaded_at", T.TimestampNTZType()), T.StructField("departure_ym", T.StringType())]


def _read(spark: SparkSession, path: str, schema: T.StructType, start, end, brands, trades) -> DataFrame:
    """Rows with ``start <= departure < end``. The range is also put to the month folders, so that others are not listed or
    read; date, brand and trade filters reach the row groups."""
    df = spark.read.schema(T.StructType([*schema.fields, *_STORED])).parquet(path)
    if start:
        df = df.where((F.col("departure_ym") >= start[:7]) & (F.col("departure_date") >= F.lit(start).cast("date")))
    if end:
        df = df.where((F.col("departure_ym") <= end[:7]) & (F.col("departure_date") < F.lit(end).cast("date")))
    if brands is not None:
        df = df.where(F.col("brand").isin(list(brands)))
    if trades is not None:
        df = df.where(F.col("trade").isin(list(trades)))
    return df.drop("departure_ym")


def read_history(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                 brands: list[str] | None = None, trades: list[str] | None = None) -> DataFrame:
    """Completed sailings of a date range, brands and trades, with the time they were loaded at."""
    return _read(spark, path, HISTORY, start, end, brands, trades)


def read_schedule(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                  brands: list[str] | None = None, trades: list[str] | None = None) -> DataFrame:
    """Scheduled sailings of a date range, brands and trades, with the time they were loaded at."""
    return _read(spark, path, SCHEDULE, start, end, brands, trades)
