"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairlead.catalog.registry import CENTS, SETTLED_HALF
from fairlead.functions.scalar import round_doubles
from fairlead.operators.baseline import baseline_forecast
from fairlead.operators.drivers import monthly_drivers
from fairlead.sources.standin import future, history


def shown(df: DataFrame, decimals: int = 6, **special: int) -> DataFrame:
    return round_doubles(df, decimals, CENTS | special, half=SETTLED_HALF)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_drivers(history(spark, sf_dir))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_forecast(history(spark, sf_dir), future(spark, sf_dir))
