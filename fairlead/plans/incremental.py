"""Monthly driver series kept up to date load by load.

Completed sailings arrive in loads. A load is appended in a folder of its own (``_load=<key>``, then the month folders
of ``store.write_clustered``), so that a refresh lists and reads only the loads it has not seen. The monthly table is
kept as additive parts per month and series: counts, whole-number sums and decimal sums of the money and rate columns.
Decimal sums are exact, so the parts, and the drivers derived from them, do not depend on how rows were split into
loads or partitions: three loads give bit for bit the table of one load with all rows.

A refresh reads the loads above the high-water mark, adds up their parts, adds the stored parts of the months they
touch, and replaces just those month folders by a dynamic partition overwrite; the new high-water mark is then appended
to a small manifest. A refresh that fails before that line is written is simply done again: it recomputes the same
months from the same loads.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.constants import DIMS, RATES
from fairlead.functions.scalar import floor_round, month_start, safe_div
from fairlead.session import drop_folder, fresh_path
from fairlead.sources.schemas import HISTORY

#: Exact sums: doubles are taken at twelve decimals, which every stored money and rate value holds.
EXACT = T.DecimalType(38, 12)
_COUNTS = {"n_sailings": lambda: F.lit(1), "total_passengers": lambda: F.col("passengers_booked"),
           "total_capacity": lambda: F.col("lower_berth_capacity")}
_EXACT = {"fare_days": lambda: F.col("gross_fare_per_diem") * F.col("passengers_booked"),
          "gross_ticket_revenue": lambda: F.col("gross_ticket_revenue"), "net_ticket_revenue": lambda: F.col("net_ticket_revenue"),
          **{f"sum_{r}": (lambda r=r: F.col(r)) for r in RATES}}
PARTS = [*_COUNTS, *_EXACT, *[f"n_{r}" for r in RATES]]
THROUGH = T.StructType([T.StructField("through", T.StringType()), T.StructField("refreshed_at", T.TimestampNTZType())])


def load_key(when: dt.datetime | None = None) -> str:
    """Sortable key of a load: UTC time to the microsecond."""
    return (when or dt.datetime.now(dt.timezone.utc)).strftime("%Y%m%d%H%M%S%f")


def append_load(sailings: DataFrame, path: str, key: str | None = None) -> str:
    """Append completed sailings as one load and return its key; the load's rows carry ``_loaded_at``."""
    key = key or load_key()
    stamp = dt.datetime.strptime(key, "%Y%m%d%H%M%S%f")
    (sailings.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY.fields])
     .withColumns({"_loaded_at": F.lit(stamp).cast("timestamp_ntz"), "_load": F.lit(key),
                   "departure_ym": F.date_format("departure_date", "yyyy-MM")})
     .repartitionByRange("departure_ym", "departure_date", *DIMS)
     .sortWithinPartitions("departure_ym", "departure_date", *DIMS)
     .write.mode("append").partitionBy("_load", "departure_ym").parquet(path))
    return key


def read_loads(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """Sailings of the loads whose key is above ``after``; other load folders are pruned from the plan."""
    schema = T.StructType([*HISTORY.fields, T.StructField("_loaded_at", T.TimestampNTZType()),
                           T.StructField("_load", T.StringType()), T.StructField("departure_ym", T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    return rows.where(F.col("_load") > after) if after else rows


def monthly_parts(sailings: DataFrame, dims: list[str] = DIMS) -> DataFrame:
    """Additive parts per month and series."""
    return sailings.groupBy(month_start("departure_date").alias("month"), *dims).agg(
        *[F.sum(v()).cast("bigint").alias(k) for k, v in _COUNTS.items()],
        *[F.sum(v().cast(EXACT)).alias(k) for k, v in _EXACT.items()],
        *[F.count(r).alias(f"n_{r}") for r in RATES])


def _through(spark: SparkSession, parts_path: str) -> str | None:
    try:
        return spark.read.schema(THROUGH).parquet(parts_path + "_through").agg(F.max("through")).first()[0]
    except Exception as error:  # no refresh yet
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
        return None


def refresh_monthly(spark: SparkSession, loads_path: str, parts_path: str, dims: list[str] = DIMS) -> str | None:
    """Fold the loads above the high-water mark into the stored parts; returns the new mark (None: nothing new).

    Runs jobs while called. Only the months that new rows touch are read from the parts and written again.
    """
    after = _through(spark, parts_path)
    new = read_loads(spark, loads_path, after)
    mark = new.agg(F.max("_load")).first()[0]
    if mark is None:
        return None
    delta = monthly_parts(new.where(F.col("_load") <= mark), dims)
    staged = fresh_path(spark, "monthly-parts")
    if after is None:
        merged = delta
    else:
        stored = spark.read.parquet(parts_path)
        touched = stored.join(delta.select("month").distinct(), "month", "left_semi")
        merged = touched.select(*delta.columns).unionByName(delta).groupBy("month", *dims).agg(
            *[F.sum(p).cast(delta.schema[p].dataType).alias(p) for p in PARTS])
    merged.write.parquet(staged)
    (spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(parts_path))
    drop_folder(spark, staged)
    spark.createDataFrame([(mark,)], "through string").withColumn(
        "refreshed_at", F.localtimestamp()).write.mode("append").parquet(parts_path + "_through")
    return mark


def monthly_from_parts(parts: DataFrame, dims: list[str] = DIMS) -> DataFrame:
    """The monthly driver table of ``operators.drivers.monthly_drivers`` from stored parts."""
    as_double = lambda c: F.col(c).cast("double")
    return parts.select(
        F.col("month").cast("date").alias("month"), *dims, "n_sailings", "total_passengers", "total_capacity",
        safe_div("total_passengers", "total_capacity").alias("load_factor"),
        floor_round(safe_div(as_double("fare_days"), "total_passengers"), 9).alias("gross_fare_per_diem"),
        as_double("gross_ticket_revenue").alias("gross_ticket_revenue"),
        as_double("net_ticket_revenue").alias("net_ticket_revenue"),
        *[safe_div(as_double(f"sum_{r}"), F.col(f"n_{r}")).alias(r) for r in RATES])


def read_monthly(spark: SparkSession, parts_path: str, dims: list[str] = DIMS) -> DataFrame:
    return monthly_from_parts(spark.read.parquet(parts_path), dims)
