"""Sailing tables derived from the order tables: one order is one sailing."""

from __future__ import annotations

from calendar import monthrange

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.scalar import floor_round_sql, season
from fairlead.operators.waterfall import waterfall
from fairlead.sources.schemas import SCHEDULE_COLUMNS

AS_OF = "2000-08-01"

# Only the columns used; a fixed schema spares the footer reads of schema inference.
TABLES = {
    "lineitem": "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _line_totals(lines: DataFrame) -> DataFrame:
    """Totals of the lines of an order, added up in whole cents and hundredths.

    Whole numbers give the same total in any order of summation and stay in generated code.
    """
    hundredths = lambda c: F.floor(F.col(c) * 100.0 + 0.5)
    return (
        lines.groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            (F.sum(hundredths("l_extendedprice")) / 100.0).alias("gross"),
            (F.sum(hundredths("l_extendedprice") * hundredths("l_discount")) / 10000.0).alias("disc"),
            (F.sum(hundredths("l_tax")) / 100.0).alias("tax_sum"),
        )
    )


def facts(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sailings with ``start <= departure < end``; the date range reaches the parquet scan."""
    orders = table(spark, sf_dir, "orders")
    if start:
        orders = orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        orders = orders.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    lines = table(spark, sf_dir, "lineitem")
    if start:
        # A range with a beginning wants few of the lines: those of other orders go before the shuffle where the wanted
        # keys are small enough to broadcast, and by a filter on them where they are not.
        lines = lines.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    places = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "r_name")
    )
    # The orders meet their lines first: both sides are partitioned by the order key there, and the
    # customer join, whose keys may be skewed, follows on rows that are already small.
    joined = (
        orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
        .join(_line_totals(lines), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
    )
    length = "(o_orderkey % 12 + 3)"
    return joined.selectExpr(
        "o_orderkey as sailing_id",
        "concat('Ship_', o_custkey % 200) as ship_name",
        "c_mktsegment as ship_class",
        "r_name as brand",
        "o_orderpriority as trade",
        f"cast({length} as int) as itinerary_length",
        "cast(o_orderdate as date) as departure_date",
        "cast(coalesce(n_lines, 1) * 50 as int) as lower_berth_capacity",
        "cast(qty as int) as passengers_booked",
        "gross as gross_ticket_revenue",
        f"{floor_round_sql(f'gross / (qty * {length})', 2)} as gross_fare_per_diem",
        f"{floor_round_sql('qty / (n_lines * 50)', 4)} as load_factor",
        f"{floor_round_sql('disc / gross', 4)} as discount_rate",
        f"{floor_round_sql('tax_sum / n_lines', 4)} as commission_rate",
        "cast(o_custkey % 51 + 30 as double) as promo_cost_per_pax",
        "cast(o_orderkey % 16 + 15 as double) / 100 as direct_booking_pct",
        "cast(o_custkey % 16 + 10 as double) / 100 as air_inclusive_pct",
        "cast((o_orderkey * 7) % 201 + 250 as double) as air_cost_per_pax",
        "cast((o_custkey * 3) % 121 + 80 as double) as taxes_fees_per_pax",
        # Inputs of the extended deductions.
        "if(o_orderkey % 3 = 0, cast(o_custkey % 21 + 10 as double) * 0.4D / 1000, 0D) as commission_override_pct",
        "if(o_orderkey % 3 = 1, cast(o_custkey % 76 as double), 0D) as kicker_per_cabin",
    )


def as_history(sailings: DataFrame) -> DataFrame:
    """Actuals with season and the waterfall of the booked passengers."""
    df = sailings.drop("commission_override_pct", "kicker_per_cabin").withColumns(_calendar())
    return waterfall(df, pax_mode="given", decimals=2)


def as_schedule(sailings: DataFrame) -> DataFrame:
    """The columns known before departure, with season."""
    return sailings.select(*SCHEDULE_COLUMNS).withColumns(_calendar())


def _calendar():
    return {"departure_month": F.month("departure_date").cast("bigint"), "season": season("departure_date")}


def _months_later(day: str, months: int) -> str:
    """The same day of a later month, or its last day where it has no such day."""
    y, m, d = (int(x) for x in day.split("-"))
    year, month = divmod(y * 12 + m - 1 + months, 12)
    return f"{year:04d}-{month + 1:02d}-{min(d, monthrange(year, month + 1)[1]):02d}"


def history(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """Completed sailings."""
    return as_history(facts(spark, sf_dir, end=as_of))


def future(spark: SparkSession, sf_dir: str, as_of: str = AS_OF, months: int = 12) -> DataFrame:
    """Scheduled sailings of the next months: capacity known, revenue not."""
    return as_schedule(facts(spark, sf_dir, start=as_of, end=_months_later(as_of, months)))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per nation, with none to all of the six overrides set."""
    k = F.col("n_nationkey")
    pick = lambda every, value: F.when(k % every == 0, value.cast("double"))
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("S"), k.cast("string")).alias("scenario_id"),
        F.col("n_name").alias("scenario_name"),
        F.date_add(F.lit(AS_OF).cast("date"), k.cast("int")).cast("timestamp_ntz").alias("created_at"),
        pick(2, k / 100.0 + 0.40).alias("load_factor_override"),
        pick(3, k * 5 + 200).alias("gross_per_diem_override"),
        pick(4, k / 500.0 + 0.03).alias("discount_rate_override"),
        pick(5, k / 500.0 + 0.02).alias("commission_rate_override"),
        pick(6, k / 200.0 + 0.10).alias("air_inclusive_pct_override"),
        pick(7, k + 30).alias("promo_cost_override"),
    )
