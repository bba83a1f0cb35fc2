"""Driver series, distributions and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.constants import DIMS, DRIVER_SPEC, OVERRIDABLE, PERCENTILES, RATES
from fairlead.functions.scalar import floor_round, month_start, safe_div
from fairlead.operators.quantiles import moments_of_counts, quantiles_of_counts, settled_counts, value_counts


def monthly_drivers(history: DataFrame, dims: list[str] = DIMS) -> DataFrame:
    """Monthly series: load factor is a ratio of sums, per diem is weighted by passengers, rates are means.

    The per diem is settled at nine decimals, which drops the order of summation from its last bits.
    """
    sums = history.groupBy(month_start("departure_date").alias("month"), *dims).agg(
        F.count(F.lit(1)).alias("n_sailings"),
        F.sum("passengers_booked").alias("total_passengers"),
        F.sum("lower_berth_capacity").alias("total_capacity"),
        F.sum(F.col("gross_fare_per_diem") * F.col("passengers_booked")).alias("fare_days"),
        F.sum("gross_ticket_revenue").alias("gross_ticket_revenue"),
        F.sum("net_ticket_revenue").alias("net_ticket_revenue"),
        *[F.avg(rate).alias(rate) for rate in RATES],
    )
    return sums.select(
        "month", *dims, "n_sailings", "total_passengers", "total_capacity",
        safe_div("total_passengers", "total_capacity").alias("load_factor"),
        floor_round(safe_div("fare_days", "total_passengers"), 9).alias("gross_fare_per_diem"),
        "gross_ticket_revenue", "net_ticket_revenue", *RATES,
    )


# column -> (prefix, percentiles, with deviation)
DISTRIBUTIONS = {
    "load_factor": ("lf", [10, 25, 50, 75, 90], True),
    "gross_fare_per_diem": ("pd", [10, 50, 90], True),
    "discount_rate": ("disc", [10, 50, 90], False),
    "commission_rate": ("comm", [10, 50, 90], False),
}


def driver_distributions(monthly: DataFrame, dims: list[str] = DIMS, spec: dict = DISTRIBUTIONS) -> DataFrame:
    """Percentiles of the monthly values. A group has one row per month, so it stays small."""
    aggs = []
    for column, (prefix, points, with_std) in spec.items():
        aggs.append(F.percentile(column, F.array(*[F.lit(p / 100.0) for p in points])).alias(f"_{prefix}"))
        if with_std:
            aggs.append(F.stddev_samp(column).alias(f"{prefix}_std"))
    out = []
    for prefix, points, with_std in spec.values():
        out += [F.col(f"_{prefix}")[i].alias(f"{prefix}_p{p}") for i, p in enumerate(points)]
        out += [F.col(f"{prefix}_std")] if with_std else []
    return monthly.groupBy(*dims).agg(*aggs).select(*dims, *out)


def driver_medians(monthly: DataFrame, dims: list[str] = DIMS) -> DataFrame:
    """Median rates over the months of each series.

    The monthly means carry the order of summation in their last bits; nine decimals drop it, so that
    amounts rounded to whole units later do not depend on how the history was partitioned.
    """
    return monthly.groupBy(*dims).agg(*[floor_round(F.median(rate), 9).alias(f"{rate}_base") for rate in RATES])


def driver_stats(history: DataFrame, drivers: list[str] = OVERRIDABLE) -> DataFrame:
    """Mean, sample deviation and exact percentiles of each driver over all sailings, one row per driver."""
    counts = settled_counts(value_counts(history, [], drivers))
    points = quantiles_of_counts(counts, [], PERCENTILES, drivers)
    labels = {d[0]: d[1] for d in DRIVER_SPEC}
    rows = F.array(*[
        F.struct(F.lit(d).alias("driver"), F.lit(labels.get(d, d)).alias("label"),
                 *[F.col(f"{d}_{p}").alias(p) for p in PERCENTILES])
        for d in drivers])
    moments = moments_of_counts(counts).withColumnRenamed("measure", "driver")
    return points.select(F.inline(rows)).join(moments, "driver").select("driver", "label", "mean", "std", *PERCENTILES)


def monthly_display(history: DataFrame) -> DataFrame:
    """Monthly means per brand and trade, each sailing counting the same."""
    return history.groupBy(month_start("departure_date").alias("month"), "brand", "trade").agg(
        F.avg("load_factor").alias("load_factor"),
        F.avg("gross_fare_per_diem").alias("gross_fare_per_diem"),
        F.sum("net_ticket_revenue").alias("net_ticket_revenue"),
        F.count("sailing_id").alias("n_sailings"),
    )


def brand_month_means(display: DataFrame, metric: str, brands: list[str]) -> DataFrame:
    """Mean of the trade means, by brand and month."""
    return (
        display.where(F.col("brand").isin(brands)).groupBy("brand", "month")
        .agg(F.avg(metric).alias(metric))
    )
