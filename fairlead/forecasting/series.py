"""Monthly series: long form, hierarchy levels and one array per series.

A series has at most one point per calendar month, so its array is short however much history there
is. Building the arrays is the only shuffle; all models then work row by row on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.constants import DIMS, FORECAST_DRIVERS, LEVELS
from fairlead.functions.scalar import key_depth, key_part, safe_div, series_key

KEYS = ["driver", "unique_id"]


def series_long(monthly: DataFrame, drivers: dict[str, str] = FORECAST_DRIVERS) -> DataFrame:
    """(driver, unique_id, ds, y) for all drivers in one pass, months without a value left out."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("driver"), F.col(column).alias("y")) for name, column in drivers.items()])
    return (
        monthly.select(series_key().alias("unique_id"), F.col("month").alias("ds"), F.inline(rows))
        .where(F.col("y").isNotNull()).select(*KEYS, "ds", "y")
    )


def split_key(df: DataFrame, dims: list[str] = DIMS) -> DataFrame:
    return df.withColumns({d: key_part("unique_id", i) for i, d in enumerate(dims)})


def _prefix(n: int) -> Column:
    """The key's first parts; separators within a part are written otherwise, see ``series_key``."""
    return F.concat_ws("/", F.slice(F.split("unique_id", "/"), 1, n))


def rollup_series(series: DataFrame, levels: list[list[str]] = LEVELS, total: bool = False) -> DataFrame:
    """Sum of the series at every level, with the depth of the level (-1 for the total)."""
    nodes = [F.struct(F.lit(len(lv) - 1).alias("level"), _prefix(len(lv)).alias("node")) for lv in levels]
    if total:
        nodes.append(F.struct(F.lit(-1).alias("level"), F.lit("Total").alias("node")))
    return (
        series.select("driver", "ds", "y", F.inline(F.array(*nodes)))
        .groupBy("driver", F.col("node").alias("unique_id"), "level", "ds").agg(F.sum("y").alias("y"))
    )


def rollup_drivers(monthly: DataFrame, levels: list[list[str]] = LEVELS) -> DataFrame:
    """Drivers at every level from their additive parts: ratios are taken after the sums."""
    nodes = F.array(*[
        F.struct(F.lit(len(lv) - 1).alias("level"), series_key(*lv).alias("unique_id")) for lv in levels])
    parts = monthly.select(
        F.col("month").alias("ds"), "total_passengers", "total_capacity",
        (F.col("gross_fare_per_diem") * F.col("total_passengers")).alias("fare_days"), F.inline(nodes))
    sums = parts.groupBy("unique_id", "level", "ds").agg(
        *[F.sum(c).alias(c) for c in ("total_passengers", "total_capacity", "fare_days")])
    return sums.select("unique_id", "level", "ds",
                       safe_div("total_passengers", "total_capacity").alias("load_factor"),
                       safe_div("fare_days", "total_passengers").alias("gross_fare_per_diem"))


def summing_table(series: DataFrame, levels: list[list[str]] = LEVELS) -> DataFrame:
    """(node, level, bottom_id): which bottom series a node adds up."""
    nodes = F.array(*[
        F.struct(_prefix(len(lv)).alias("node"), F.lit(len(lv) - 1).alias("level")) for lv in levels])
    return (
        series.select("unique_id").distinct()
        .select(F.inline(nodes), F.col("unique_id").alias("bottom_id"))
    )


def bottom_only(df: DataFrame, dims: list[str] = DIMS) -> DataFrame:
    return df.where(key_depth("unique_id") == len(dims) - 1)


def series_arrays(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per series with its points ``pts`` (array of ds, y) in time order.

    The rows are small but the model work on each is not, so they keep the session's shuffle partitions: adaptive execution
    would join them by their bytes.
    """
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        series.repartition(n, *keys).groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("pts"))
    )


def at_cutoffs(arrays: DataFrame, cutoffs: list[str]) -> DataFrame:
    """Each series as it was known at each cutoff month, as column ``cutoff``; empty ones dropped."""
    dates = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    df = arrays.withColumn("cutoff", F.explode(dates))
    df = df.withColumn("pts", F.expr("filter(pts, p -> p.ds <= cutoff)"))
    return df.where(F.size("pts") > 0)


def densify(arrays: DataFrame, until: Column | str) -> DataFrame:
    """Add ``ys``: a value for every month from the first point to ``until``, with its length ``n``.

    Gaps take the mean of the same calendar month, else the mean of the series. Points after ``until`` are not
    known yet and are dropped; series that have no others are left out, ``late_series`` names them.
    """
    until = F.lit(until).cast("date") if isinstance(until, str) else until
    df = arrays.withColumn("last", until)
    df = df.withColumn("pts", F.expr("filter(pts, p -> p.ds <= last)")).where(F.size("pts") > 0)
    df = df.withColumns({
        "_known": F.map_from_entries("pts"),
        "_mean": F.expr("aggregate(pts, 0D, (s, p) -> s + p.y) / size(pts)"),
        "_month": F.expr("""
            transform(sequence(1, 12), k -> transform(array(filter(pts, p -> month(p.ds) = k)),
              q -> try_divide(aggregate(q, 0D, (s, p) -> s + p.y), cast(size(q) as double)))[0])"""),
    })
    df = df.withColumn("ys", F.expr("""
        transform(sequence(pts[0].ds, last, interval 1 month),
          d -> coalesce(try_element_at(_known, d), _month[month(d) - 1], _mean))"""))
    return df.withColumn("n", F.size("ys")).drop("_known", "_mean", "_month")


def late_series(series: DataFrame, until: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, first): series whose first point is after ``until``; they get no forecast."""
    first = series.groupBy(*keys).agg(F.min("ds").alias("first"))
    return first.where(F.col("first") > F.lit(until).cast("date"))


def dense_grid(series: DataFrame, until: str, keys: list[str] = KEYS) -> DataFrame:
    """Dense series in long form, telling which months were filled."""
    df = densify(series_arrays(series, keys), until)
    df = df.select(*keys, "pts", F.posexplode("ys").alias("i", "y"))
    ds = F.add_months(F.col("pts")[0]["ds"], F.col("i"))
    return df.select(*keys, ds.alias("ds"), "y", F.expr("not exists(pts, p -> p.ds = add_months(pts[0].ds, i))").alias("filled"))
