"""Seasonal-median baseline forecast with ordered fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.constants import ALL_DRIVERS, TREND
from fairlead.functions.scalar import floor_round_sql, month_start
from fairlead.operators.quantiles import quantiles_of_counts, roll_up_counts, settled_counts, value_counts
from fairlead.operators.waterfall import waterfall
from fairlead.session import settle

FALLBACK_LEVELS = [["trade", "ship_class", "season"], ["trade", "season"], []]
MEDIAN = {"med": 0.5}


def seasonal_medians(history: DataFrame, levels: list[list[str]] = FALLBACK_LEVELS,
                     measures: list[str] = ALL_DRIVERS) -> DataFrame:
    """Medians of the drivers at every level of ``levels`` from one pass over the history.

    Columns: ``level`` (position in ``levels``), the keys (null where rolled up), ``<driver>_med``.
    Medians of values with at most four decimals have at most five; rounding to six settles the
    last bit of the interpolation.
    """
    finest = list(dict.fromkeys(k for ks in levels for k in ks))
    counts = settled_counts(roll_up_counts(value_counts(history, finest, measures), levels))
    meds = quantiles_of_counts(counts, ["level", *finest], MEDIAN, measures)
    return meds.selectExpr("level", *finest, *[f"{floor_round_sql(f'{m}_med', 6)} as {m}_med" for m in measures])


def fallback_join(df: DataFrame, lookup: DataFrame, levels: list[list[str]], columns: list[str]) -> DataFrame:
    """Left-join ``columns`` from the first level that has a value, column by column.

    ``lookup`` holds all levels, told apart by ``level``. The last level may have no keys: its one
    row is read as a scalar subquery.
    """
    choices = {c: [] for c in columns}
    for i, keys in enumerate(levels):
        part = lookup.where(f"level = {i}")
        if keys:
            part = part.selectExpr(*[f"{k} as _{i}_{k}" for k in keys], *[f"{c} as _{i}_{c}" for c in columns])
            same = F.expr(" and ".join(f"{k} = _{i}_{k}" for k in keys))
            df = df.join(part, same, "left").drop(*[f"_{i}_{k}" for k in keys])
        else:
            df = df.withColumn(f"_{i}", part.select(F.struct(*columns)).scalar())
        for c in columns:
            choices[c].append(f"_{i}_{c}" if keys else f"_{i}.{c}")
    df = df.withColumns({c: F.expr(f"coalesce({', '.join(choices[c])})") for c in columns})
    return df.drop(*[f"_{i}_{c}" for i in range(len(levels)) for c in columns], *[f"_{i}" for i in range(len(levels))])


def baseline_forecast(history: DataFrame, future: DataFrame, levels: list[list[str]] = FALLBACK_LEVELS,
                      trend: dict[str, float] = TREND) -> DataFrame:
    """Scheduled sailings with forecast drivers and the truncated-passenger waterfall."""
    medians = settle(seasonal_medians(history, levels))
    df = fallback_join(future, medians, levels, [f"{d}_med" for d in ALL_DRIVERS])
    df = df.withColumns({d: F.expr(f"{d}_med * {float(trend.get(d, 1.0))!r}D") for d in ALL_DRIVERS})
    df = df.drop(*[f"{d}_med" for d in ALL_DRIVERS])
    df = df.withColumn("forecast_month", month_start("departure_date"))
    return waterfall(df, pax_mode="trunc")
