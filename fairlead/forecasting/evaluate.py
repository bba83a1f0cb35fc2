"""Errors, model choice and prediction intervals."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.constants import HORIZON, SEASON, Z80
from fairlead.forecasting.models import Model, fit_models, forecasts_long
from fairlead.forecasting.series import KEYS, at_cutoffs, densify, key_part, series_arrays


def forecast_errors(actual: DataFrame, forecasts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Forecasts whose month has an actual value, with the error."""
    return forecasts.join(actual, [*keys, "ds"]).withColumn("error", F.col("y") - F.col("yhat"))


def rolling_origin_errors(series: DataFrame, models: dict[str, Model], cutoffs: list[str],
                          horizon: int = HORIZON) -> DataFrame:
    """Errors of forecasts made at each cutoff month with only the months up to it."""
    known = at_cutoffs(series_arrays(series), cutoffs)
    fitted = fit_models(densify(known, F.col("cutoff")), models, horizon)
    return forecast_errors(series, forecasts_long(fitted, list(models), [*KEYS, "cutoff"]))


def model_mae(errors: DataFrame) -> DataFrame:
    """Mean absolute error per driver and model: per series first, then over the series."""
    per_series = errors.groupBy(*KEYS, "model").agg(F.avg(F.abs("error")).alias("mae"))
    return per_series.groupBy("driver", "model").agg(F.avg("mae").alias("mae"))


def best_model(mae: DataFrame, order: list[str]) -> DataFrame:
    """Model with the lowest error per driver; on a tie the first in ``order``."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return mae.groupBy("driver").agg(F.min_by("model", F.struct("mae", rank)).alias("model"), F.min("mae").alias("mae"))


def mae_by_trade(errors: DataFrame, models: list[str]) -> DataFrame:
    """Mean absolute error per driver and trade, one column per model."""
    return (
        errors.groupBy("driver", key_part("unique_id", 1).alias("trade"))
        .agg(*[F.avg(F.when(F.col("model") == m, F.abs("error"))).alias(m) for m in models])
    )


def mark_best(table: DataFrame, models: list[str]) -> DataFrame:
    """Add the lowest error of each row and the first model that has it."""
    low = F.least(*models)
    name = reduce(lambda rest, m: F.when(F.col(m) == F.col("best_mae"), m).otherwise(rest), reversed(models), F.lit(None))
    return table.withColumn("best_mae", low).withColumn("best_model", name)


def gaussian_interval(forecasts: DataFrame, z: float = Z80) -> DataFrame:
    """Normal interval of a seasonal random walk: the width grows once per season."""
    width = z * F.col("sigma") * F.sqrt(F.floor((F.col("h") - 1) / SEASON) + 1)
    return forecasts.withColumns({"lo": F.col("yhat") - width, "hi": F.col("yhat") + width})


def model_interval(forecasts: DataFrame, level: float = 0.8) -> DataFrame:
    """Normal interval at any level, as wide as the model's own error is at each step."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    width = z * F.col("sigma") * F.col("width")
    return forecasts.withColumns({"lo": F.col("yhat") - width, "hi": F.col("yhat") + width})


def conformal_interval(forecasts: DataFrame, errors: DataFrame, level: float = 0.8,
                       by: tuple[str, ...] = ("driver", "unique_id", "model")) -> DataFrame:
    """Interval from the ``level`` quantile of the absolute held-out errors of each series."""
    width = errors.groupBy(*by).agg(F.percentile(F.abs("error"), F.lit(level)).alias("_half"))
    return forecasts.join(width, list(by), "left").withColumns({
        "lo": F.col("yhat") - F.col("_half"), "hi": F.col("yhat") + F.col("_half")}).drop("_half")


#: Levels of the conformal back-off: the series, its parent (the key without its last part), all series of the driver.
CONFORMAL_TIERS = ("series", "parent", "driver")


def conformal_by_horizon(forecasts: DataFrame, errors: DataFrame, level: float = 0.8) -> DataFrame:
    """Split-conformal interval per series and step ``h``, with the level stored in ``interval_level``.

    The half width is the k-th smallest absolute held-out error of the same driver, model and step, k = ceil((n + 1)
    * level) among the n errors of the series; where k > n the errors of the parent series (all series whose key
    differs only in its last part) are pooled, then those of all series of the driver. ``interval_tier`` tells which
    level gave the width; where none has enough errors, lo and hi are null. Errors are counted per value first and
    ranked through coarse bins, so a pool with all series of a driver is never held in one task.
    """
    from fairlead.operators.quantiles import roll_up_counts, settled_counts, value_counts, values_at_rank

    parent = F.regexp_replace("unique_id", "/[^/]*$", "")
    keys = ["driver", "model", "unique_id", "parent", "h"]
    tiers = [keys, ["driver", "model", "parent", "h"], ["driver", "model", "h"]]
    counts = value_counts(errors.select(*keys[:3], parent.alias("parent"), "h", F.abs("error").alias("abs_error")),
                          keys, ["abs_error"])
    ranked = values_at_rank(settled_counts(roll_up_counts(counts, tiers)), ["level", *keys],
                            f"ceil((total + 1) * {float(level)!r}D) - 1")
    found = forecasts.withColumn("_parent", parent)
    for i, ks in enumerate(tiers):
        names = {k: ("_parent" if k == "parent" else k) for k in ks}
        tier = ranked.where(F.col("level") == i).select(*[F.col(k).alias(f"_w{i}_{k}") for k in ks],
                                                        F.col("value").alias(f"_w{i}"))
        found = found.join(tier, [found[names[k]].eqNullSafe(tier[f"_w{i}_{k}"]) for k in ks], "left").drop(
            *[f"_w{i}_{k}" for k in ks])
    half = F.coalesce(*[F.col(f"_w{i}") for i in range(len(tiers))])
    tier_name = F.coalesce(*[F.when(F.col(f"_w{i}").isNotNull(), F.lit(t)) for i, t in enumerate(CONFORMAL_TIERS)])
    return found.withColumns({
        "lo": F.col("yhat") - half, "hi": F.col("yhat") + half, "interval_level": F.lit(float(level)),
        "interval_tier": tier_name}).drop("_parent", *[f"_w{i}" for i in range(len(tiers))])
