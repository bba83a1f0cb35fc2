"""The forecast run and the view over its latest result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.constants import DIMS, FALLBACK_BANDS, HORIZON, RATES
from fairlead.forecasting.evaluate import best_model, model_interval, model_mae, rolling_origin_errors
from fairlead.forecasting.models import MODELS, Model, fit_models, forecasts_long, residuals_long
from fairlead.forecasting.reconcile import bottom_up, reconcile
from fairlead.forecasting.series import (
    bottom_only, dense_grid, densify, rollup_series, series_arrays, series_long, split_key, summing_table,
)
from fairlead.functions.scalar import floor_round, horizon_index, month_start
from fairlead.operators.drivers import driver_medians
from fairlead.operators.waterfall import waterfall
from fairlead.session import settle
from fairlead.sources.schemas import RESULTS
from fairlead.sources.store import latest_run


def with_bands(forecasts: DataFrame, bands: dict[str, tuple[float, float]] = FALLBACK_BANDS) -> DataFrame:
    """Fill a missing interval with fixed shares of the forecast."""
    share = lambda i: F.element_at(
        F.create_map(*[x for d, b in bands.items() for x in (F.lit(d), F.lit(float(b[i])))]), F.col("driver"))
    have = forecasts.columns
    end = lambda c, i: F.coalesce(F.col(c), F.col("yhat") * share(i)) if c in have else F.col("yhat") * share(i)
    return forecasts.withColumns({"lo": end("lo", 0), "hi": end("hi", 1)})


def assemble_forecast(forecasts: DataFrame, medians: DataFrame, run_id: str, as_of: str, horizon: int = HORIZON,
                      run_ts: str | None = None) -> DataFrame:
    """Result rows of the bottom series: (driver, unique_id, ds, yhat, model, [lo, hi]) to one row per
    series and month, inside the horizon counted from ``as_of``, with the median rates beside them.

    Both drivers of a series meet by one aggregation instead of a join of the table with itself.
    """
    step = horizon_index("ds", F.lit(as_of).cast("date"))
    kept = with_bands(bottom_only(forecasts)).withColumn("horizon_month", step).where(step.between(1, horizon))
    names = {"load_factor": ("load_factor", "model_lf"), "per_diem": ("gross_per_diem", "model_pd")}
    cells = []
    for driver, (column, model) in names.items():
        mine = lambda c: F.max(F.when(F.col("driver") == driver, F.col(c)))
        cells += [mine("yhat").alias(f"{column}_fcst"), mine("lo").alias(f"{column}_lo80"),
                  mine("hi").alias(f"{column}_hi80"), mine("model").alias(model)]
    rows = kept.groupBy("unique_id", "ds", "horizon_month").agg(*cells).where(F.col("model_lf").isNotNull())
    rows = split_key(rows)
    same = F.expr(" and ".join(f"{d} <=> _{d}" for d in DIMS))
    rows = rows.join(medians.withColumnsRenamed({d: f"_{d}" for d in DIMS}), same, "left").drop(*[f"_{d}" for d in DIMS])
    rows = rows.withColumns({
        "run_id": F.lit(run_id), "run_ts": F.lit(run_ts).cast("timestamp_ntz") if run_ts else F.localtimestamp(),
        "forecast_date": F.col("ds")})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULTS.fields])


def month_before(as_of: str, months: int) -> str:
    year, month, _ = (int(x) for x in as_of.split("-"))
    k = year * 12 + month - 1 - months
    return f"{k // 12:04d}-{k % 12 + 1:02d}-01"


def run_forecast(monthly: DataFrame, run_id: str, as_of: str, horizon: int = HORIZON,
                 models: dict[str, Model] = MODELS, method: str = "mint_shrink",
                 cutoff_months: tuple[int, ...] = (13, 7), run_ts: str | None = None,
                 level: float = 0.8) -> DataFrame:
    """One forecast run: bottom series, all levels, all models, model choice, reconciliation, result rows.

    Gaps are filled at the bottom before adding up, so that sums hold in every month. The model of
    a driver is the one with the lowest error over held-out months; a series too short for it names the model it really got.
    The interval columns hold the interval at ``level``, whatever their names say. Runs jobs while it is called.
    """
    last = month_before(as_of, 1)
    # What is not known at ``as_of`` must not reach a model.
    monthly = settle(monthly.where(F.col("month") <= F.lit(last).cast("date")), "monthly")
    bottom = settle(dense_grid(series_long(monthly), last).select("driver", "unique_id", "ds", "y"), "bottom")
    levels = settle(rollup_series(bottom), "levels")
    summing = settle(summing_table(bottom), "summing")
    cutoffs = [month_before(as_of, m) for m in cutoff_months]
    errors = rolling_origin_errors(levels, models, cutoffs, min(cutoff_months) - 1)
    # One row per driver.
    choice = F.broadcast(settle(best_model(model_mae(errors), list(models)).select("driver", "model"), "choice"))
    fitted = fit_models(densify(series_arrays(levels), last), models, horizon)
    fitted = settle(fitted.drop("pts", "ys"), "fitted")
    best = model_interval(forecasts_long(fitted, list(models)).join(choice, ["driver", "model"]), level)
    best = best.withColumn("model", F.col("used"))
    if method == "bottom_up":
        coherent = bottom_up(bottom_only(best), summing)
    elif method == "mint_shrink":
        errors_in = None
        for m in models:
            part = residuals_long(fitted, m).withColumn("model", F.lit(m)).join(choice, ["driver", "model"]).drop("model")
            errors_in = part if errors_in is None else errors_in.unionByName(part)
        coherent = reconcile(best, errors_in, summing)
    else:
        raise ValueError(f"unknown reconciliation method {method}")
    best = best.drop("yhat").join(coherent.select("driver", "unique_id", "ds", "yhat"), ["driver", "unique_id", "ds"])
    return assemble_forecast(best, driver_medians(monthly), run_id, as_of, horizon, run_ts)


def baseline_view(future: DataFrame, results: DataFrame) -> DataFrame:
    """Scheduled sailings with the latest forecast of their series and month; the rest is dropped.

    The exact waterfall runs on the unrounded drivers, the amounts are rounded to whole units.
    """
    renamed = {f"{c}_base": c for c in RATES} | {"run_id": "forecast_run_id", "forecast_date": "forecast_month"}
    drivers = latest_run(results).drop("run_ts", "horizon_month").withColumnsRenamed(renamed)
    df = future.withColumn("forecast_month", month_start("departure_date"))
    df = df.join(drivers, [*DIMS, "forecast_month"])
    df = df.withColumns({
        "forecast_quarter": F.quarter("departure_date").cast("bigint"),
        "forecast_year": F.year("departure_date").cast("bigint"),
        "load_factor": F.col("load_factor_fcst"), "gross_fare_per_diem": F.col("gross_per_diem_fcst"),
    })
    df = waterfall(df, pax_mode="exact", decimals=0, pax_column="passengers_forecast")
    df = df.withColumns({
        "load_factor": floor_round("load_factor_fcst", 4), "load_factor_lo80": floor_round("load_factor_lo80", 4),
        "load_factor_hi80": floor_round("load_factor_hi80", 4),
        "gross_fare_per_diem": floor_round("gross_per_diem_fcst", 2),
        "gross_per_diem_lo80": floor_round("gross_per_diem_lo80", 2),
        "gross_per_diem_hi80": floor_round("gross_per_diem_hi80", 2)})
    return df.drop("load_factor_fcst", "gross_per_diem_fcst")


def uncovered_sailings(future: DataFrame, results: DataFrame) -> DataFrame:
    """Scheduled sailings that the view drops for want of a forecast."""
    have = latest_run(results).select(*DIMS, F.col("forecast_date").alias("forecast_month"))
    return future.withColumn("forecast_month", month_start("departure_date")).join(have, [*DIMS, "forecast_month"], "left_anti")
