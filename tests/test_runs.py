import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.constants import RATES
from fairlead.forecasting import models as M
from fairlead.plans.runs import assemble_forecast, run_forecast
from fairlead.plans.sqlsurface import register_functions
from fairlead.sources.schemas import RESULTS, RESULTS_KEY


def monthly(spark, months=40):
    rng = np.random.default_rng(7)
    rows = []
    for brand, cls in (("A", "1"), ("A", "2"), ("B", "1")):
        for k in range(months):
            if (brand, k) == ("B", 9):
                continue  # a gap to fill
            wave = np.sin(2 * np.pi * k / 12)
            rows.append((dt.date(1997 + k // 12, k % 12 + 1, 1), brand, "T", cls, float(0.8 + 0.1 * wave + rng.normal(0, .02)),
                         float(200 + 20 * wave + rng.normal(0, 4)), *[0.1] * len(RATES)))
    schema = "month date, brand string, trade string, ship_class string, load_factor double, gross_fare_per_diem double, "
    return spark.createDataFrame(rows, schema + ", ".join(f"{r} double" for r in RATES))


@pytest.mark.parametrize("method", ["mint_shrink", "bottom_up"])
def test_run_gives_a_row_per_series_and_month(spark, method):
    models = {"seasonal_naive": M.seasonal_naive, "sar": M.sar}
    out = run_forecast(monthly(spark), "r1", "2000-05-01", models=models, method=method)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in RESULTS]
    rows = out.collect()
    assert len(rows) == 36 and len({tuple(r[k] for k in RESULTS_KEY) for r in rows}) == 36
    assert {r.horizon_month for r in rows} == set(range(1, 13))
    assert {r.forecast_date for r in rows} == {dt.date(2000 + (4 + h) // 12, (4 + h) % 12 + 1, 1) for h in range(12)}
    for r in rows:
        season = np.sin(2 * np.pi * (r.forecast_date.month - 1) / 12)
        assert r.load_factor_fcst == pytest.approx(0.8 + 0.1 * season, abs=0.12)
        assert r.load_factor_lo80 < r.load_factor_hi80 and r.gross_per_diem_lo80 < r.gross_per_diem_hi80
        assert r.model_lf in models and r.discount_rate_base == pytest.approx(0.1)


def test_odd_names_and_future_months(spark):
    """Separators in a name lose no series, months after ``as_of`` change nothing, a short series names its real model."""
    df = monthly(spark).withColumn("trade", F.when(F.col("ship_class") == "2", "Al/ska%").otherwise("T"))
    df = df.where("ship_class <> '2' or month >= '1999-12-01'")
    models = {"sar": M.sar}
    rows = run_forecast(df, "r1", "2000-05-01", models=models, method="bottom_up", level=0.95).collect()
    assert len(rows) == 36 and {r.trade for r in rows} == {"T", "Al/ska%"}
    assert {r.model_lf for r in rows if r.trade == "T"} == {"sar"} and {r.model_lf for r in rows if r.trade != "T"} == {"seasonal_naive"}
    assert all(r.discount_rate_base == pytest.approx(0.1) for r in rows)
    later = df.unionByName(df.withColumn("month", F.expr("add_months(month, 40)")).withColumn("load_factor", F.lit(99.0)))
    again = run_forecast(later, "r1", "2000-05-01", models=models, method="bottom_up", level=0.95).collect()
    key = lambda r: (r.brand, r.trade, r.ship_class, r.forecast_date)
    assert {key(r): r.load_factor_fcst for r in again} == pytest.approx({key(r): r.load_factor_fcst for r in rows})


def test_assembly_bands_horizon_and_missing_driver(spark):
    fc = spark.createDataFrame(
        [("load_factor", "A/T/1", dt.date(2000, m, 1), 1.0, "m") for m in (4, 5, 6)]
        + [("per_diem", "A/T/1", dt.date(2000, 5, 1), 200.0, "n"), ("per_diem", "B/T/1", dt.date(2000, 5, 1), 1.0, "n"),
           ("load_factor", "A/T", dt.date(2000, 5, 1), 9.0, "m")],
        "driver string, unique_id string, ds date, yhat double, model string")
    medians = spark.createDataFrame([], "brand string, trade string, ship_class string, " + ", ".join(f"{r}_base double" for r in RATES))
    rows = {r.forecast_date: r for r in assemble_forecast(fc, medians, "r", "2000-05-01").collect()}
    assert sorted(rows) == [dt.date(2000, 5, 1), dt.date(2000, 6, 1)]
    may, june = rows[dt.date(2000, 5, 1)], rows[dt.date(2000, 6, 1)]
    assert (may.load_factor_lo80, may.load_factor_hi80) == pytest.approx((0.97, 1.03))
    assert (may.gross_per_diem_lo80, may.gross_per_diem_hi80) == pytest.approx((190, 210))
    assert june.gross_per_diem_fcst is None and june.model_pd is None and june.discount_rate_base is None


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("""select waterfall_gross(100, 300, 7) as g,
        waterfall_net(100, 210000, 0.1, 0.12, 0.25, 50, 0.2, 400, 100) as n""").first()
    assert row.g == 210000 and row.n == pytest.approx(210000 * 0.9 * (1 - 0.12 * 0.75) - 100 * (50 + 80 + 100))
