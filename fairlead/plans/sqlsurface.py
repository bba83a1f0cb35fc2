"""Named views and SQL functions over the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairlead.operators.drivers import driver_distributions, monthly_drivers
from fairlead.operators.waterfall import waterfall_summary
from fairlead.plans.runs import baseline_view


def register_views(spark: SparkSession, history: DataFrame, future: DataFrame, results: DataFrame | None = None) -> None:
    """Create or replace the views; they are plans, nothing is copied."""
    monthly = monthly_drivers(history)
    distributions = driver_distributions(monthly)
    views = {
        "sailings_hist": history, "sailings_future": future, "monthly_drivers": monthly,
        "driver_distributions": distributions, "v_driver_distributions": distributions,
    }
    if results is not None:
        view = baseline_view(future, results)
        views |= {"forecast_results": results, "v_baseline_forecast": view, "v_waterfall_summary": waterfall_summary(view)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> None:
    """SQL functions of the waterfall; their bodies are inlined into the calling query."""
    spark.sql("""
        create or replace temporary function waterfall_gross(pax double, per_diem double, nights int)
        returns double return pax * per_diem * nights""")
    spark.sql("""
        create or replace temporary function waterfall_net(
          pax double, gross double, discount double, commission double, direct double,
          promo double, air_share double, air_cost double, taxes double)
        returns double return gross * (1 - discount) * (1 - commission * (1 - direct))
          - pax * (promo + air_share * air_cost + taxes)""")
