"""Report tables: key figures, period tables, comparisons and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.constants import PRESETS, PRIOR_YEAR_FACTOR
from fairlead.functions import scalar as S


def by_brand_and_trade(df: DataFrame, brands: list[str] | None = None, trades: list[str] | None = None) -> DataFrame:
    if brands is not None:
        df = df.where(F.col("brand").isin(brands))
    if trades is not None:
        df = df.where(F.col("trade").isin(trades))
    return df


def history_figures(history: DataFrame) -> DataFrame:
    """One row: revenue of the last twelve months (both ends included), means and count of sailings.

    Daily sums come first, so the history is read once although the window depends on its last day.
    """
    daily = history.groupBy("departure_date").agg(
        F.sum("net_ticket_revenue").alias("ntr"),
        F.sum("load_factor").alias("lf"), F.count("load_factor").alias("n_lf"),
        F.sum("gross_fare_per_diem").alias("pd"), F.count("gross_fare_per_diem").alias("n_pd"),
        F.count(F.lit(1)).alias("n"),
    )
    days = daily.withColumn("last_day", F.max("departure_date").over(Window.partitionBy()))
    recent = F.col("departure_date") >= F.add_months("last_day", -12)
    return days.agg(
        F.sum(F.when(recent, F.col("ntr"))).alias("ntr_last12"),
        S.safe_div(F.sum("lf"), F.sum("n_lf")).alias("hist_load_factor"),
        S.safe_div(F.sum("pd"), F.sum("n_pd")).alias("hist_per_diem"),
        F.sum("n").alias("n_history"),
        F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("n_last12"),
    )


def kpi_landing(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Key figures of history and forecast with their display texts."""
    totals = forecast.agg(F.sum("net_ticket_revenue").alias("ntr_forecast"), F.count(F.lit(1)).alias("n_future"))
    row = history_figures(history).select(F.struct("*")).scalar()
    return (
        totals.withColumn("h", row)
        .select("h.*", "ntr_forecast", "n_future")
        .withColumns({
            "ntr_last12_text": S.fmt_billions("ntr_last12"),
            "ntr_forecast_text": S.fmt_billions("ntr_forecast"),
            "load_factor_text": S.fmt_percent("hist_load_factor"),
            "per_diem_text": S.fmt_dollars("hist_per_diem"),
            "n_history_text": S.fmt_thousands("n_history"),
        })
    )


def kpi_dashboard(history: DataFrame, forecast: DataFrame, brands: list[str] | None = None,
                  trades: list[str] | None = None) -> DataFrame:
    """Filtered forecast figures against the last twelve months and the historical means."""
    now = by_brand_and_trade(forecast, brands, trades).agg(
        F.sum("net_ticket_revenue").alias("total_ntr"), F.sum("gross_ticket_revenue").alias("total_gross"),
        F.avg("load_factor").alias("avg_load_factor"), F.avg("gross_fare_per_diem").alias("avg_per_diem"))
    row = history_figures(by_brand_and_trade(history, brands, trades)).select(F.struct("*")).scalar()
    prior = F.col("h.ntr_last12")
    return now.withColumn("h", row).select(
        "total_ntr", "total_gross", "avg_load_factor", "avg_per_diem", prior.alias("prior_ntr"),
        F.coalesce(S.safe_div(F.col("total_ntr") - prior, prior) * 100, F.lit(0.0)).alias("ntr_delta_pct"),
        (S.safe_div("total_ntr", "total_gross") * 100).alias("net_yield_pct"),
        ((F.col("avg_load_factor") - F.col("h.hist_load_factor")) * 100).alias("load_factor_pp"),
        (F.col("avg_per_diem") - F.col("h.hist_per_diem")).alias("per_diem_delta"),
    )


def _by_month(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(S.month_start("departure_date").alias("month")).agg(F.sum("net_ticket_revenue").alias(name))


def ntr_monthly(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Monthly net revenue, actual and forecast under each other."""
    return (
        _by_month(history, "ntr").withColumn("kind", F.lit("actual"))
        .unionByName(_by_month(forecast, "ntr").withColumn("kind", F.lit("forecast")))
    )


def prior_year_compare(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Forecast months beside the actuals twelve months earlier and the fixed-factor line."""
    prior = _by_month(history, "prior_ntr").select(F.add_months("month", 12).alias("month"), "prior_ntr")
    return _by_month(forecast, "ntr").join(prior, "month", "left").select(
        "month", F.add_months("month", -12).alias("prior_month"), "ntr", "prior_ntr",
        (F.col("ntr") * PRIOR_YEAR_FACTOR).alias("compare_ntr"),
        (S.safe_div(F.col("ntr") - F.col("prior_ntr"), F.col("prior_ntr")) * 100).alias("delta_pct"),
    )


def _factors(df: DataFrame, value: str) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(tag).alias("tag"), (F.col(value) * f).alias("ntr"))
        for n, f, tag in PRESETS])
    keep = [c for c in df.columns if c != value]
    return df.select(*keep, F.inline(rows))


def compare_targets(forecast: DataFrame) -> DataFrame:
    """Monthly forecast scaled by each preset."""
    return _factors(_by_month(forecast, "value"), "value")


def preset_scenarios(forecast: DataFrame) -> DataFrame:
    """Total forecast scaled by each preset."""
    return _factors(forecast.agg(F.sum("net_ticket_revenue").alias("value")), "value")


def ntr_by(forecast: DataFrame, column: str) -> DataFrame:
    """Net revenue by a column with its share of the total; the total is a scalar sum of the groups' sums.

    No window without partitions: a column with very many values (ships, sailings) is never gathered in one task.
    """
    sums = forecast.groupBy(column).agg(F.sum("net_ticket_revenue").alias("ntr"))
    return sums.withColumn("share", S.safe_div(F.col("ntr"), sums.agg(F.sum("ntr")).scalar()))


PERIODS = {
    "month": lambda: S.month_label("departure_date"),
    "quarter": lambda: S.quarter_label("departure_date"),
    "trade": lambda: F.col("trade"),
    "brand": lambda: F.col("brand"),
    "ship": lambda: F.col("ship_name"),
}


def period_table(forecast: DataFrame, by: str) -> DataFrame:
    """Counts, sums and means per period, trade, brand or ship."""
    return forecast.groupBy(PERIODS[by]().alias(by)).agg(
        F.count("sailing_id").alias("sailings"),
        F.sum("lower_berth_capacity").alias("capacity"),
        F.sum("passengers_booked").alias("passengers"),
        F.avg("load_factor").alias("load_factor"),
        F.avg("gross_fare_per_diem").alias("avg_per_diem"),
        F.sum("gross_ticket_revenue").alias("gross_ticket_revenue"),
        F.sum("net_ticket_revenue").alias("net_ticket_revenue"),
    )


def period_table_formatted(table: DataFrame) -> DataFrame:
    return table.withColumns({
        "load_factor": S.fmt_percent("load_factor"),
        "avg_per_diem": S.fmt_dollars("avg_per_diem"),
        "gross_ticket_revenue": S.fmt_millions("gross_ticket_revenue"),
        "net_ticket_revenue": S.fmt_millions("net_ticket_revenue"),
        "capacity": S.fmt_thousands("capacity"),
        "passengers": S.fmt_thousands("passengers"),
    })


def preview(df: DataFrame, columns: list[str], formats: dict[str, "callable"], n: int = 50) -> DataFrame:
    """The first sailings by departure with display formats; only the top rows leave each task."""
    head = df.select(*columns).orderBy("departure_date", "sailing_id").limit(n)
    return head.withColumns({c: f(c) for c, f in formats.items() if c in columns})


PREVIEW_FORMATS: dict[str, Column] = (
    {c: S.fmt_dollars for c in ("gross_ticket_revenue", "net_ticket_revenue", "gross_fare_per_diem")}
    | {c: S.fmt_percent for c in ("load_factor", "discount_rate", "commission_rate")}
)
