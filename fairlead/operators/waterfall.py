"""Gross to net revenue waterfall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.constants import AMOUNTS, OCCUPANCY_CAP, WATERFALL_STEPS
from fairlead.functions.scalar import floor_round_sql


def passengers(mode: str) -> str:
    """Passengers of a sailing: whole persons, capped whole persons, or the exact product."""
    exact = "lower_berth_capacity * load_factor"
    return {
        "trunc": f"cast({exact} as bigint)",
        "capped": f"least(cast({exact} as bigint), cast(lower_berth_capacity * {OCCUPANCY_CAP!r}D as bigint))",
        "exact": exact,
    }[mode]


def waterfall(
    df: DataFrame,
    overrides: dict[str, float | Column] | None = None,
    pax_mode: str = "trunc",
    decimals: int | None = None,
    pax_column: str = "passengers_booked",
    extended: bool = False,
) -> DataFrame:
    """Add passengers, gross, deductions and net to one row per sailing.

    ``overrides`` replace driver columns first. ``pax_mode``: ``trunc`` truncates passengers and
    uses the whole number everywhere, ``capped`` does so under the occupancy cap, ``exact`` keeps
    the product, ``given`` takes passengers and gross revenue from the row. ``decimals`` rounds the
    outputs (never the values inside the formulas). ``extended`` also deducts a share of the
    commission (``commission_override_pct``) and an amount per cabin of two (``kicker_per_cabin``).
    """
    if overrides:
        df = df.withColumns({k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in overrides.items()})
    if pax_mode == "given":
        pax, gross = f"cast({pax_column} as double)", "gross_ticket_revenue"
    else:
        pax, gross = passengers(pax_mode), "_pax * gross_fare_per_diem * itinerary_length"
    chain = [
        {"_pax": pax}, {"_gross": gross},
        {"_disc": "_gross * discount_rate", "_promo": "_pax * promo_cost_per_pax",
         "_air": "_pax * air_inclusive_pct * air_cost_per_pax", "_tax": "_pax * taxes_fees_per_pax"},
        {"_comm": "(_gross - _disc) * commission_rate * (1.0D - direct_booking_pct)"},
    ]
    net, out = "_gross - _disc - _promo - _comm", {}
    if extended:
        chain.append({"_extra": "_comm * commission_override_pct", "_kick": "_pax / 2.0D * kicker_per_cabin"})
        net += " - _extra - _kick"
        out |= {"commission_override": "_extra", "kicker_total": "_kick"}
    for step in chain:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    out |= {
        "gross_ticket_revenue": "_gross", "discount_amount": "_disc", "promo_cost_total": "_promo",
        "ta_commission": "_comm", "air_cost_total": "_air", "taxes_total": "_tax",
        "net_ticket_revenue": f"{net} - _air - _tax",
    }
    if decimals is not None:
        out = {k: floor_round_sql(v, decimals) for k, v in out.items()}
    if pax_mode != "given":
        out[pax_column] = floor_round_sql("_pax", decimals) if pax_mode == "exact" and decimals is not None else "_pax"
    out = {k: F.expr(v) for k, v in out.items()}
    hidden = ["_pax", "_gross", "_disc", "_promo", "_comm", "_air", "_tax", "_extra", "_kick"]
    return df.withColumns(out).drop(*hidden)


def waterfall_summary(forecast: DataFrame) -> DataFrame:
    """Monthly waterfall by brand and trade."""
    return forecast.groupBy("forecast_month", "brand", "trade").agg(*[F.sum(a).alias(a) for a in AMOUNTS])


def waterfall_steps(forecast: DataFrame) -> DataFrame:
    """Totals as seven ordered steps with the running height after each."""
    totals = forecast.agg(*[F.sum(a).alias(a) for a in AMOUNTS])
    running, rows = F.lit(0.0), []
    for i, (column, label, measure, sign) in enumerate(WATERFALL_STEPS, 1):
        running = running + F.col(column) * float(sign)
        delta = F.col(column) if measure == "total" else F.col(column) * float(sign)
        rows.append(F.struct(
            F.lit(i).cast("bigint").alias("step"), F.lit(label).alias("label"), F.lit(measure).alias("measure"),
            delta.alias("amount"), running.alias("running_total")))
    return totals.select(F.inline(F.array(*rows)))
