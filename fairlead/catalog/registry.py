"""Registry of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Money columns are compared to the cent, everything else to six decimals.
CENTS = {c: 2 for c in [
    "gross_ticket_revenue", "net_ticket_revenue", "discount_amount", "promo_cost_total", "ta_commission",
    "air_cost_total", "taxes_total", "commission_override", "kicker_total", "ntr", "amount", "running_total",
    "prior_ntr", "actual_ntr", "compare_ntr", "total_ntr", "total_gross", "ntr_last12", "ntr_forecast",
]}


def query(name: str, sql: str | None = None):
    """Register a query function, with its check SQL if there is one."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# Compared values are rounded at a point no short decimal falls on, so that a mean such as 0.5001125,
# whose last bit depends on the order of summation, rounds the same way in both engines.
SETTLED_HALF = 0.5000864201379
