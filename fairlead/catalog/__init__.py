"""Registered queries."""

from fairlead.catalog import drivers, forecasting, reports, scenario  # noqa: F401
from fairlead.catalog.registry import ORACLES, QUERIES  # noqa: F401
