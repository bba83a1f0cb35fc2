"""Fixed values the results depend on, stated as plain text."""

# Key of a series, coarse to fine.
DIMS = ["brand", "trade", "ship_class"]

# Hierarchy levels, coarse to fine.
LEVELS = [["brand"], ["brand", "trade"], ["brand", "trade", "ship_class"]]

# Drivers with a forecast of their own, and their monthly column.
FORECAST_DRIVERS = {"load_factor": "load_factor", "per_diem": "gross_fare_per_diem"}

# The rates the waterfall takes from history rather than from a model.
RATES = [
    "discount_rate", "commission_rate", "air_inclusive_pct", "air_cost_per_pax",
    "promo_cost_per_pax", "taxes_fees_per_pax", "direct_booking_pct",
]

# Every waterfall driver.
ALL_DRIVERS = ["load_factor", "gross_fare_per_diem"] + RATES

# The six drivers an analyst may override.
# key, label in statistics, label in the input table, unit, scale, lower bound, upper bound, decimals
DRIVER_SPEC = [
    ("load_factor", "Load Factor", "Load Factor", "×", 1, 0.80, 1.20, 3),
    ("gross_fare_per_diem", "Gross Per Diem ($)", "Gross Per Diem", "$", 1, 150.0, 550.0, 0),
    ("discount_rate", "Discount Rate", "Discount Rate", "%", 100, 0.03, 0.25, 1),
    ("commission_rate", "Commission Rate", "Commission Rate", "%", 100, 0.05, 0.20, 1),
    ("air_inclusive_pct", "Air Inclusive %", "Air Inclusive %", "%", 100, 0.05, 0.40, 1),
    ("promo_cost_per_pax", "Promo Cost/Pax ($)", "Promo Cost / Pax", "$", 1, 20.0, 120.0, 0),
]
OVERRIDABLE = [d[0] for d in DRIVER_SPEC]

# Override columns of a saved scenario.
OVERRIDE_COLUMNS = {
    "load_factor": "load_factor_override",
    "gross_fare_per_diem": "gross_per_diem_override",
    "discount_rate": "discount_rate_override",
    "commission_rate": "commission_rate_override",
    "air_inclusive_pct": "air_inclusive_pct_override",
    "promo_cost_per_pax": "promo_cost_override",
}

# Statistics percentiles.
PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}

# Yearly trend put on the seasonal medians.
TREND = {"gross_fare_per_diem": 1.02, "load_factor": 1.005}

# Bands when a model gives none.
FALLBACK_BANDS = {"load_factor": (0.97, 1.03), "per_diem": (0.95, 1.05)}

# Preset scenarios and the comparison line of each choice.
PRESETS = [
    ("Base Case", 1.0, "baseline"),
    ("CFO Target", 1.08, "stretch"),
    ("Conservative", 0.93, "downside"),
]
PRIOR_YEAR_FACTOR = 0.95

# Target input (lowest, highest, default) as multiples of the baseline.
TARGET_FACTORS = (0.7, 1.5, 1.05)

# Feasibility labels by lowest percentage.
FEASIBILITY = [
    (60, "High likelihood"),
    (35, "Moderate — stretch"),
    (0, "Low — heroic assumptions"),
]

# Number of simulation draws, histogram bins, smallest shown impact in millions.
SIMULATIONS = 3000
HISTOGRAM_BINS = 50
MIN_IMPACT_M = 0.1
SAME_VALUE = 1e-8

# Peak months of each trade of the test tables.
PEAK_MONTHS = {
    "1-URGENT": [11, 12, 1, 2, 3, 4],
    "2-HIGH": [5, 6, 7, 8, 9, 10],
    "3-MEDIUM": [5, 6, 7, 8, 9],
    "4-NOT SPECIFIED": [6, 7, 8],
    "5-LOW": [4, 5, 6, 7, 8, 9, 10],
}

# Waterfall steps in display order (column, label, measure, sign).
WATERFALL_STEPS = [
    ("gross_ticket_revenue", "Gross Revenue", "absolute", 1),
    ("discount_amount", "Discounts", "relative", -1),
    ("promo_cost_total", "Promo Costs", "relative", -1),
    ("ta_commission", "TA Commission", "relative", -1),
    ("air_cost_total", "Air Costs", "relative", -1),
    ("taxes_total", "Taxes & Fees", "relative", -1),
    ("net_ticket_revenue", "Net Ticket Revenue", "total", 0),
]
AMOUNTS = [s[0] for s in WATERFALL_STEPS]

# Season length, forecast horizon, interval level in percent and its normal quantile.
SEASON = 12
HORIZON = 12
LEVEL = 80
Z80 = 1.2815515655446004

# Passengers may not exceed this share of the berths.
OCCUPANCY_CAP = 1.15
