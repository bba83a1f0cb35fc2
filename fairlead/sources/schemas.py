"""Table layouts."""

from pyspark.sql import types as T

from fairlead.constants import RATES

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _fields(spec):
    return [T.StructField(n, t, null) for n, t, null in spec]


SCHEDULE = T.StructType(_fields([
    ("sailing_id", _L, False), ("ship_name", _S, False), ("ship_class", _S, False), ("brand", _S, False),
    ("trade", _S, False), ("itinerary_length", _I, False), ("departure_date", T.DateType(), False),
    ("lower_berth_capacity", _I, False),
]))
SCHEDULE_COLUMNS = SCHEDULE.fieldNames()

HISTORY = T.StructType(SCHEDULE.fields + _fields([
    ("passengers_booked", _I, True), ("gross_fare_per_diem", _D, True), ("gross_ticket_revenue", _D, True),
    ("discount_rate", _D, True), ("promo_cost_per_pax", _D, True), ("commission_rate", _D, True),
    ("direct_booking_pct", _D, True), ("air_inclusive_pct", _D, True), ("air_cost_per_pax", _D, True),
    ("taxes_fees_per_pax", _D, True), ("net_ticket_revenue", _D, True),
]))

RESULTS = T.StructType(_fields([
    ("run_id", _S, False), ("run_ts", T.TimestampNTZType(), False), ("forecast_date", T.DateType(), False),
    ("brand", _S, False), ("trade", _S, False), ("ship_class", _S, False), ("horizon_month", _I, False),
    ("load_factor_fcst", _D, True), ("load_factor_lo80", _D, True), ("load_factor_hi80", _D, True),
    ("gross_per_diem_fcst", _D, True), ("gross_per_diem_lo80", _D, True), ("gross_per_diem_hi80", _D, True),
    *[(f"{r}_base", _D, True) for r in RATES],
    ("model_lf", _S, True), ("model_pd", _S, True),
]))
RESULTS_KEY = ["run_id", "forecast_date", "brand", "trade", "ship_class"]

SCENARIOS = T.StructType(_fields([
    ("scenario_id", _S, False), ("scenario_name", _S, True), ("created_by", _S, True),
    ("created_at", T.TimestampNTZType(), True), ("target_ntr_m", _D, True),
    ("load_factor_override", _D, True), ("gross_per_diem_override", _D, True),
    ("discount_rate_override", _D, True), ("commission_rate_override", _D, True),
    ("air_inclusive_pct_override", _D, True), ("promo_cost_override", _D, True),
    ("scenario_ntr_m", _D, True), ("feasibility_pct", _D, True), ("notes", _S, True),
]))
