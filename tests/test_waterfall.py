import datetime as dt

import pytest
from pyspark.sql import functions as F

from fairlead.functions import scalar as S
from fairlead.operators.waterfall import waterfall, waterfall_steps, waterfall_summary

COLUMNS = ("sailing_id long, lower_berth_capacity int, itinerary_length int, load_factor double, "
           "gross_fare_per_diem double, discount_rate double, commission_rate double, air_inclusive_pct double, "
           "air_cost_per_pax double, promo_cost_per_pax double, taxes_fees_per_pax double, direct_booking_pct double")
RATES = (300.0, 0.10, 0.12, 0.2, 400.0, 50.0, 100.0, 0.25)


def rows(spark, *caps, lf=1.005):
    return spark.createDataFrame([(i, c, 7, lf, *RATES) for i, c in enumerate(caps, 1)], COLUMNS)


def by_hand(pax):
    gross = pax * 300.0 * 7
    disc, promo = gross * 0.10, pax * 50.0
    comm = (gross - disc) * 0.12 * 0.75
    air, tax = pax * 0.2 * 400.0, pax * 100.0
    return gross, disc, promo, comm, air, tax, gross - disc - promo - comm - air - tax


AMOUNTS = ["gross_ticket_revenue", "discount_amount", "promo_cost_total", "ta_commission", "air_cost_total",
           "taxes_total", "net_ticket_revenue"]


@pytest.mark.parametrize("mode, pax", [("trunc", [100, 200, 741, 749]), ("exact", [100.5, 201.0, 741.69, 749.73])])
def test_passenger_modes(spark, mode, pax):
    got = waterfall(rows(spark, 100, 200, 738, 746), pax_mode=mode).orderBy("sailing_id").collect()
    for row, p in zip(got, pax):
        assert [row[a] for a in AMOUNTS] == pytest.approx(by_hand(p if mode == "trunc" else row.lower_berth_capacity * 1.005))
        assert row.passengers_booked == pytest.approx(p)


def test_rounding_is_on_outputs_only(spark):
    row = waterfall(rows(spark, 738), pax_mode="exact", decimals=0).first()
    exact = by_hand(738 * 1.005)
    assert [row[a] for a in AMOUNTS] == [float(int(x + 0.5)) for x in exact]
    assert row.passengers_booked == 742.0


def test_zero_capacity_gives_zero(spark):
    row = waterfall(rows(spark, 0)).first()
    assert row.net_ticket_revenue == 0 and row.passengers_booked == 0


def test_overrides_and_extended(spark):
    df = rows(spark, 100).withColumns({"commission_override_pct": F.lit(0.01), "kicker_per_cabin": F.lit(20.0)})
    row = waterfall(df, {"load_factor": 1.5}, pax_mode="capped", extended=True).first()
    *_, comm, air, tax, net = by_hand(114)
    assert row.passengers_booked == 114  # 100 * 1.15 is just below 115 in binary
    assert row.net_ticket_revenue == pytest.approx(net - comm * 0.01 - 57 * 20.0)


def test_given_uses_booked_passengers(spark):
    df = rows(spark, 100).withColumns({"passengers_booked": F.lit(80), "gross_ticket_revenue": F.lit(168000.0)})
    row = waterfall(df, pax_mode="given", decimals=2).first()
    assert row.net_ticket_revenue == pytest.approx(by_hand(80)[-1])
    assert row.passengers_booked == 80


def test_summary_and_steps_add_up(spark):
    df = waterfall(rows(spark, 100, 200, 300)).withColumns({
        "forecast_month": F.lit(dt.date(2000, 8, 1)), "brand": F.lit("A"), "trade": F.col("sailing_id").cast("string")})
    detail = df.agg(F.sum("net_ticket_revenue")).first()[0]
    assert waterfall_summary(df).agg(F.sum("net_ticket_revenue")).first()[0] == pytest.approx(detail)
    steps = waterfall_steps(df).orderBy("step").collect()
    assert steps[-1].amount == pytest.approx(detail) and steps[-2].running_total == pytest.approx(detail)
    assert [s.measure for s in steps] == ["absolute"] + ["relative"] * 5 + ["total"]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(dt.date(2000, 12, 31), "1-URGENT", -1234567.5, 0.1235)], "d date, t string, x double, p double")
    row = df.select(
        S.season("d").alias("season"), S.quarter_label("d").alias("q"), S.is_peak("d", "t").alias("peak"),
        S.is_peak("d", F.lit("other")).alias("unknown"), S.horizon_index("d", F.lit(dt.date(2000, 8, 1))).alias("h"),
        S.fmt_dollars("x").alias("usd"), S.fmt_percent("p").alias("pct"), S.fmt_millions(F.lit(1234.56e6)).alias("mio"),
        S.fmt_billions(F.lit(1.236e9)).alias("bio"), S.safe_div("x", F.lit(0)).alias("div"),
        S.clip(F.lit(120.0), 0, 100).alias("clip"), S.floor_round(F.lit(0.125), 2).alias("r"),
        S.key_part(F.lit("a/b/c"), 1).alias("part"), S.key_depth(F.lit("a/b/c")).alias("depth"),
        S.floor_round(F.lit(1e17), 2).alias("big")).first()
    assert row.season == "Winter" and row.q == "Q4 2000" and row.peak and not row.unknown and row.h == 5
    assert row.usd == "$-1,234,567" and row.pct == "12.4%" and row.mio == "$1,234.6M" and row.bio == "$1.24B"
    assert row["div"] is None and row.clip == 100 and row.r == 0.13 and row.part == "b" and row.depth == 2 and row.big == 1e17
