import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlead.constants import ALL_DRIVERS, PERCENTILES, RATES
from fairlead.operators.baseline import baseline_forecast, seasonal_medians
from fairlead.operators.drivers import driver_distributions, driver_medians, driver_stats, monthly_drivers
from fairlead.operators.quantiles import group_quantiles
from fairlead.operators.reports import history_figures, kpi_dashboard, ntr_by, period_table


def sailings(n, seed=1):
    """History with one crowded key: two thirds of the rows share trade and class."""
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.67
    day = [dt.date(1998, 1, 1) + dt.timedelta(days=int(k)) for k in rng.integers(0, 900, n)]
    pdf = pd.DataFrame({
        "sailing_id": np.arange(n), "ship_name": [f"S{k}" for k in rng.integers(0, 5, n)], "departure_date": day,
        "brand": np.where(hot, "A", rng.choice(["A", "B"], n)), "trade": np.where(hot, "T1", rng.choice(["T1", "T2", "T3"], n)),
        "ship_class": np.where(hot, "C1", rng.choice(["C1", "C2"], n)),
        "itinerary_length": rng.integers(3, 14, n), "lower_berth_capacity": rng.integers(1, 9, n) * 50,
        "load_factor": np.round(rng.uniform(0.3, 1.1, n), 4), "gross_fare_per_diem": np.round(rng.lognormal(5.5, 0.6, n), 2),
        **{c: np.round(rng.uniform(0.02, 0.3, n), 4) for c in RATES},
        "gross_ticket_revenue": rng.uniform(1e5, 1e6, n).round(2), "net_ticket_revenue": rng.uniform(1e4, 1e5, n).round(2)})
    pdf["season"] = [("Winter", "Spring", "Summer", "Fall")[d.month % 12 // 3] for d in day]
    pdf["passengers_booked"] = (pdf.lower_berth_capacity * pdf.load_factor).astype("int32")
    return pdf


def test_quantiles_match_numpy_on_a_hot_group(spark):
    pdf = sailings(5000)
    pdf.loc[::7, "load_factor"] = np.nan
    pdf["discount_rate"] -= 0.15  # negative values and zeros
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = group_quantiles(df, ["trade", "ship_class"], ["load_factor", "gross_fare_per_diem", "discount_rate"], PERCENTILES).toPandas()
    assert len(got) == pdf.groupby(["trade", "ship_class"]).ngroups
    for _, row in got.iterrows():
        part = pdf[(pdf.trade == row.trade) & (pdf.ship_class == row.ship_class)]
        for m in ("load_factor", "gross_fare_per_diem", "discount_rate"):
            for label, p in PERCENTILES.items():
                assert row[f"{m}_{label}"] == pytest.approx(np.nanquantile(part[m], p), abs=1e-9)


def test_quantiles_around_powers_of_ten(spark):
    from fairlead.operators.quantiles import coarse_bin
    near = [x for k in range(-12, 16) for p in (10.0**k,)
            for x in (np.nextafter(p, 0), p, np.nextafter(p, np.inf), p * 0.9995, p * 1.0005, 9.5 * p)]
    values = sorted({float(s * x) for x in near for s in (1, -1)} | {0.0, 5e-324, -5e-324, 1e-300, 1.7e308, -1.7e308})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r.b for r in df.select("v", coarse_bin(F.col("v")).alias("b")).orderBy("v").collect()]
    assert bins == sorted(bins)
    odd = [999.5, 999.9999999999999, 999.6, 999.7, 500.0]
    got = group_quantiles(spark.createDataFrame([(v,) for v in odd], "v double"), [], ["v"], {"p90": 0.9, "p100": 1.0}).first()
    assert got.v_p100 == max(odd) and got.v_p90 == pytest.approx(np.quantile(odd, 0.9), rel=1e-15)


def test_quantiles_of_many_distinct_values(spark):
    df = spark.range(200_000).select(((F.col("id") * 7919) % 200_000 / 7.0).alias("v"))
    got = group_quantiles(df, [], ["v"], PERCENTILES).first()
    want = np.arange(200_000) / 7.0
    assert all(got[f"v_{k}"] == pytest.approx(np.quantile(want, p), rel=1e-12) for k, p in PERCENTILES.items())


def test_bins_are_few_and_in_order(spark):
    from fairlead.operators.quantiles import BITS, WIDE_BITS, coarse_bin
    values = spark.range(200_000).select((F.col("id") + 100_000).cast("double").alias("v"))
    fine = coarse_bin(F.col("v"))
    got = values.select(F.count_distinct(fine).alias("fine"), F.count_distinct(coarse_bin(fine, WIDE_BITS)).alias("wide")).first()
    doublings = 2  # 100,000 to 300,000
    assert 2 < got.wide <= doublings * 2 ** (WIDE_BITS - 1) and got.wide < got.fine <= doublings * 2 ** (BITS - 1)
    inf = float("inf")
    ends = spark.createDataFrame([(v,) for v in (-inf, -1.7e308, -1e290, -2.5, -0.0, 0.0, 2.5, 1e290, 1.7e308, inf, float("nan"))],
                                 "v double")
    bins = [(r.b, r.w) for r in ends.withColumn("b", coarse_bin(F.col("v"))).withColumn("w", coarse_bin(F.col("b"), WIDE_BITS))
            .orderBy("v").collect()]
    assert bins == sorted(bins) and all(abs(b) < inf and abs(w) < inf for b, w in bins)


def test_quantiles_inside_wide_bins(spark):
    rng = np.random.default_rng(11)
    groups = {
        "near": 5.0 + rng.integers(0, 3000, 4000) * 1e-9,                       # one bin, many values
        "one wide": 1.0 + rng.integers(0, 900, 5000) / 65536,                   # one wide bin, many bins
        "mixed": np.round(rng.normal(0, 10.0 ** rng.integers(-6, 7, 6000)), 7),  # both signs, thirteen powers of ten
        "crowded": rng.choice([-2.5, 0.0, 0.1, 7.0], 3000), "two": np.array([-1e300, 1e300]), "four": np.array([1.0, 2.0, 4.0, 8.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, 3.0), (None, 4.0)]
    got = {r.k: r for r in group_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"], PERCENTILES).collect()}
    assert len(got) == 7
    for k, vs in [*groups.items(), (None, np.array([3.0, 4.0]))]:
        for label, p in PERCENTILES.items():
            assert got[k][f"v_{label}"] == pytest.approx(np.quantile(vs, p), rel=1e-9, abs=1e-12), (k, label)


def test_values_that_are_no_numbers_come_last(spark):
    values = [1.0, 20.0, 30.0, 40.0, float("nan")]
    assert group_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), [], ["v"], {"med": 0.5}).first().v_med == 30.0


def test_quantiles_of_constant_and_single_values(spark):
    df = spark.createDataFrame([("a", 5.0)] * 1000 + [("b", 1.0)] + [("c", None)], "k string, v double")
    got = {r.k: r for r in group_quantiles(df, ["k"], ["v"], PERCENTILES).collect()}
    assert got["a"].v_p10 == got["a"].v_p90 == 5.0 and got["b"].v_p50 == 1.0 and "c" not in got


def test_seasonal_medians_at_three_levels(spark):
    pdf = sailings(3000)
    got = seasonal_medians(spark.createDataFrame(pdf)).toPandas()
    assert got.level.value_counts().to_dict() == {
        0: pdf.groupby(["trade", "ship_class", "season"]).ngroups, 1: pdf.groupby(["trade", "season"]).ngroups, 2: 1}
    whole = got[got.level == 2].iloc[0]
    assert all(whole[f"{d}_med"] == pytest.approx(pdf[d].median(), abs=1e-6) for d in ALL_DRIVERS)


def test_fallback_levels(spark):
    """First row hits trade and class, the second only the trade, the third neither."""
    hist = sailings(200)
    hist = hist[(hist.trade == "T1") & (hist.ship_class == "C1") & (hist.season == "Winter")]
    hist = pd.concat([hist, hist.assign(trade="T2", load_factor=0.9)])
    future = pd.DataFrame({
        "sailing_id": [1, 2, 3], "trade": ["T1", "T2", "T9"], "ship_class": ["C1", "C9", "C1"], "season": ["Winter"] * 3,
        "departure_date": [dt.date(2000, 12, 5)] * 3, "lower_berth_capacity": [100] * 3, "itinerary_length": [7] * 3})
    got = baseline_forecast(spark.createDataFrame(hist), spark.createDataFrame(future)).orderBy("sailing_id").collect()
    own = hist[hist.trade == "T1"].load_factor.median()
    assert got[0].load_factor == pytest.approx(own * 1.005)
    assert got[1].load_factor == pytest.approx(0.9 * 1.005)
    assert got[2].load_factor == pytest.approx(hist.load_factor.median() * 1.005)
    assert got[2].gross_fare_per_diem == pytest.approx(round(hist.gross_fare_per_diem.median(), 6) * 1.02)
    assert all(r.net_ticket_revenue is not None for r in got)


def test_monthly_drivers_skip_nulls(spark):
    pdf = sailings(6).assign(departure_date=dt.date(1999, 5, 9), brand="A", trade="T", ship_class="C")
    pdf["passengers_booked"] = [10.0, 20.0, None, 30.0, None, 40.0]
    pdf["gross_fare_per_diem"] = [100.0, None, 300.0, 200.0, None, 400.0]
    pdf["lower_berth_capacity"] = [50] * 6
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    row = monthly_drivers(df).first()
    assert row.n_sailings == 6 and row.total_passengers == 100 and row.month == dt.date(1999, 5, 1)
    assert row.load_factor == pytest.approx(100 / 300)
    assert row.gross_fare_per_diem == pytest.approx((10 * 100 + 30 * 200 + 40 * 400) / 100)
    empty = monthly_drivers(df.withColumn("lower_berth_capacity", F.lit(0))).first()
    assert empty.load_factor is None


def test_distributions_medians_and_stats(spark):
    pdf = sailings(2000)
    df = spark.createDataFrame(pdf)
    m = monthly_drivers(df)
    mp = m.toPandas()
    for row in driver_distributions(m).collect():
        part = mp[(mp.brand == row.brand) & (mp.trade == row.trade) & (mp.ship_class == row.ship_class)]
        assert row.lf_p25 == pytest.approx(part.load_factor.quantile(0.25))
        assert row.lf_p10 <= row.lf_p25 <= row.lf_p50 <= row.lf_p75 <= row.lf_p90
    assert driver_medians(m).count() == mp.groupby(["brand", "trade", "ship_class"]).ngroups
    stats = driver_stats(df).toPandas().set_index("driver")
    assert stats.loc["load_factor", "std"] == pytest.approx(pdf.load_factor.std())
    assert stats.loc["gross_fare_per_diem", "p90"] == pytest.approx(pdf.gross_fare_per_diem.quantile(0.9))
    assert stats.loc["promo_cost_per_pax", "label"] == "Promo Cost/Pax ($)"


def test_reports(spark):
    pdf = sailings(500)
    df = spark.createDataFrame(pdf)
    last = max(pdf.departure_date)
    since = (pd.Timestamp(last) - pd.DateOffset(months=12)).date()
    row = history_figures(df).first()
    assert row.ntr_last12 == pytest.approx(pdf[pdf.departure_date >= since].net_ticket_revenue.sum())
    assert row.hist_load_factor == pytest.approx(pdf.load_factor.mean())
    empty = kpi_dashboard(df.where("false"), df).first()
    assert empty.ntr_delta_pct == 0 and empty.prior_ntr is None
    assert sum(r.share for r in ntr_by(df, "brand").collect()) == pytest.approx(1)
    assert period_table(df, "ship").agg(F.sum("sailings")).first()[0] == 500
