import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlead.constants import OVERRIDABLE, OVERRIDE_COLUMNS
from fairlead.operators import scenario as X
from fairlead.operators.drivers import driver_stats
from fairlead.operators.waterfall import waterfall
from fairlead.session import settle
from test_drivers import sailings


@pytest.fixture(scope="module")
def world(spark):
    hist = spark.createDataFrame(sailings(800))
    forecast = settle(waterfall(spark.createDataFrame(sailings(300, seed=9))), "forecast")
    profile = settle(X.schedule_profile(forecast), "profile")
    stats = settle(driver_stats(hist), "stats")
    inputs = settle(X.driver_inputs(stats, profile, {"load_factor": 1.1, "gross_fare_per_diem": 1.05}), "inputs")
    return forecast, profile, stats, inputs


def total(df):
    return df.agg(F.sum("net_ticket_revenue")).first()[0]


def values(inputs):
    return {r.driver: r.value for r in inputs.collect()}


def test_inputs_scale_and_round(world):
    forecast, _, stats, inputs = world
    row = {r.driver: r for r in inputs.collect()}
    mean = forecast.agg(F.avg("discount_rate")).first()[0]
    assert row["discount_rate"].baseline == pytest.approx(np.floor(mean * 1000 + 0.5) / 10)
    assert row["discount_rate"].value == pytest.approx(row["discount_rate"].assumption / 100)
    assert row["gross_fare_per_diem"].assumption == int(row["gross_fare_per_diem"].assumption)


def test_fixed_sets_equal_the_waterfall(world):
    forecast, profile, _, inputs = world
    result = X.scenario_result(profile, inputs).first()
    assert result.scenario_ntr_m == pytest.approx(total(waterfall(forecast, values(inputs))) / 1e6)
    assert result.gap_m == pytest.approx(result.scenario_ntr_m - total(forecast) / 1e6)


def test_simulation_collapsed_equals_direct(world):
    forecast, profile, _, inputs = world
    a = X.monte_carlo(profile, inputs, 200).orderBy("draw_id").toPandas()
    b = X.monte_carlo(X.sailing_rows(forecast), inputs, 200).orderBy("draw_id").toPandas()
    assert len(a) == 200 and np.allclose(a.ntr_m, b.ntr_m, rtol=1e-12)
    draws = X.monte_carlo(profile, inputs, 200)
    s = X.simulation_summary(draws, F.lit(float(a.ntr_m.median()))).first()
    assert s.p50 == pytest.approx(a.ntr_m.median()) and s.feasibility_pct == pytest.approx(50) and s.feasibility == "Moderate — stretch"
    bins = X.simulation_histogram(draws).toPandas()
    assert len(bins) == 50 and bins.n.sum() == 200


def test_attribution(world):
    forecast, profile, _, inputs = world
    rows = {r.driver: r.impact_m for r in X.attribution(profile, inputs).collect()}
    means = {d: forecast.agg(F.avg(d)).first()[0] for d in OVERRIDABLE}
    v, base = values(inputs), total(forecast) / 1e6
    want = {}
    for d in OVERRIDABLE:
        impact = total(waterfall(forecast, means | {d: v[d]})) / 1e6 - base
        if abs(v[d] - means[d]) >= 1e-8 and abs(impact) > 0.1:
            want[d] = impact
    assert rows == pytest.approx(want)
    steps = X.attribution_steps(profile, inputs).orderBy("step").collect()
    assert steps[0].label == "Baseline" and steps[-1].label == "Your Scenario" and len(steps) == len(want) + 2
    alone = {r.driver: r.impact_m for r in X.isolated_attribution(forecast, inputs).collect()}
    assert alone["load_factor"] == pytest.approx(total(waterfall(forecast, {"load_factor": v["load_factor"]})) / 1e6 - base)


def test_batch_equals_one_by_one(spark, world):
    """All 64 choices of overridden drivers."""
    forecast, *_ = world
    set_to = {"load_factor": 0.7, "gross_fare_per_diem": 333.0, "discount_rate": 0.07, "commission_rate": 0.11,
              "air_inclusive_pct": 0.3, "promo_cost_per_pax": 44.0}
    rows = [(f"S{k}", *[v if k >> i & 1 else None for i, v in enumerate(set_to.values())]) for k in range(64)]
    schema = "scenario_id string, " + ", ".join(f"{OVERRIDE_COLUMNS[d]} double" for d in set_to)
    got = {r.scenario_id: r for r in X.scenario_batch(spark.createDataFrame(rows, schema), forecast).collect()}
    assert len(got) == 64 and got["S0"].scenario_ntr_m == pytest.approx(got["S0"].baseline_ntr_m)
    for k in (0, 1, 2, 5, 21, 42, 62, 63):
        chosen = {d: v for i, (d, v) in enumerate(set_to.items()) if k >> i & 1}
        assert got[f"S{k}"].scenario_ntr_m == pytest.approx(total(waterfall(forecast, chosen)) / 1e6)
        one = spark.createDataFrame([rows[k]], schema)
        assert total(X.apply_scenario(forecast, one)) / 1e6 == pytest.approx(got[f"S{k}"].scenario_ntr_m)


def test_grade_and_position_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.9, 1.0, 1.9, 2.0, 4.0, 4.1, 5.0, 5.1)], "x double")
    lit = [F.lit(float(p)) for p in (1, 2, 4, 5)]
    rows = df.select(X.grade(F.col("x"), *lit).alias("g"), X.position(F.col("x"), lit[0], lit[3]).alias("p"),
                     X.position(F.col("x"), lit[0], lit[0]).alias("same")).collect()
    assert [r.g for r in rows] == ["Heroic", "Stretch", "Stretch", "Normal", "Normal", "Stretch", "Stretch", "Heroic"]
    assert rows[0].p == 0 and rows[-1].p == 100 and rows[3].p == pytest.approx(25) and rows[0].same == 50


def test_labels_and_comparison(spark, world):
    forecast, *_ = world
    labels = spark.createDataFrame([(60.0,), (59.9,), (35.0,), (34.0,)], "f double").select(X.feasibility_label(F.col("f")).alias("l")).collect()
    assert [r.l[0] for r in labels] == ["H", "M", "M", "L"]
    saved = spark.createDataFrame(
        [("a", dt.datetime(2000, 1, 1), 10.0), ("b", dt.datetime(2000, 1, 2), None)],
        "scenario_id string, created_at timestamp_ntz, scenario_ntr_m double")
    rows = X.scenario_comparison(saved, forecast).collect()
    assert [r.scenario_id for r in rows] == ["b", "a"] and rows[0].delta_vs_baseline_m is None
    zero = X.scenario_comparison(saved, forecast.withColumn("net_ticket_revenue", F.lit(0.0))).collect()
    assert zero[1].pct_vs_baseline is None and zero[1].delta_vs_baseline_m == 10.0


def test_feasibility_of_all_scenarios_equals_one_by_one_simulation(spark, world, monkeypatch):
    _, profile, _, inputs = world
    rows = [("a", 0.9, None, None, None, None, None, 1.0), ("b", None, 180.0, 0.1, None, None, 40.0, None),
            ("c", None, None, None, None, None, None, None), ("c2", None, None, None, None, None, None, 5.0)]
    saved = spark.createDataFrame(rows, "scenario_id string, " + ", ".join(
        f"{c} double" for c in OVERRIDE_COLUMNS.values()) + ", target_ntr_m double").withColumn("notes", F.lit("x"))
    monkeypatch.setattr(X, "PROFILE_BLOCK", 7)         # several blocks per scenario and draw
    draws = X.scenario_draws(saved, profile, inputs, n=200).toPandas()
    assert len(draws) == 4 * 200
    for sid, *over, _ in rows:
        fixed = dict(zip(OVERRIDABLE, over))
        one = inputs.withColumn("value", F.coalesce(F.create_map(*[x for d in OVERRIDABLE for x in (
            F.lit(d), F.lit(fixed[d]).cast("double"))])[F.col("driver")], F.col("baseline_mean")))
        want = X.monte_carlo(profile, one, n=200).toPandas().sort_values("draw_id")
        got = draws[draws.scenario_id == sid].sort_values("draw_id")
        assert np.allclose(got.ntr_m.values, want.ntr_m.values, rtol=1e-12, atol=1e-9)
    summary = {r.scenario_id: r for r in X.scenario_feasibility(saved, profile, inputs, n=200).collect()}
    default = X.target_bounds(profile).first().default_target_m
    assert summary["a"].target_ntr_m == 1.0 and summary["c"].target_ntr_m == default
    for sid in ("a", "b", "c"):
        outcomes = draws[draws.scenario_id == sid].ntr_m.values
        assert summary[sid].feasibility_pct == pytest.approx((outcomes >= summary[sid].target_ntr_m).mean() * 100)
        assert summary[sid].p50 == pytest.approx(np.percentile(outcomes, 50))
    assert X.scenario_feasibility(saved.limit(0), profile, inputs, n=10).count() == 0


def test_write_back_fills_revenue_and_feasibility(spark, world):
    from fairlead.plans.scenarios import COMPARISON_COLUMNS, comparison, register_scenario_views, write_back
    from fairlead.session import fresh_path
    from fairlead.sources import store

    forecast, profile, _, inputs = world
    path = fresh_path(spark, "walk")
    saved = spark.createDataFrame([("a", 0.9, None, "t"), ("b", None, 250.0, None)],
                                  "scenario_id string, load_factor_override double, gross_per_diem_override double, notes string")
    store.save_scenario_versions(saved, path)
    full = settle(store.newest_scenarios(spark, path), "full")
    write_back(spark, path, forecast, profile, inputs)
    rows = {r.scenario_id: r for r in store.newest_scenarios(spark, path).collect()}
    batch = {r.scenario_id: r for r in X.scenario_batch(full.drop("scenario_ntr_m"), forecast).collect()}
    chance = {r.scenario_id: r for r in X.scenario_feasibility(full, profile, inputs).collect()}
    for k in ("a", "b"):
        assert rows[k].scenario_ntr_m == pytest.approx(batch[k].scenario_ntr_m)
        assert rows[k].feasibility_pct == pytest.approx(chance[k].feasibility_pct)
    assert rows["a"].notes == "t"
    shown = comparison(spark, path, forecast)
    assert shown.columns == COMPARISON_COLUMNS and len(COMPARISON_COLUMNS) == 17 and shown.count() == 2
    register_scenario_views(spark, path, forecast)
    assert spark.sql("select count(*) from v_scenario_comparison where feasibility_pct is not null").first()[0] == 2
