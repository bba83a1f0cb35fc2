"""Queries on assumptions, scenarios, attribution and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.catalog.base import forecast, shown
from fairlead.catalog.drivers import _STATS
from fairlead.catalog.forecasting import _VIEW, view
from fairlead.catalog.registry import query
from fairlead.catalog.sqltext import fr, r, rc, with_ctes
from fairlead.constants import ALL_DRIVERS, AMOUNTS, OVERRIDABLE, OVERRIDE_COLUMNS
from fairlead.operators import scenario as X
from fairlead.operators.baseline import baseline_forecast
from fairlead.operators.drivers import driver_stats
from fairlead.session import settle
from fairlead.sources.standin import AS_OF, future, history, scenarios

# The analyst's edits used in the queries: assumption = baseline mean times factor, rounded.
EDITS = {"load_factor": 1.03, "gross_fare_per_diem": 1.05, "discount_rate": 0.9}


def setup(spark, sf_dir, edits=EDITS):
    """Profile of the schedule and the input table; both small, each computed once."""
    hist, fut = history(spark, sf_dir), future(spark, sf_dir)
    fc = baseline_forecast(hist, fut)
    profile = settle(X.schedule_profile(fc), "profile")
    return fc, profile, settle(X.driver_inputs(driver_stats(hist), profile, edits), "inputs")


_SPEC = """(values ('load_factor', 'Load Factor', '×', 1, 0.80::double, 1.20::double, 1000, 1),
  ('gross_fare_per_diem', 'Gross Per Diem', '$', 1, 150.0::double, 550.0::double, 1, 2),
  ('discount_rate', 'Discount Rate', '%', 100, 0.03::double, 0.25::double, 10, 3),
  ('commission_rate', 'Commission Rate', '%', 100, 0.05::double, 0.20::double, 10, 4),
  ('air_inclusive_pct', 'Air Inclusive %', '%', 100, 0.05::double, 0.40::double, 10, 5),
  ('promo_cost_per_pax', 'Promo Cost / Pax', '$', 1, 20.0::double, 120.0::double, 1, 6))
  s(driver, label, unit, scale, lo, hi, s10, ord)"""

_MEANS = " union all ".join(f"select '{d}' as driver, avg({d}) as m from fcst" for d in OVERRIDABLE)
_INPUTS = f"""st as ({_STATS}),
mean as ({_MEANS}),
inp0 as (select s.*, m, std, p10*scale as p10, p25*scale as p25, p50*scale as p50, p75*scale as p75, p90*scale as p90,
  floor(m*scale*case driver when 'load_factor' then 1.03::double when 'gross_fare_per_diem' then 1.05::double
    when 'discount_rate' then 0.9::double else 1.0::double end*s10+0.5)/s10 as assumption
  from {_SPEC} join st using (driver) join mean using (driver)),
inp as (select * exclude (label), label, assumption/scale as value from inp0),
base as (select sum(net_ticket_revenue)/1e6 as b from fcst),
ov as (select {', '.join(f"max(value) filter (driver = '{d}') as o_{d}" for d in OVERRIDABLE)},
  {', '.join(f"max(std) filter (driver = '{d}') as s_{d}" for d in OVERRIDABLE)},
  {', '.join(f"max(m) filter (driver = '{d}') as m_{d}" for d in OVERRIDABLE)} from inp)"""


def _net(**drivers) -> str:
    """Net revenue of a sailing in ``fcst`` under the given driver expressions."""
    d = {k: drivers.get(k, k) for k in ALL_DRIVERS}
    pax = f"trunc(lower_berth_capacity*{d['load_factor']})"
    kept = f"{pax}*{d['gross_fare_per_diem']}*itinerary_length*(1-{d['discount_rate']})"
    return (f"({kept}*(1-{d['commission_rate']}*(1-direct_booking_pct))-{pax}*({d['promo_cost_per_pax']}"
            f"+{d['air_inclusive_pct']}*air_cost_per_pax+taxes_fees_per_pax))")


def _inputs(body):
    return with_ctes("fcst", body, _INPUTS)


@query("driver_input_table", _inputs(f"""
select driver, label, unit, cast(scale as bigint) as scale, {r('floor(p50*s10+0.5)/s10')} as hist_p50,
  {r('floor(p10*s10+0.5)/s10')} as hist_p10, {r('floor(p90*s10+0.5)/s10')} as hist_p90,
  {r('floor(m*scale*s10+0.5)/s10')} as baseline, {rc('assumption')}, {rc('value')},
  value between lo and hi as in_bounds from inp"""))
def q_inputs(spark, sf_dir):
    _, _, inputs = setup(spark, sf_dir)
    return shown(inputs.drop("baseline_mean", "p10", "p25", "p50", "p75", "p90", "std"))


_POS = "case when p90 = p10 then 50::double else greatest(least((assumption-p10)/(p90-p10)*100, 100), 0) end"


@query("driver_position", _inputs(f"select driver, {r(_POS)} as position from inp"))
def q_position(spark, sf_dir):
    _, _, inputs = setup(spark, sf_dir)
    return shown(X.grade_drivers(inputs).select("driver", "position"))


@query("driver_grade", _inputs(f"""
select driver, label, {rc('assumption')}, {r(_POS)} as position, case when assumption between p25 and p75 then 'Normal'
  when assumption between p10 and p90 then 'Stretch' else 'Heroic' end as grade, value between lo and hi as in_bounds
from inp"""))
def q_grade(spark, sf_dir):
    _, _, inputs = setup(spark, sf_dir)
    return shown(X.grade_drivers(inputs))


@query("target_bounds", with_ctes("fcst", f"""
select {r('b')} as baseline_ntr_m, {r('b*0.7::double')} as min_target_m, {r('b*1.5::double')} as max_target_m,
  floor(b*1.05::double+0.5) as default_target_m from (select sum(net_ticket_revenue)/1e6 as b from fcst)"""))
def q_bounds(spark, sf_dir):
    return shown(X.target_bounds(X.schedule_profile(forecast(spark, sf_dir))))


_SCEN = f"select sum({_net(**{d: f'o_{d}' for d in OVERRIDABLE})})/1e6 as n from fcst, ov"


@query("scenario_result", _inputs(f"""
select {r('b')} as baseline_ntr_m, {r('n')} as scenario_ntr_m, t as target_ntr_m, {r('n-b')} as gap_m,
  {r('n-t')} as gap_vs_target_m, {r('(t-b)/b*100')} as required_delta_pct
from (select b, floor(b*1.05::double+0.5) as t from base), ({_SCEN})"""))
def q_result(spark, sf_dir):
    _, profile, inputs = setup(spark, sf_dir)
    return shown(X.scenario_result(profile, inputs))


def _one(d):
    return _net(**{k: (f"o_{k}" if k == d else f"m_{k}") for k in OVERRIDABLE})


_ATTR = " union all ".join(
    f"select '{d}' as driver, sum({_one(d)})/1e6-max(b) as impact_m from fcst, ov, base "
    f"where abs(o_{d}-m_{d}) >= 1e-8 having count(*) > 0" for d in OVERRIDABLE)


@query("attribution", _inputs(f"""
select driver, label, {rc('impact_m')} from ({_ATTR}) join (select driver, label from inp) using (driver)
where abs(impact_m) > 0.1"""))
def q_attribution(spark, sf_dir):
    _, profile, inputs = setup(spark, sf_dir)
    return shown(X.attribution(profile, inputs))


@query("attribution_steps", _inputs(f"""
select step, label, measure, {rc('value_m')} from (
  select 0::bigint as step, 'Baseline' as label, 'absolute' as measure, b as value_m from base union all
  select ord, label, 'relative', impact_m from ({_ATTR}) join (select driver, label, ord from inp) using (driver)
    where abs(impact_m) > 0.1 union all
  select 99, 'Your Scenario', 'total', n from ({_SCEN}))"""))
def q_attribution_steps(spark, sf_dir):
    _, profile, inputs = setup(spark, sf_dir)
    return shown(X.attribution_steps(profile, inputs))


_ALONE = " union all ".join(
    f"select '{d}' as driver, sum({_net(**{d: f'o_{d}'})})/1e6-max(b) as impact_m from fcst, ov, base" for d in OVERRIDABLE)


@query("attribution_isolated", _inputs(f"select driver, {rc('impact_m')} from ({_ALONE})"))
def q_attribution_isolated(spark, sf_dir):
    fc, _, inputs = setup(spark, sf_dir)
    return shown(X.isolated_attribution(fc, inputs))


def _u(k):
    return f"(('0x' || substr(md5(cast(i as varchar) || ':{k}'), 1, 8))::bigint + 0.5::double) / 4294967296::double"


_DRAWS = "draws as (select i, " + ", ".join(
    f"o_{d} + s_{d} * sqrt(-2::double*ln({_u(2 * j)})) * cos(6.283185307179586::double*{_u(2 * j + 1)}) as w_{d}"
    for j, d in enumerate(OVERRIDABLE)) + " from range(3000) x(i), ov)"
_MC = _INPUTS + ",\n" + _DRAWS + f""",
sims as (select i as draw_id, sum({_net(**{d: f'w_{d}' for d in OVERRIDABLE})})/1e6 as ntr_m from fcst, draws group by i)"""


@query("montecarlo_direct", with_ctes("fcst", f"select draw_id, {rc('ntr_m')} from sims", _MC))
def q_mc_direct(spark, sf_dir):
    fc, _, inputs = setup(spark, sf_dir)
    return shown(X.monte_carlo(X.sailing_rows(fc), inputs))


@query("montecarlo_collapsed", with_ctes("fcst", f"select draw_id, {rc('ntr_m')} from sims", _MC))
def q_mc(spark, sf_dir):
    _, profile, inputs = setup(spark, sf_dir)
    return shown(X.monte_carlo(profile, inputs))


_LABEL = ("case when f >= 60 then 'High likelihood' when f >= 35 then 'Moderate — stretch' "
          "else 'Low — heroic assumptions' end as feasibility")
_SUMMARY = """select count(*) as simulations, quantile_cont(ntr_m, 0.1) as p10, quantile_cont(ntr_m, 0.5) as p50,
  quantile_cont(ntr_m, 0.9) as p90, avg(case when ntr_m >= t then 1 else 0 end)*100 as f
  from sims, (select floor(b*1.05::double+0.5) as t from base)"""


def _draws(spark, sf_dir):
    _, profile, inputs = setup(spark, sf_dir)
    target = X.target_bounds(profile).select("default_target_m").scalar()
    return settle(X.monte_carlo(profile, inputs), "draws"), target


@query("montecarlo_summary", with_ctes("fcst", f"""
select simulations, {rc('p10', 5)}, {rc('p50', 5)}, {rc('p90', 5)}, {r('f')} as feasibility_pct, {_LABEL} from ({_SUMMARY})""", _MC))
def q_mc_summary(spark, sf_dir):
    return shown(X.simulation_summary(*_draws(spark, sf_dir)), p10=5, p50=5, p90=5)


@query("feasibility_label", with_ctes("fcst", f"""
select {r('f')} as feasibility_pct, {_LABEL} from ({_SUMMARY})""", _MC))
def q_label(spark, sf_dir):
    return shown(X.simulation_summary(*_draws(spark, sf_dir)).select("feasibility_pct", "feasibility"))


@query("montecarlo_histogram", with_ctes("fcst", f"""
select bin, {r('lo+(hi-lo)/50*bin', 4)} as from_m, {r('lo+(hi-lo)/50*(bin+1)', 4)} as to_m, coalesce(n, 0) as n
from (select cast(i as bigint) as bin, lo, hi from range(50) g(i), (select min(ntr_m) as lo, max(ntr_m) as hi from sims))
left join (select cast(least(floor((ntr_m-l)/(h-l)*50), 49) as bigint) as bin, count(*) as n
  from sims, (select min(ntr_m) as l, max(ntr_m) as h from sims) group by 1) using (bin)""", _MC))
def q_mc_histogram(spark, sf_dir):
    draws, _ = _draws(spark, sf_dir)
    return shown(X.simulation_histogram(draws), from_m=4, to_m=4)


# saved scenarios ---------------------------------------------------------------------

_SAVED = f"""saved as (select concat('S', n_nationkey) as scenario_id, n_name as scenario_name,
  cast(date '{AS_OF}' + cast(n_nationkey as integer) as timestamp) as created_at,
  case when n_nationkey % 2 = 0 then 0.40::double + n_nationkey / 100.0::double end as load_factor_override,
  case when n_nationkey % 3 = 0 then cast(200 + 5 * n_nationkey as double) end as gross_per_diem_override,
  case when n_nationkey % 4 = 0 then 0.03::double + n_nationkey / 500.0::double end as discount_rate_override,
  case when n_nationkey % 5 = 0 then 0.02::double + n_nationkey / 500.0::double end as commission_rate_override,
  case when n_nationkey % 6 = 0 then 0.10::double + n_nationkey / 200.0::double end as air_inclusive_pct_override,
  case when n_nationkey % 7 = 0 then cast(30 + n_nationkey as double) end as promo_cost_override from nation)"""
_OV = ", ".join(rc(c) for c in OVERRIDE_COLUMNS.values())
_PICK = {d: f"coalesce({c}, {d})" for d, c in OVERRIDE_COLUMNS.items()}


@query("scenario_coalesce", with_ctes("fcst", f"""
select scenario_id, count(*) as n, {', '.join(f'{r(f"avg({e})")} as {d}' for d, e in _PICK.items())},
  {r(f'sum({_net(**_PICK)})', 2)} as net_ticket_revenue
from fcst, saved group by scenario_id""", _SAVED))
def q_coalesce(spark, sf_dir):
    """Every saved scenario applied to every sailing, summed up."""
    done = X.apply_scenarios(forecast(spark, sf_dir), scenarios(spark, sf_dir))
    return shown(done.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(d).alias(d) for d in OVERRIDABLE], F.sum("net_ticket_revenue").alias("net_ticket_revenue")))


_BATCH = f"""batch as (select scenario_id, sum({_net(**_PICK)})/1e6 as n, sum(net_ticket_revenue)/1e6 as b
  from fcst, saved group by 1)"""


@query("scenario_batch", with_ctes("fcst", f"""
select scenario_id, scenario_name, created_at, {_OV}, {r('n', 5)} as scenario_ntr_m, {r('b', 5)} as baseline_ntr_m
from saved join batch using (scenario_id)""", _SAVED + ",\n" + _BATCH))
def q_batch(spark, sf_dir):
    return shown(X.scenario_batch(scenarios(spark, sf_dir), forecast(spark, sf_dir)), scenario_ntr_m=5, baseline_ntr_m=5)


@query("scenario_comparison", with_ctes("monthly future fcst", f"""
select scenario_id, scenario_name, created_at, {_OV}, {r('n', 5)} as scenario_ntr_m, {r('v', 5)} as baseline_ntr_m,
  {r('n-v', 5)} as delta_vs_baseline_m, {r(fr('(n-v)/nullif(v, 0)*100', 1))} as pct_vs_baseline
from saved join batch using (scenario_id), (select sum(net_ticket_revenue)/1e6 as v from vw)
order by created_at desc""", _VIEW + ",\n" + _SAVED + ",\n" + _BATCH))
def q_comparison(spark, sf_dir):
    """Scenarios on the seasonal medians beside the total of the reporting view's latest run."""
    done = X.scenario_batch(scenarios(spark, sf_dir), forecast(spark, sf_dir)).drop("baseline_ntr_m")
    return shown(X.scenario_comparison(done, view(spark, sf_dir)), scenario_ntr_m=5, baseline_ntr_m=5, delta_vs_baseline_m=5)


_SDRAWS = "sdraws as (select scenario_id, i, " + ", ".join(
    f"coalesce({OVERRIDE_COLUMNS[d]}, m_{d}) + s_{d} * sqrt(-2::double*ln({_u(2 * j)})) * cos(6.283185307179586::double*{_u(2 * j + 1)})"
    f" as w_{d}" for j, d in enumerate(OVERRIDABLE)) + " from saved, ov, range(3000) x(i))"
_PROF = """prof as (select lower_berth_capacity as cap, itinerary_length as len, count(*) as k, sum(1-direct_booking_pct) as ag,
  sum(air_cost_per_pax) as air, sum(taxes_fees_per_pax) as tx from fcst group by 1, 2)"""
_SSIMS = """ssims as (select scenario_id, i as draw_id, sum(trunc(cap*w_load_factor)*(w_gross_fare_per_diem*len*(1-w_discount_rate)
  *(k-w_commission_rate*ag) - (k*w_promo_cost_per_pax + w_air_inclusive_pct*air + tx)))/1e6 as ntr_m
  from sdraws, prof group by 1, 2)"""


@query("scenario_feasibility", with_ctes("fcst", f"""
select scenario_id, t as target_ntr_m, count(*) as simulations, {r('quantile_cont(ntr_m, 0.1)', 5)} as p10,
  {r('quantile_cont(ntr_m, 0.5)', 5)} as p50, {r('quantile_cont(ntr_m, 0.9)', 5)} as p90,
  {r('avg(case when ntr_m >= t then 1 else 0 end)*100')} as feasibility_pct,
  case when avg(case when ntr_m >= t then 1 else 0 end)*100 >= 60 then 'High likelihood'
    when avg(case when ntr_m >= t then 1 else 0 end)*100 >= 35 then 'Moderate — stretch' else 'Low — heroic assumptions' end as feasibility
from ssims, (select floor(b*1.05::double+0.5) as t from base) group by scenario_id, t""", ",\n".join([_INPUTS, _SAVED, _SDRAWS, _PROF, _SSIMS])))
def q_feasibility(spark, sf_dir):
    """Feasibility of all saved scenarios against their targets, under common random draws."""
    _, profile, inputs = setup(spark, sf_dir)
    return shown(X.scenario_feasibility(scenarios(spark, sf_dir), profile, inputs), p10=5, p50=5, p90=5)


# versioned store and comparison view ------------------------------------------------------------------

_FINAL = """saved as (select s.scenario_id, s.scenario_name, 'analyst ' || cast(n_regionkey as varchar) as created_by, s.created_at,
  case when n_nationkey % 3 = 1 then 400.0::double + n_nationkey end as target_ntr_m,
  case when n_nationkey % 5 = 1 then 0.85::double else load_factor_override end as load_factor_override,
  gross_per_diem_override, discount_rate_override, commission_rate_override, air_inclusive_pct_override, promo_cost_override,
  case when n_nationkey % 5 = 1 then 'revised' else concat('note on ', n_name) end as notes
  from saved0 s join nation on s.scenario_id = concat('S', n_nationkey) where n_nationkey <> 24)"""
_FEAS = """feas as (select scenario_id, avg(case when ntr_m >= coalesce(target_ntr_m, t) then 1 else 0 end)*100 as f
  from ssims join saved using (scenario_id), (select floor(b*1.05::double+0.5) as t from base) group by scenario_id)"""


def _saved_versions(spark, sf_dir, path):
    """Version 1 of the stand-in scenarios with author, target and notes; an edit of every fifth; one deleted."""
    from fairlead.sources import store
    from fairlead.sources.standin import table

    k = F.col("n_nationkey")
    extra = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("S"), k.cast("string")).alias("scenario_id"), F.concat(F.lit("analyst "), F.col("n_regionkey").cast("string")).alias("created_by"),
        F.when(k % 3 == 1, k + 400.0).alias("target_ntr_m"), F.concat(F.lit("note on "), F.col("n_name")).alias("notes"), (k % 5 == 1).alias("_edit"),
        (k == 24).alias("_gone"))
    store.save_scenario_versions(scenarios(spark, sf_dir).join(extra.drop("_edit", "_gone"), "scenario_id"), path)
    newest = settle(store.newest_scenarios(spark, path).join(extra.select("scenario_id", "_edit", "_gone"), "scenario_id"), "scenario-edit")
    store.save_scenario_versions(newest.where("_edit").withColumns(
        {"load_factor_override": F.lit(0.85), "notes": F.lit("revised")}).drop("_edit", "_gone"), path)
    store.delete_scenarios(newest.where("_gone"), path)


@query("v_scenario_comparison", with_ctes("monthly future fcst", f"""
select scenario_id, scenario_name, created_by, created_at, {rc('target_ntr_m')}, {r('n', 5)} as scenario_ntr_m, {r('f')} as feasibility_pct,
  {r('v', 5)} as baseline_ntr_m, {r('n-v', 5)} as delta_vs_baseline_m, {r(fr('(n-v)/nullif(v, 0)*100', 1))} as pct_vs_baseline, {_OV}, notes
from saved join batch using (scenario_id) join feas using (scenario_id), (select sum(net_ticket_revenue)/1e6 as v from vw)
order by created_at desc""", ",\n".join([_VIEW, _INPUTS, _SAVED.replace("saved as (", "saved0 as (", 1), _FINAL, _BATCH, _SDRAWS, _PROF,
                                          _SSIMS, _FEAS])))
def q_scenario_store(spark, sf_dir):
    """Saved, edited and deleted scenarios; revenue and feasibility written back; compacted; the named comparison view."""
    from fairlead.plans.scenarios import register_scenario_views, write_back
    from fairlead.session import fresh_path
    from fairlead.sources import store

    path = fresh_path(spark, "walk-to-target-runs")
    _saved_versions(spark, sf_dir, path)
    fc, profile, inputs = setup(spark, sf_dir)
    write_back(spark, path, fc, profile, inputs)
    store.compact_scenarios(spark, path)
    register_scenario_views(spark, path, view(spark, sf_dir))
    return shown(spark.sql("select * from v_scenario_comparison"), scenario_ntr_m=5, baseline_ntr_m=5, delta_vs_baseline_m=5)
