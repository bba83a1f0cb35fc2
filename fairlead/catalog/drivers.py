"""Queries on tables, drivers and the baseline forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.catalog.base import forecast, monthly, shown
from fairlead.catalog.registry import CENTS, query
from fairlead.catalog.sqltext import fr, month, r, rc, season, steps, with_ctes
from fairlead.constants import ALL_DRIVERS, AMOUNTS, OVERRIDABLE, RATES
from fairlead.functions import scalar as S
from fairlead.operators import drivers as D
from fairlead.operators.baseline import FALLBACK_LEVELS, baseline_forecast, seasonal_medians
from fairlead.operators.waterfall import waterfall, waterfall_summary
from fairlead.sources.standin import AS_OF, facts, future, history

FACT_KEYS = "sailing_id, ship_name, ship_class, brand, trade, itinerary_length, departure_date, lower_berth_capacity"
FCST_COLUMNS = ("departure_month, season, forecast_month, passengers_booked, "
                + ", ".join(rc(d) for d in ALL_DRIVERS) + ", " + ", ".join(rc(a, 2) for a in AMOUNTS))


@query("facts_history", with_ctes("hist", "select * from hist"))
def facts_history(spark, sf_dir):
    return history(spark, sf_dir)


@query("facts_future", with_ctes("future", f"select {FACT_KEYS} from future"))
def facts_future(spark, sf_dir):
    return future(spark, sf_dir).drop("departure_month", "season")


@query("baseline_forecast", with_ctes("fcst", f"select {FACT_KEYS}, {FCST_COLUMNS} from fcst"))
def baseline(spark, sf_dir):
    return shown(forecast(spark, sf_dir))


_SHIP_LEVELS = [["ship_name", "trade", "season"], ["trade", "season"], []]
_FALLBACK = with_ctes("fcst", f"select {FACT_KEYS}, {FCST_COLUMNS} from fcst")
for _a, _b in (("med1 as (select trade, ship_class, season", "med1 as (select ship_name, trade, season"),
               ("f.ship_class = a.ship_class", "f.ship_name = a.ship_name")):
    _FALLBACK = _FALLBACK.replace(_a, _b)


@query("baseline_forecast_fallback", _FALLBACK)
def baseline_fallback(spark, sf_dir):
    return shown(baseline_forecast(history(spark, sf_dir), future(spark, sf_dir), _SHIP_LEVELS))


_MEDS = ", ".join(f"{d} as {d}_med" for d in ALL_DRIVERS)


@query("seasonal_medians", with_ctes("med1", f"select trade, ship_class, season, {_MEDS} from med1"))
def q_seasonal_medians(spark, sf_dir):
    return seasonal_medians(history(spark, sf_dir), FALLBACK_LEVELS[:1]).drop("level")


@query("seasonal_medians_sets", with_ctes("med1 med2 med0", f"""
select 0::bigint as level, trade, ship_class, season, {_MEDS} from med1 union all
select 1, trade, null, season, {_MEDS} from med2 union all
select 2, null, null, null, {_MEDS} from med0"""))
def q_seasonal_medians_sets(spark, sf_dir):
    return seasonal_medians(history(spark, sf_dir)).withColumn("level", F.col("level").cast("bigint"))


_MONTHLY = "month, brand, trade, ship_class, n_sailings, total_passengers, total_capacity, " + ", ".join(
    rc(c, CENTS.get(c, 6)) for c in ["load_factor", "gross_fare_per_diem", "gross_ticket_revenue", "net_ticket_revenue"] + RATES)


@query("monthly_drivers", with_ctes("monthly", f"select {_MONTHLY} from monthly"))
def q_monthly_drivers(spark, sf_dir):
    return shown(monthly(spark, sf_dir))


_DIST = []
for _c, (_p, _points, _std) in D.DISTRIBUTIONS.items():
    _DIST += [f"{r(f'quantile_cont({_c}, {q / 100})')} as {_p}_p{q}" for q in _points]
    _DIST += [f"{r(f'stddev_samp({_c})')} as {_p}_std"] if _std else []


@query("driver_distributions", with_ctes("monthly", f"""
select brand, trade, ship_class, {', '.join(_DIST)} from monthly group by all"""))
def q_driver_distributions(spark, sf_dir):
    return shown(D.driver_distributions(monthly(spark, sf_dir)))


_RATE_MEDIANS = ", ".join(f"{r(fr(f'median({c})', 9))} as {c}_base" for c in RATES)


@query("driver_medians", with_ctes("monthly", f"""
select brand, trade, ship_class, {_RATE_MEDIANS} from monthly group by all"""))
def q_driver_medians(spark, sf_dir):
    return shown(D.driver_medians(monthly(spark, sf_dir)))


_LABELS = {"load_factor": "Load Factor", "gross_fare_per_diem": "Gross Per Diem ($)", "discount_rate": "Discount Rate",
           "commission_rate": "Commission Rate", "air_inclusive_pct": "Air Inclusive %",
           "promo_cost_per_pax": "Promo Cost/Pax ($)"}
_STATS = " union all ".join(f"""
select '{d}' as driver, '{_LABELS[d]}' as label, avg({d}) as mean, stddev_samp({d}) as std,
  quantile_cont({d}, 0.10) as p10, quantile_cont({d}, 0.25) as p25, quantile_cont({d}, 0.50) as p50,
  quantile_cont({d}, 0.75) as p75, quantile_cont({d}, 0.90) as p90 from hist""" for d in OVERRIDABLE)


@query("driver_stats", with_ctes("hist", f"""
select driver, label, {', '.join(rc(c) for c in ['mean', 'std', 'p10', 'p25', 'p50', 'p75', 'p90'])} from ({_STATS})"""))
def q_driver_stats(spark, sf_dir):
    return shown(D.driver_stats(history(spark, sf_dir)))


_DISPLAY = f"""select {month('departure_date')} as month, brand, trade, avg(load_factor) as load_factor,
  avg(gross_fare_per_diem) as gross_fare_per_diem, sum(net_ticket_revenue) as net_ticket_revenue,
  count(sailing_id) as n_sailings from hist group by all"""


@query("monthly_display", with_ctes("hist", f"""
select month, brand, trade, n_sailings, {rc('load_factor')}, {rc('gross_fare_per_diem')}, {rc('net_ticket_revenue', 2)}
from ({_DISPLAY})"""))
def q_monthly_display(spark, sf_dir):
    return shown(D.monthly_display(history(spark, sf_dir)))


_BRANDS = ["AMERICA", "ASIA", "EUROPE"]


@query("brand_month_mean_of_means", with_ctes("hist", f"""
select brand, month, {r('avg(load_factor)')} as load_factor from ({_DISPLAY})
where brand in ('AMERICA', 'ASIA', 'EUROPE') group by all"""))
def q_brand_month_means(spark, sf_dir):
    return shown(D.brand_month_means(D.monthly_display(history(spark, sf_dir)), "load_factor", _BRANDS))


@query("monthly_latest_100", with_ctes("hist", f"""
select month, brand, trade, n_sailings, printf('%.1f%%', {fr('load_factor*100', 1)}) as load_factor,
  '$' || format('{{:,}}', cast(floor(gross_fare_per_diem+0.5) as bigint)) as gross_fare_per_diem,
  '$' || format('{{:,}}', cast(floor(net_ticket_revenue+0.5) as bigint)) as net_ticket_revenue
from ({_DISPLAY}) order by month desc, brand, trade limit 100"""))
def q_monthly_latest(spark, sf_dir):
    rows = D.monthly_display(history(spark, sf_dir)).orderBy(F.desc("month"), "brand", "trade").limit(100)
    return rows.withColumns({
        "load_factor": S.fmt_percent("load_factor"),
        "gross_fare_per_diem": S.fmt_dollars("gross_fare_per_diem"),
        "net_ticket_revenue": S.fmt_dollars("net_ticket_revenue"),
    })


# scalar functions over all sailings -------------------------------------------

@query("calendar_columns", with_ctes("facts", f"""
select sailing_id, {month('departure_date')} as month, cast(quarter(departure_date) as bigint) as quarter,
  cast(year(departure_date) as bigint) as year, {season('departure_date')} as season from facts"""))
def q_calendar(spark, sf_dir):
    d = F.col("departure_date")
    return facts(spark, sf_dir).select(
        "sailing_id", S.month_start(d).alias("month"), F.quarter(d).cast("bigint").alias("quarter"),
        F.year(d).cast("bigint").alias("year"), S.season(d).alias("season"))


@query("peak_flag", with_ctes("facts", """
select sailing_id, trade, departure_date, case trade
  when '1-URGENT' then month(departure_date) in (11,12,1,2,3,4)
  when '2-HIGH' then month(departure_date) between 5 and 10
  when '3-MEDIUM' then month(departure_date) between 5 and 9
  when '4-NOT SPECIFIED' then month(departure_date) between 6 and 8
  when '5-LOW' then month(departure_date) between 4 and 10 else false end as is_peak from facts"""))
def q_peak(spark, sf_dir):
    return facts(spark, sf_dir).select(
        "sailing_id", "trade", "departure_date", S.is_peak("departure_date", "trade").alias("is_peak"))


@query("distinct_trades", with_ctes("facts", "select distinct trade from facts"))
def q_trades(spark, sf_dir):
    return facts(spark, sf_dir).select("trade").distinct()


# waterfall variants over the history's own drivers -------------------------------

_WF = ("sailing_id, {pax} as passengers_booked, "
       "{gross} as gross_ticket_revenue, {disc} as discount_amount, {promo} as promo_cost_total, "
       "{comm} as ta_commission, {air} as air_cost_total, {tax} as taxes_total, {net} as net_ticket_revenue")


def _wf_cols(pax, extra="", dp=2):
    names = {n: r(n, dp) for n in ["gross", "disc", "promo", "comm", "air", "tax", "net"]}
    return _WF.format(pax=pax, **names) + extra


def _amounts(df, *extra):
    return shown(df.select("sailing_id", "passengers_booked", *AMOUNTS, *extra))


@query("waterfall_trunc", with_ctes("facts", f"select {_wf_cols('cast(pax as bigint)')} from t_wf",
                                    steps("t", "facts", "trunc(lower_berth_capacity*load_factor)").strip()))
def q_waterfall_trunc(spark, sf_dir):
    return _amounts(waterfall(facts(spark, sf_dir), pax_mode="trunc"))


_FIXED = {"load_factor": 0.55, "gross_fare_per_diem": 310.0, "discount_rate": 0.06}


@query("waterfall_override", with_ctes("facts", f"select {_wf_cols('cast(pax as bigint)')} from t_wf", """
fixed as (select * replace (0.55::double as load_factor, 310.0::double as gross_fare_per_diem,
  0.06::double as discount_rate) from facts),""" + steps("t", "fixed", "trunc(lower_berth_capacity*load_factor)")))
def q_waterfall_override(spark, sf_dir):
    return _amounts(waterfall(facts(spark, sf_dir), _FIXED, pax_mode="trunc"))


@query("waterfall_extended", with_ctes(
    "facts", f"select {_wf_cols('cast(pax as bigint)')}, {r('comm*commission_override_pct', 2)} as commission_override, "
             f"{r('pax/2*kicker_per_cabin', 2)} as kicker_total from t_wf",
    steps("t", "facts", "least(trunc(lower_berth_capacity*load_factor), trunc(lower_berth_capacity*1.15::double))",
          "-comm*commission_override_pct-pax/2*kicker_per_cabin").strip()))
def q_waterfall_extended(spark, sf_dir):
    df = waterfall(facts(spark, sf_dir), pax_mode="capped", extended=True)
    return _amounts(df, "commission_override", "kicker_total")


@query("waterfall_by_month", with_ctes("fcst", f"""
select forecast_month, brand, trade, {', '.join(f"{r(f'sum({a})', 2)} as {a}" for a in AMOUNTS)} from fcst group by all"""))
def q_waterfall_by_month(spark, sf_dir):
    return shown(waterfall_summary(forecast(spark, sf_dir)))


@query("monthly_drivers_incremental", with_ctes("monthly", f"select {_MONTHLY} from monthly"))
def q_monthly_incremental(spark, sf_dir):
    """The monthly drivers after three loads of the history, each folded in by a refresh."""
    from fairlead.plans.incremental import append_load, read_monthly, refresh_monthly
    from fairlead.session import fresh_path
    from fairlead.sources.standin import history

    loads, parts = fresh_path(spark, "sailing-loads"), fresh_path(spark, "monthly-parts")
    hist = history(spark, sf_dir)
    for k in range(3):
        append_load(hist.where(F.pmod(F.xxhash64("sailing_id"), F.lit(3)) == k), loads)
        refresh_monthly(spark, loads, parts)
    return shown(read_monthly(spark, parts))
