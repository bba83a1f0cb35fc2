"""Report queries over history and baseline forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.catalog.base import forecast, shown
from fairlead.catalog.registry import query
from fairlead.catalog.sqltext import fr, month, r, rc, with_ctes
from fairlead.functions import scalar as S
from fairlead.operators import reports as R
from fairlead.operators.baseline import baseline_forecast
from fairlead.operators.waterfall import waterfall_steps
from fairlead.sources.standin import future, history

BRANDS, TRADES = ["AMERICA", "ASIA", "EUROPE"], ["1-URGENT", "2-HIGH", "5-LOW"]
_IN = "brand in ('AMERICA', 'ASIA', 'EUROPE') and trade in ('1-URGENT', '2-HIGH', '5-LOW')"


def both(spark, sf_dir):
    hist, fut = history(spark, sf_dir), future(spark, sf_dir)
    return hist, baseline_forecast(hist, fut)


def thousands(e):
    return f"format('{{:,}}', cast({e} as bigint))"


def dollars(e):
    return f"'$' || {thousands(f'floor({e}+0.5)')}"


def percent(e):
    return f"printf('%.1f%%', {fr(f'({e})*100::double', 1)})"


def millions(e):
    tenths = f"cast(floor(({e})/1000000::double*10+0.5) as bigint)"
    return f"'$' || format('{{:,}}', {tenths}//10) || '.' || ({tenths}%10) || 'M'"


def billions(e):
    return f"printf('$%.2fB', {fr(f'({e})/1000000000::double', 2)})"


_FIG = """fig as (select
  sum(case when departure_date >= (select max(departure_date) from {h}) - interval 12 month then net_ticket_revenue end)
    as ntr_last12,
  avg(load_factor) as hist_load_factor, avg(gross_fare_per_diem) as hist_per_diem, count(*) as n_history,
  count(*) filter (departure_date >= (select max(departure_date) from {h}) - interval 12 month) as n_last12 from {h})"""


@query("kpi_last12", with_ctes("hist", f"select {rc('ntr_last12', 2)}, n_last12 from fig", _FIG.format(h="hist")))
def q_last12(spark, sf_dir):
    return shown(R.history_figures(history(spark, sf_dir)).select("ntr_last12", "n_last12"))


@query("kpi_landing", with_ctes("fcst", f"""
select {rc('ntr_last12', 2)}, {rc('hist_load_factor')}, {rc('hist_per_diem')}, n_history, n_last12,
  {rc('ntr_forecast', 2)}, n_future, {billions('ntr_last12')} as ntr_last12_text,
  {billions('ntr_forecast')} as ntr_forecast_text, {percent('hist_load_factor')} as load_factor_text,
  {dollars('hist_per_diem')} as per_diem_text, {thousands('n_history')} as n_history_text
from fig, (select sum(net_ticket_revenue) as ntr_forecast, count(*) as n_future from fcst)""", _FIG.format(h="hist")))
def q_landing(spark, sf_dir):
    return shown(R.kpi_landing(*both(spark, sf_dir)))


@query("kpi_dashboard", with_ctes("fcst", f"""
select {rc('total_ntr', 2)}, {rc('total_gross', 2)}, {rc('avg_load_factor')}, {rc('avg_per_diem')},
  {r('ntr_last12', 2)} as prior_ntr,
  {r('coalesce((total_ntr-ntr_last12)/nullif(ntr_last12, 0)*100, 0)')} as ntr_delta_pct,
  {r('total_ntr/nullif(total_gross, 0)*100')} as net_yield_pct,
  {r('(avg_load_factor-hist_load_factor)*100')} as load_factor_pp, {r('avg_per_diem-hist_per_diem')} as per_diem_delta
from fig, (select sum(net_ticket_revenue) as total_ntr, sum(gross_ticket_revenue) as total_gross,
  avg(load_factor) as avg_load_factor, avg(gross_fare_per_diem) as avg_per_diem from fcst where {_IN})""",
    f"hf as (select * from hist where {_IN}), " + _FIG.format(h="hf")))
def q_dashboard(spark, sf_dir):
    return shown(R.kpi_dashboard(*both(spark, sf_dir), BRANDS, TRADES))


@query("dashboard_filtered", with_ctes("fcst", f"""
select sailing_id, brand, trade, departure_date, {rc('load_factor')}, {rc('net_ticket_revenue', 2)}
from fcst where {_IN}"""))
def q_filtered(spark, sf_dir):
    return shown(R.by_brand_and_trade(forecast(spark, sf_dir), BRANDS, TRADES).select(
        "sailing_id", "brand", "trade", "departure_date", "load_factor", "net_ticket_revenue"))


_M = month("departure_date")


@query("ntr_monthly", with_ctes("fcst", f"""
select 'actual' as kind, {_M} as month, {r('sum(net_ticket_revenue)', 2)} as ntr from hist group by all union all
select 'forecast', {_M}, {r('sum(net_ticket_revenue)', 2)} from fcst group by all"""))
def q_ntr_monthly(spark, sf_dir):
    return shown(R.ntr_monthly(*both(spark, sf_dir)))


@query("prior_year_compare", with_ctes("fcst", f"""
select f.month, cast(f.month - interval 12 month as date) as prior_month, {r('v', 2)} as ntr, {r('p', 2)} as prior_ntr,
  {r('v*0.95::double', 2)} as compare_ntr, {r('(v-p)/nullif(p, 0)*100')} as delta_pct
from (select {_M} as month, sum(net_ticket_revenue) as v from fcst group by all) f
left join (select {_M} as month, sum(net_ticket_revenue) as p from hist group by all) h
  on h.month = f.month - interval 12 month"""))
def q_prior(spark, sf_dir):
    return shown(R.prior_year_compare(*both(spark, sf_dir)))


_PRESETS = "(values ('Base Case', 'baseline', 1.0), ('CFO Target', 'stretch', 1.08), ('Conservative', 'downside', 0.93)) p(name, tag, f)"


@query("compare_targets", with_ctes("fcst", f"""
select month, name, tag, {r('v*f::double', 2)} as ntr
from (select {_M} as month, sum(net_ticket_revenue) as v from fcst group by all), {_PRESETS}"""))
def q_targets(spark, sf_dir):
    return shown(R.compare_targets(forecast(spark, sf_dir)))


@query("preset_scenarios", with_ctes("fcst", f"""
select name, tag, {r('v*f::double', 2)} as ntr from (select sum(net_ticket_revenue) as v from fcst), {_PRESETS}"""))
def q_presets(spark, sf_dir):
    return shown(R.preset_scenarios(forecast(spark, sf_dir)))


@query("ntr_by_brand", with_ctes("fcst", f"""
select brand, {r('v', 2)} as ntr, {r('v/sum(v) over ()')} as share
from (select brand, sum(net_ticket_revenue) as v from fcst group by brand)"""))
def q_by_brand(spark, sf_dir):
    return shown(R.ntr_by(forecast(spark, sf_dir), "brand"))


@query("ntr_by_trade", with_ctes("fcst", f"""
select trade, {r('v', 2)} as ntr, {r('v/sum(v) over ()')} as share
from (select trade, sum(net_ticket_revenue) as v from fcst group by trade) order by v"""))
def q_by_trade(spark, sf_dir):
    return shown(R.ntr_by(forecast(spark, sf_dir), "trade")).orderBy("ntr")


_PERIOD_SQL = {
    "month": "strftime(departure_date, '%Y-%m')",
    "quarter": "'Q' || quarter(departure_date) || ' ' || year(departure_date)",
    "trade": "trade", "brand": "brand", "ship": "ship_name",
}
_PT = """select {p} as {by}, count(sailing_id) as sailings, cast(sum(lower_berth_capacity) as bigint) as capacity,
  cast(sum(passengers_booked) as bigint) as passengers, avg(load_factor) as load_factor,
  avg(gross_fare_per_diem) as avg_per_diem, sum(gross_ticket_revenue) as gross_ticket_revenue,
  sum(net_ticket_revenue) as net_ticket_revenue from fcst group by 1"""


def _period(by):
    sql = with_ctes("fcst", f"""select {by}, sailings, capacity, passengers, {rc('load_factor')}, {rc('avg_per_diem')},
      {rc('gross_ticket_revenue', 2)}, {rc('net_ticket_revenue', 2)} from ({_PT.format(p=_PERIOD_SQL[by], by=by)})""")

    @query(f"period_table_{by}", sql)
    def q(spark, sf_dir):
        return shown(R.period_table(forecast(spark, sf_dir), by))


for _by in _PERIOD_SQL:
    _period(_by)


@query("period_table_formatted", with_ctes("fcst", f"""
select month, sailings, {thousands('capacity')} as capacity, {thousands('passengers')} as passengers,
  {percent('load_factor')} as load_factor, {dollars('avg_per_diem')} as avg_per_diem,
  {millions('gross_ticket_revenue')} as gross_ticket_revenue, {millions('net_ticket_revenue')} as net_ticket_revenue
from ({_PT.format(p=_PERIOD_SQL['month'], by='month')})"""))
def q_period_formatted(spark, sf_dir):
    return R.period_table_formatted(R.period_table(forecast(spark, sf_dir), "month"))


@query("waterfall_steps", with_ctes("fcst", f"""
select cast(step as bigint) as step, label, measure, {r('amount', 2)} as amount, {r('running_total', 2)} as running_total from (
  select step, label, measure, case measure when 'total' then net else delta end as amount,
    sum(delta) over (order by step) as running_total
  from (select sum(gross_ticket_revenue) as gross, sum(discount_amount) as disc, sum(promo_cost_total) as promo,
    sum(ta_commission) as comm, sum(air_cost_total) as air, sum(taxes_total) as tax, sum(net_ticket_revenue) as net
    from fcst), lateral (values (1, 'Gross Revenue', 'absolute', gross), (2, 'Discounts', 'relative', -disc),
      (3, 'Promo Costs', 'relative', -promo), (4, 'TA Commission', 'relative', -comm), (5, 'Air Costs', 'relative', -air),
      (6, 'Taxes & Fees', 'relative', -tax), (7, 'Net Ticket Revenue', 'total', 0)) w(step, label, measure, delta))"""))
def q_steps(spark, sf_dir):
    return shown(waterfall_steps(forecast(spark, sf_dir)))


_ORDER = "order by departure_date, sailing_id limit 50"


@query("preview_history", with_ctes("hist", f"""
select sailing_id, ship_name, brand, trade, departure_date, lower_berth_capacity, passengers_booked,
  {percent('load_factor')} as load_factor, {dollars('gross_fare_per_diem')} as gross_fare_per_diem,
  {dollars('gross_ticket_revenue')} as gross_ticket_revenue, {dollars('net_ticket_revenue')} as net_ticket_revenue
from hist {_ORDER}"""))
def q_preview_history(spark, sf_dir):
    return R.preview(history(spark, sf_dir), [
        "sailing_id", "ship_name", "brand", "trade", "departure_date", "lower_berth_capacity", "passengers_booked",
        "load_factor", "gross_fare_per_diem", "gross_ticket_revenue", "net_ticket_revenue"], R.PREVIEW_FORMATS)


@query("preview_future", with_ctes("future", f"""
select sailing_id, ship_name, brand, trade, departure_date, itinerary_length,
  {thousands('lower_berth_capacity')} as lower_berth_capacity, season from future {_ORDER}"""))
def q_preview_future(spark, sf_dir):
    return R.preview(future(spark, sf_dir), [
        "sailing_id", "ship_name", "brand", "trade", "departure_date", "itinerary_length", "lower_berth_capacity",
        "season"], {"lower_berth_capacity": S.fmt_thousands})


@query("preview_forecast", with_ctes("fcst", f"""
select sailing_id, ship_name, brand, trade, departure_date, {percent('load_factor')} as load_factor,
  {dollars('gross_fare_per_diem')} as gross_fare_per_diem, {dollars('gross_ticket_revenue')} as gross_ticket_revenue,
  {dollars('net_ticket_revenue')} as net_ticket_revenue from fcst {_ORDER}"""))
def q_preview_forecast(spark, sf_dir):
    return R.preview(forecast(spark, sf_dir), [
        "sailing_id", "ship_name", "brand", "trade", "departure_date", "load_factor", "gross_fare_per_diem",
        "gross_ticket_revenue", "net_ticket_revenue"], R.PREVIEW_FORMATS)
