"""Queries on series, models, reconciliation, stored runs and the reporting view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from fairlead.catalog.base import monthly, shown
from fairlead.catalog.registry import query
from fairlead.catalog.sqltext import fr, month, r, rc, with_ctes
from fairlead.constants import AMOUNTS, DIMS, RATES
from fairlead.forecasting import evaluate as E
from fairlead.forecasting import models as M
from fairlead.forecasting import series as S
from fairlead.forecasting.reconcile import bottom_up, coherence, reconcile
from fairlead.functions import scalar as X
from fairlead.operators.drivers import driver_medians
from fairlead.operators.waterfall import waterfall_summary
from fairlead.plans.runs import assemble_forecast, baseline_view, month_before, run_forecast, uncovered_sailings, with_bands
from fairlead.plans.sqlsurface import register_functions, register_views
from fairlead.session import fresh_path, settle
from fairlead.sources import schemas, store
from fairlead.sources.sailings import read_history
from fairlead.sources.standin import AS_OF, facts, future, history, scenarios

LAST = month_before(AS_OF, 1)
CUTOFFS = [month_before(AS_OF, 13), month_before(AS_OF, 7)]
CV_HORIZON = 6
SIMPLE = list(M.SIMPLE_MODELS)
RUN_TS = f"{AS_OF} 04:00:00"

_SER = """ser as (
  select 'load_factor' as driver, concat_ws('/', brand, trade, ship_class) as unique_id, month as ds, load_factor as y
    from monthly where load_factor is not null union all
  select 'per_diem', concat_ws('/', brand, trade, ship_class), month, gross_fare_per_diem
    from monthly where gross_fare_per_diem is not null)"""


def _dense(cuts):
    """Series known at each cutoff (``sc``), dense (``dn``, numbered from 0) and its length."""
    values = ", ".join(f"(date '{c}')" for c in cuts)
    return _SER + f""",
cuts(c) as (values {values}),
sc as (select c, ser.* from ser, cuts where ds <= c),
grid as (select c, driver, unique_id, unnest(generate_series(min(ds), c, interval 1 month))::date as ds from sc group by 1, 2, 3),
mm as (select c, driver, unique_id, month(ds) as k, avg(y) as y from sc group by all),
ma as (select c, driver, unique_id, avg(y) as y from sc group by all),
dn as (select g.c, g.driver, g.unique_id, g.ds, coalesce(sc.y, mm.y, ma.y) as y, sc.y is null as filled,
    row_number() over (partition by g.c, g.driver, g.unique_id order by g.ds)-1 as i,
    count(*) over (partition by g.c, g.driver, g.unique_id) as n
  from grid g left join sc using (c, driver, unique_id, ds)
  left join mm on mm.c = g.c and mm.driver = g.driver and mm.unique_id = g.unique_id and mm.k = month(g.ds)
  join ma on ma.c = g.c and ma.driver = g.driver and ma.unique_id = g.unique_id),
hs as (select cast(h as bigint) as h from range(1, 13) x(h)),
ids as (select c, driver, unique_id, max(n) as n from dn group by 1, 2, 3),
lastv as (select c, driver, unique_id, arg_max(y, ds) as y from sc group by all),
monthv as (select c, driver, unique_id, month(ds) as k, arg_max(y, ds) as y from sc group by all),
sn as (select i.c, i.driver, i.unique_id, 'seasonal_naive' as model, h, cast(i.c + to_months(h::int) as date) as ds,
    coalesce(m.y, l.y) as yhat
  from ids i cross join hs
  left join monthv m on m.c = i.c and m.driver = i.driver and m.unique_id = i.unique_id
    and m.k = month(i.c + to_months(h::int))
  join lastv l on l.c = i.c and l.driver = i.driver and l.unique_id = i.unique_id),
dm as (select c, driver, unique_id, month(ds) as k, avg(y) as y from dn group by all),
da as (select c, driver, unique_id, avg(y) as y from dn group by all),
sm as (select i.c, i.driver, i.unique_id, 'seasonal_mean' as model, h, cast(i.c + to_months(h::int) as date) as ds,
    coalesce(m.y, l.y) as yhat
  from ids i cross join hs
  left join dm m on m.c = i.c and m.driver = i.driver and m.unique_id = i.unique_id
    and m.k = month(i.c + to_months(h::int))
  join da l on l.c = i.c and l.driver = i.driver and l.unique_id = i.unique_id),
z as (select a.c, a.driver, a.unique_id, a.i, a.n, a.y-b.y as z from dn a
  join dn b on a.c = b.c and a.driver = b.driver and a.unique_id = b.unique_id and b.i = a.i-12 where a.n >= 20),
fit as (select a.c, a.driver, a.unique_id, coalesce(covar_pop(a.z, b.z)/nullif(var_pop(b.z), 0), 0) as f1,
    avg(a.z) as ma, avg(b.z) as mb from z a
  join z b on a.c = b.c and a.driver = b.driver and a.unique_id = b.unique_id and b.i = a.i-1 group by all),
ar as (select f.c, f.driver, f.unique_id, f1, ma-f1*mb as f0, z as zn from fit f
  join z on z.c = f.c and z.driver = f.driver and z.unique_id = f.unique_id and z.i = z.n-1),
sr as (select i.c, i.driver, i.unique_id, 'sar1' as model, hs.h, sn.ds,
    case when ar.f1 is null then sn.yhat else
      d.y + pow(f1, hs.h)*zn + f0*case when f1 = 1 then hs.h else (1-pow(f1, hs.h))/(1-f1) end end as yhat
  from ids i cross join hs
  join sn on sn.c = i.c and sn.driver = i.driver and sn.unique_id = i.unique_id and sn.h = hs.h
  left join ar on ar.c = i.c and ar.driver = i.driver and ar.unique_id = i.unique_id
  left join dn d on d.c = i.c and d.driver = i.driver and d.unique_id = i.unique_id and d.i = i.n-12+hs.h-1)"""


_FINAL = _dense([LAST])
_CV = _dense(CUTOFFS) + f""",
err as (select f.driver, f.unique_id, c as cutoff, model, h, f.ds, yhat, ser.y, ser.y-yhat as error
  from (select * from sn union all select * from sm union all select * from sr) f
  join ser on ser.driver = f.driver and ser.unique_id = f.unique_id and ser.ds = f.ds where h <= {CV_HORIZON}),
ms as (select driver, unique_id, model, avg(abs(error)) as mae from err group by all),
mm2 as (select driver, model, avg(mae) as mae from ms group by all)"""


def series(spark, sf_dir):
    return S.series_long(monthly(spark, sf_dir))


def final_arrays(spark, sf_dir):
    return S.densify(S.series_arrays(series(spark, sf_dir)), LAST)


def naive(spark, sf_dir):
    """Forecasts of the seasonal naive model for all bottom series."""
    fitted = M.fit_models(final_arrays(spark, sf_dir), {"seasonal_naive": M.seasonal_naive})
    return M.forecasts_long(fitted, ["seasonal_naive"])


def cv_errors(spark, sf_dir):
    return E.rolling_origin_errors(settle(series(spark, sf_dir), "series"), M.SIMPLE_MODELS, CUTOFFS, CV_HORIZON)


# series ------------------------------------------------------------------------------

@query("series_long", with_ctes("monthly", f"select driver, unique_id, ds, {rc('y')} from ser", _SER))
def q_series(spark, sf_dir):
    return shown(series(spark, sf_dir))


@query("series_key_roundtrip", with_ctes("monthly", """
select distinct unique_id, split_part(unique_id, '/', 1) as brand, split_part(unique_id, '/', 2) as trade,
  split_part(unique_id, '/', 3) as ship_class from ser""", _SER))
def q_roundtrip(spark, sf_dir):
    return S.split_key(series(spark, sf_dir).select("unique_id").distinct())


_NODES = """nodes as (
  select driver, split_part(unique_id, '/', 1) as unique_id, 0::bigint as level, ds, y from ser union all
  select driver, split_part(unique_id, '/', 1) || '/' || split_part(unique_id, '/', 2), 1, ds, y from ser union all
  select driver, unique_id, 2, ds, y from ser)"""


@query("hierarchy_rollup", with_ctes("monthly", f"""
select driver, unique_id, level, ds, {r('sum(y)')} as y from nodes group by all""", _SER + ",\n" + _NODES))
def q_rollup(spark, sf_dir):
    df = S.rollup_series(series(spark, sf_dir))
    return shown(df.withColumn("level", F.col("level").cast("bigint")))


@query("hierarchy_total", with_ctes("monthly", f"""
select driver, 'Total' as unique_id, (-1)::bigint as level, ds, {r('sum(y)')} as y from ser group by all""", _SER))
def q_total(spark, sf_dir):
    df = S.rollup_series(series(spark, sf_dir), levels=[], total=True)
    return shown(df.withColumn("level", F.col("level").cast("bigint")))


@query("hierarchy_ratio", with_ctes("monthly", f"""
select unique_id, level, ds, {r('sum(p)/nullif(sum(c), 0)')} as load_factor, {r('sum(f)/nullif(sum(p), 0)')} as gross_fare_per_diem
from (select unnest([brand, brand || '/' || trade, brand || '/' || trade || '/' || ship_class]) as unique_id,
    unnest([0::bigint, 1, 2]) as level, month as ds, total_passengers as p, total_capacity as c,
    gross_fare_per_diem*total_passengers as f from monthly) group by all"""))
def q_ratio(spark, sf_dir):
    df = S.rollup_drivers(monthly(spark, sf_dir))
    return shown(df.withColumn("level", F.col("level").cast("bigint")))


@query("series_levels", with_ctes("monthly", f"""
select driver, unique_id, len(string_split(unique_id, '/'))-1 as depth, count(*) as n_months from nodes
where len(string_split(unique_id, '/')) = 3 group by all""", _SER + ",\n" + _NODES))
def q_levels(spark, sf_dir):
    bottom = S.bottom_only(S.rollup_series(series(spark, sf_dir)))
    return bottom.groupBy("driver", "unique_id", X.key_depth("unique_id").cast("bigint").alias("depth")).agg(
        F.count(F.lit(1)).alias("n_months"))


@query("hierarchy_s", with_ctes("monthly", """
select distinct unnest([split_part(unique_id, '/', 1), split_part(unique_id, '/', 1) || '/' || split_part(unique_id, '/', 2),
  unique_id]) as node, unnest([0::bigint, 1, 2]) as level, unique_id as bottom_id from ser""", _SER))
def q_summing(spark, sf_dir):
    return S.summing_table(series(spark, sf_dir)).withColumn("level", F.col("level").cast("bigint"))


@query("dense_grid", with_ctes("monthly", f"select driver, unique_id, ds, {rc('y')}, filled from dn", _FINAL))
def q_dense(spark, sf_dir):
    return shown(S.dense_grid(series(spark, sf_dir), LAST))


@query("horizon_index", with_ctes("facts", f"""
select sailing_id, cast((year(departure_date)*12+month(departure_date))-(2000*12+8)+1 as bigint) as horizon_month
from facts where (year(departure_date)*12+month(departure_date))-(2000*12+8)+1 between 1 and 12"""))
def q_horizon(spark, sf_dir):
    h = X.horizon_index("departure_date", F.lit(AS_OF).cast("date")).cast("bigint")
    return facts(spark, sf_dir).select("sailing_id", h.alias("horizon_month")).where(F.col("horizon_month").between(1, 12))


@query("seasonal_lag", with_ctes("monthly", f"""
select a.driver, a.unique_id, a.ds, {r('a.y')} as y, {r('b.y')} as y_last_year, {r('a.y-b.y')} as change from ser a
left join ser b on a.driver = b.driver and a.unique_id = b.unique_id and b.ds = a.ds - interval 12 month""", _SER))
def q_lag(spark, sf_dir):
    s = settle(series(spark, sf_dir), "series")
    before = s.select("driver", "unique_id", F.add_months("ds", 12).alias("ds"), F.col("y").alias("y_last_year"))
    df = s.join(before, ["driver", "unique_id", "ds"], "left")
    return shown(df.withColumn("change", F.col("y") - F.col("y_last_year")))


# models --------------------------------------------------------------------------------

@query("fc_seasonal_naive", with_ctes("monthly", f"select driver, unique_id, h, ds, {rc('yhat')} from sn", _FINAL))
def q_naive(spark, sf_dir):
    return shown(naive(spark, sf_dir).drop("model", "sigma", "width", "used"))


@query("fc_seasonal_mean", with_ctes("monthly", f"select driver, unique_id, h, ds, {rc('yhat')} from sm", _FINAL))
def q_mean(spark, sf_dir):
    fitted = M.fit_models(final_arrays(spark, sf_dir), {"seasonal_mean": M.seasonal_mean})
    return shown(M.forecasts_long(fitted, ["seasonal_mean"]).drop("model", "sigma", "width", "used"))


@query("fc_sar1", with_ctes("monthly", f"select driver, unique_id, h, ds, {rc('yhat')} from sr", _FINAL))
def q_sar1(spark, sf_dir):
    fitted = M.fit_models(final_arrays(spark, sf_dir), {"sar1": M.sar1})
    return shown(M.forecasts_long(fitted, ["sar1"]).drop("model", "sigma", "width", "used"))


@query("fc_ets_level", "with recursive " + with_ctes("monthly", f"""
select driver, unique_id, h, cast(date '{LAST}' + to_months(h::int) as date) as ds, {r('l')} as yhat from (
  select driver, unique_id, arg_min(l, (sse, a)) as l from walk where i = n-1 group by 1, 2), hs""", _FINAL + """,
walk(driver, unique_id, i, n, a, l, sse) as (
  select driver, unique_id, i, n, k/20::double, y, 0::double from dn, range(1, 20) g(k) where i = 0
  union all
  select w.driver, w.unique_id, d.i, w.n, a, l+a*(d.y-l), sse+(d.y-l)*(d.y-l) from walk w
  join dn d on d.driver = w.driver and d.unique_id = w.unique_id and d.i = w.i+1)""")[len("with "):])
def q_ets_level(spark, sf_dir):
    fitted = M.fit_models(final_arrays(spark, sf_dir), {"ets_level": M.ets_level})
    return shown(M.forecasts_long(fitted, ["ets_level"]).drop("model", "sigma", "width", "used"))


def _auto(name, model):
    @query(name)
    def q(spark, sf_dir):
        fitted = M.fit_models(final_arrays(spark, sf_dir), {"auto": model})
        return shown(M.forecasts_long(fitted, ["auto"]).drop("model", "width", "used"))


_auto("fc_ets_auto", M.ets)
_auto("fc_sar_auto", M.sar)
_auto("fc_ces", M.ces)


def drift(pdf: pd.DataFrame) -> pd.DataFrame:
    """A user's model: straight line through the first and the last point."""
    pdf = pdf.sort_values("ds")
    y, n = pdf["y"].to_numpy(), len(pdf)
    slope = (y[-1] - y[0]) / (n - 1) if n > 1 else 0.0
    last = pd.Timestamp(pdf["ds"].iloc[-1])
    h = range(1, 13)
    return pd.DataFrame({
        "driver": pdf["driver"].iloc[0], "unique_id": pdf["unique_id"].iloc[0], "h": list(h),
        "ds": [(last + pd.DateOffset(months=k)).date() for k in h], "yhat": [y[-1] + slope * k for k in h]})


@query("fc_custom_model", with_ctes("monthly", f"""
select driver, unique_id, h, cast(l + to_months(h::int) as date) as ds, {r('b+case when n > 1 then (b-a)/(n-1) else 0 end*h')} as yhat
from (select driver, unique_id, count(*) as n, max(ds) as l, arg_min(y, ds) as a, arg_max(y, ds) as b from ser group by 1, 2),
  (select cast(h as bigint) as h from range(1, 13) x(h))""", _SER))
def q_custom(spark, sf_dir):
    return shown(M.custom_model(series(spark, sf_dir), drift))


_SIGMA = """sg as (select a.driver, a.unique_id, sqrt(sum((a.y-b.y)*(a.y-b.y))/count(*)) as sigma from dn a
  join dn b on a.driver = b.driver and a.unique_id = b.unique_id
    and b.i = a.i-case when a.n > 12 then 12 else 1 end group by 1, 2)"""


@query("fc_interval_gauss", with_ctes("monthly", f"""
select driver, unique_id, h, ds, {rc('yhat')}, {r('yhat-1.2815515655446004::double*sigma*sqrt(floor((h-1)/12)+1)')} as lo,
  {r('yhat+1.2815515655446004::double*sigma*sqrt(floor((h-1)/12)+1)')} as hi
from sn left join sg using (driver, unique_id)""", _FINAL + ",\n" + _SIGMA))
def q_gauss(spark, sf_dir):
    return shown(E.gaussian_interval(naive(spark, sf_dir)).drop("model", "sigma", "width", "used"))


_CONF = _CV + f""",
wd as (select driver, unique_id, model, quantile_cont(abs(error), 0.8) as w from err group by all),
snf as (select i.driver, i.unique_id, h, cast(date '{LAST}' + to_months(h::int) as date) as ds, coalesce(m.y, l.y) as yhat
  from (select driver, unique_id, max(ds) as d from ser group by 1, 2) i cross join hs
  left join (select driver, unique_id, month(ds) as k, arg_max(y, ds) as y from ser group by all) m
    on m.driver = i.driver and m.unique_id = i.unique_id and m.k = month(date '{LAST}' + to_months(h::int))
  join (select driver, unique_id, arg_max(y, ds) as y from ser group by all) l on l.driver = i.driver and l.unique_id = i.unique_id)"""


@query("fc_interval_conformal", with_ctes("monthly", f"""
select snf.driver, snf.unique_id, h, ds, {rc('yhat')}, {r('yhat-w')} as lo, {r('yhat+w')} as hi from snf
left join wd on wd.driver = snf.driver and wd.unique_id = snf.unique_id and wd.model = 'seasonal_naive'""", _CONF))
def q_conformal(spark, sf_dir):
    s = settle(series(spark, sf_dir), "series")
    errors = E.rolling_origin_errors(s, M.SIMPLE_MODELS, CUTOFFS, CV_HORIZON)
    fitted = M.fit_models(S.densify(S.series_arrays(s), LAST), {"seasonal_naive": M.seasonal_naive})
    fc = M.forecasts_long(fitted, ["seasonal_naive"])
    return shown(E.conformal_interval(fc, errors).drop("model", "sigma", "width", "used"))


_TIERS = {"series": "unique_id", "parent": "parent", "driver": None}
_CONFH = _CONF + """,
ce as (select driver, model, unique_id, regexp_replace(unique_id, '/[^/]*$', '') as parent, h, abs(error) as v from err),
lv as (select unnest([0.8::double, 0.95::double]) as lvl),""" + ",".join(f"""
w_{t} as (select lvl, driver, model, {k + ', ' if k else ''}h, case when ceil((count(*)+1)*lvl) <= count(*)
  then list(v order by v)[ceil((count(*)+1)*lvl)::int] end as w from ce, lv group by lvl, driver, model, {k + ', ' if k else ''}h)"""
    for t, k in _TIERS.items())


@query("fc_interval_conformal_h", with_ctes("monthly", f"""
select driver, unique_id, h, ds, {rc('yhat')}, lvl as interval_level, {r('yhat-coalesce(s.w, p.w, d.w)')} as lo,
  {r('yhat+coalesce(s.w, p.w, d.w)')} as hi,
  case when s.w is not null then 'series' when p.w is not null then 'parent' when d.w is not null then 'driver' end as interval_tier
from (select *, regexp_replace(unique_id, '/[^/]*$', '') as parent from snf) f cross join lv
left join w_series s using (lvl, driver, unique_id, h) left join w_parent p using (lvl, driver, parent, h)
left join w_driver d using (lvl, driver, h)
where coalesce(s.model, 'seasonal_naive') = 'seasonal_naive' and coalesce(p.model, 'seasonal_naive') = 'seasonal_naive'
  and coalesce(d.model, 'seasonal_naive') = 'seasonal_naive'""", _CONFH))
def q_conformal_h(spark, sf_dir):
    """Conformal intervals of the seasonal naive forecasts per step, at 80 and 95 %, with back-off."""
    s = settle(series(spark, sf_dir), "series")
    errors = settle(E.rolling_origin_errors(s, M.SIMPLE_MODELS, CUTOFFS, CV_HORIZON).select(
        "driver", "unique_id", "model", "h", "error"), "errors")
    fitted = M.fit_models(S.densify(S.series_arrays(s), LAST), {"seasonal_naive": M.seasonal_naive})
    fc = M.forecasts_long(fitted, ["seasonal_naive"])
    both = E.conformal_by_horizon(fc, errors, 0.8).unionByName(E.conformal_by_horizon(fc, errors, 0.95))
    return shown(both.select("driver", "unique_id", "h", "ds", "yhat", "interval_level", "lo", "hi", "interval_tier"))


@query("forecast_errors", with_ctes("monthly", f"""
select driver, unique_id, cutoff, model, h, ds, {rc('yhat')}, {rc('y')}, {rc('error')} from err""", _CV))
def q_errors(spark, sf_dir):
    return shown(cv_errors(spark, sf_dir).drop("sigma", "width", "used"))


@query("model_mae", with_ctes("monthly", f"select driver, model, {rc('mae')} from mm2", _CV))
def q_mae(spark, sf_dir):
    return shown(E.model_mae(cv_errors(spark, sf_dir)))


_RANK = "case model when 'seasonal_naive' then 1 when 'seasonal_mean' then 2 else 3 end"


@query("best_model", with_ctes("monthly", f"""
select driver, arg_min(model, (mae, {_RANK})) as model, {r('min(mae)')} as mae from mm2 group by 1""", _CV))
def q_best(spark, sf_dir):
    return shown(E.best_model(E.model_mae(cv_errors(spark, sf_dir)), SIMPLE))


_BY_TRADE = "select driver, split_part(unique_id, '/', 2) as trade, " + ", ".join(
    f"avg(abs(error)) filter (model = '{m}') as {m}" for m in SIMPLE) + " from err group by 1, 2"


@query("cv_mae_by_trade", with_ctes("monthly", f"""
select driver, trade, {', '.join(rc(m) for m in SIMPLE)} from ({_BY_TRADE})""", _CV))
def q_by_trade(spark, sf_dir):
    return shown(E.mae_by_trade(cv_errors(spark, sf_dir), SIMPLE))


@query("model_accuracy_best", with_ctes("monthly", f"""
select driver, trade, {', '.join(rc(m) for m in SIMPLE)}, {r(f"least({', '.join(SIMPLE)})")} as best_mae,
  case least({', '.join(SIMPLE)}) {' '.join(f"when {m} then '{m}'" for m in SIMPLE)} end as best_model
from ({_BY_TRADE})""", _CV))
def q_accuracy(spark, sf_dir):
    return shown(E.mark_best(E.mae_by_trade(cv_errors(spark, sf_dir), SIMPLE), SIMPLE))


# reconciliation ---------------------------------------------------------------------------

@query("reconcile_bottom_up", with_ctes("monthly", f"""
select driver, unique_id, level, ds, {r('sum(yhat)')} as yhat from (
  select driver, split_part(unique_id, '/', 1) as unique_id, 0::bigint as level, ds, yhat from sn union all
  select driver, split_part(unique_id, '/', 1) || '/' || split_part(unique_id, '/', 2), 1, ds, yhat from sn union all
  select driver, unique_id, 2, ds, yhat from sn) group by all""", _FINAL))
def q_bottom_up(spark, sf_dir):
    s = settle(series(spark, sf_dir), "series")
    fitted = M.fit_models(S.densify(S.series_arrays(s), LAST), {"seasonal_naive": M.seasonal_naive})
    df = bottom_up(M.forecasts_long(fitted, ["seasonal_naive"]), S.summing_table(s))
    return shown(df.withColumn("level", F.col("level").cast("bigint")))


def mint(spark, sf_dir):
    """Level forecasts of the yearly autoregression, reconciled."""
    bottom = settle(S.dense_grid(series(spark, sf_dir), LAST).drop("filled"), "bottom")
    summing = settle(S.summing_table(bottom), "summing")
    fitted = M.fit_models(S.densify(S.series_arrays(S.rollup_series(bottom)), LAST), {"sar1": M.sar1})
    fitted = settle(fitted.drop("pts", "ys"), "fitted")
    return reconcile(M.forecasts_long(fitted, ["sar1"]), M.residuals_long(fitted, "sar1"), summing), summing


@query("reconcile_mint")
def q_mint(spark, sf_dir):
    df, _ = mint(spark, sf_dir)
    return shown(df.withColumn("level", F.col("level").cast("bigint")))


@query("reconcile_coherence", with_ctes("monthly", """
select driver, level, count(distinct unique_id) as n_nodes, 0::bigint as n_incoherent from nodes group by 1, 2""",
                                        _SER + ",\n" + _NODES))
def q_coherence(spark, sf_dir):
    df, summing = mint(spark, sf_dir)
    return coherence(df, summing).withColumn("level", F.col("level").cast("bigint"))


# runs --------------------------------------------------------------------------------------

_LO, _HI = "case when driver = 'load_factor' then 0.97::double else 0.95::double end", "case when driver = 'load_factor' then 1.03::double else 1.05::double end"


@query("forecast_bands", with_ctes("monthly", f"""
select driver, unique_id, ds, {rc('yhat')}, {r(f'yhat*{_LO}')} as lo, {r(f'yhat*{_HI}')} as hi from sn""", _FINAL))
def q_bands(spark, sf_dir):
    return shown(with_bands(naive(spark, sf_dir).select("driver", "unique_id", "ds", "yhat")))


def naive_results(spark, sf_dir, as_of=AS_OF):
    """Result rows of a run with the seasonal naive model; settled monthly drivers are read twice."""
    m = settle(monthly(spark, sf_dir) if as_of == AS_OF else _monthly_at(spark, sf_dir, as_of), "monthly")
    dense = S.densify(S.series_arrays(S.series_long(m)), month_before(as_of, 1))
    fitted = M.fit_models(dense, {"seasonal_naive": M.seasonal_naive})
    fc = E.gaussian_interval(M.forecasts_long(fitted, ["seasonal_naive"]))
    return assemble_forecast(fc, driver_medians(m), as_of, as_of, run_ts=RUN_TS)


def _monthly_at(spark, sf_dir, as_of):
    from fairlead.operators.drivers import monthly_drivers
    return monthly_drivers(history(spark, sf_dir, as_of))


_BASE = ", ".join(f"{fr(f'median({c})', 9)} as {c}_base" for c in RATES)
_RES = _FINAL + ",\n" + _SIGMA + f""",
bd as (select sn.*, yhat-1.2815515655446004::double*sigma as lo, yhat+1.2815515655446004::double*sigma as hi
  from sn left join sg using (driver, unique_id)),
bd2 as (select * replace (coalesce(lo, yhat*{_LO}) as lo, coalesce(hi, yhat*{_HI}) as hi) from bd),
md as (select brand, trade, ship_class, {_BASE} from monthly group by all),
res as (select '{AS_OF}' as run_id, timestamp '{AS_OF} 04:00:00' as run_ts, a.ds as forecast_date,
  split_part(a.unique_id, '/', 1) as brand, split_part(a.unique_id, '/', 2) as trade,
  split_part(a.unique_id, '/', 3) as ship_class, cast(a.h as integer) as horizon_month,
  a.yhat as load_factor_fcst, a.lo as load_factor_lo80, a.hi as load_factor_hi80,
  b.yhat as gross_per_diem_fcst, b.lo as gross_per_diem_lo80, b.hi as gross_per_diem_hi80,
  {', '.join(f'{c}_base' for c in RATES)}, a.model as model_lf, b.model as model_pd
  from bd2 a left join bd2 b on b.driver = 'per_diem' and a.unique_id = b.unique_id and a.ds = b.ds
  left join md on md.brand = split_part(a.unique_id, '/', 1) and md.trade = split_part(a.unique_id, '/', 2)
    and md.ship_class = split_part(a.unique_id, '/', 3)
  where a.driver = 'load_factor' and a.h between 1 and 12)"""
_RES_KEYS = "run_id, run_ts, forecast_date, brand, trade, ship_class, horizon_month, model_lf, model_pd"
_RES_VALUES = ", ".join(rc(f.name) for f in schemas.RESULTS.fields if f.dataType.typeName() == "double")


@query("assemble_forecast", with_ctes("monthly", f"select {_RES_KEYS}, {_RES_VALUES} from res", _RES))
def q_assemble(spark, sf_dir):
    return shown(naive_results(spark, sf_dir))


def stored_results(spark, sf_dir):
    """Results of the current run, written to a result table and read back."""
    path = fresh_path(spark, "forecast_results")
    store.append_results(naive_results(spark, sf_dir), path)
    return store.read_results(spark, path)


@query("run_summary", with_ctes("monthly", """
select 'success' as status, max(run_id) as run_id, count(*) as rows_written, max(horizon_month)::bigint as horizon_months from res""", _RES))
def q_summary(spark, sf_dir):
    return store.append_results(naive_results(spark, sf_dir), fresh_path(spark, "forecast_results"))


def two_runs(spark, sf_dir):
    """Two runs appended to one table: the month before and the current one."""
    path = fresh_path(spark, "forecast_results")
    for as_of in (month_before(AS_OF, 1), AS_OF):
        store.append_results(naive_results(spark, sf_dir, as_of), path)
    return store.read_results(spark, path)


_COUNTS = f"""select '{AS_OF}' as run_id, count(*)*12 as n_rows from (select distinct brand, trade, ship_class
  from monthly where load_factor is not null)"""


@query("forecast_append_readback", with_ctes("monthly", f"""
{_COUNTS} union all select '{month_before(AS_OF, 1)}', count(*)*12 from (select distinct brand, trade, ship_class
  from monthly where load_factor is not null and month < date '{LAST}')"""))
def q_readback(spark, sf_dir):
    return two_runs(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("run_publish", with_ctes("monthly", f"""
select run_id, n_rows, case when run_id = '{AS_OF}' then 2 else 1 end::bigint as n_publications from (
{_COUNTS} union all select '{month_before(AS_OF, 1)}', count(*)*12 from (select distinct brand, trade, ship_class
  from monthly where load_factor is not null and month < date '{LAST}'))"""))
def q_publish(spark, sf_dir):
    """Two runs published, the current one twice; an aborted and a rejected run leave no trace."""
    from pyspark.errors import PySparkException

    path = fresh_path(spark, "forecast_results")
    current = naive_results(spark, sf_dir, AS_OF)
    for run in (naive_results(spark, sf_dir, month_before(AS_OF, 1)), current, current):
        store.publish_run(run, path)
    aborted = current.withColumns({"run_id": F.lit("aborted"), "brand": F.when(
        F.col("horizon_month") == 3, F.raise_error(F.lit("run aborted"))).otherwise(F.col("brand"))})
    try:
        store.publish_run(aborted, path)
    except PySparkException as error:
        if "run aborted" not in str(error):
            raise
    store.publish_run(current.withColumns({"run_id": F.lit("rejected"), "brand": F.when(
        F.col("horizon_month") == 1, F.lit(None)).otherwise(F.col("brand"))}), path)
    rows = store.read_published(spark, path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    lines = store.read_manifest(spark, path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_publications"))
    return rows.join(lines, "run_id", "full")


@query("latest_run", with_ctes("monthly", f"select {_RES_KEYS}, {_RES_VALUES} from res", _RES))
def q_latest(spark, sf_dir):
    return shown(store.latest_run(two_runs(spark, sf_dir)))


@query("forecast_run")
def q_run(spark, sf_dir):
    path = fresh_path(spark, "forecast_results")
    store.append_results(run_forecast(monthly(spark, sf_dir), AS_OF, AS_OF, run_ts=RUN_TS), path)
    return shown(store.read_results(spark, path))


# reporting view -----------------------------------------------------------------------------

_VIEW = _RES + f""",
vw0 as (select f.* exclude (departure_month, season), {month('departure_date')} as forecast_month,
  cast(quarter(departure_date) as bigint) as forecast_quarter, cast(year(departure_date) as bigint) as forecast_year,
  res.* exclude (run_id, run_ts, forecast_date, brand, trade, ship_class, horizon_month), run_id as forecast_run_id,
  lower_berth_capacity*load_factor_fcst as pax from future f join res on f.brand = res.brand and f.trade = res.trade
  and f.ship_class = res.ship_class and {month('departure_date')} = res.forecast_date),
vw1 as (select *, pax*gross_per_diem_fcst*itinerary_length as gross from vw0),
vw2 as (select *, gross*discount_rate_base as disc, pax*promo_cost_per_pax_base as promo,
  pax*air_inclusive_pct_base*air_cost_per_pax_base as air, pax*taxes_fees_per_pax_base as tax from vw1),
vw3 as (select *, (gross-disc)*commission_rate_base*(1-direct_booking_pct_base) as comm from vw2),
vw as (select sailing_id, ship_name, ship_class, brand, trade, itinerary_length, departure_date, lower_berth_capacity,
  forecast_month, forecast_quarter, forecast_year, {fr('load_factor_fcst', 4)} as load_factor,
  {fr('load_factor_lo80', 4)} as load_factor_lo80, {fr('load_factor_hi80', 4)} as load_factor_hi80,
  {fr('gross_per_diem_fcst', 2)} as gross_fare_per_diem, {fr('gross_per_diem_lo80', 2)} as gross_per_diem_lo80,
  {fr('gross_per_diem_hi80', 2)} as gross_per_diem_hi80, {', '.join(f'{c}_base as {c}' for c in RATES)},
  floor(pax+0.5) as passengers_forecast, floor(gross+0.5) as gross_ticket_revenue, floor(disc+0.5) as discount_amount,
  floor(promo+0.5) as promo_cost_total, floor(comm+0.5) as ta_commission, floor(air+0.5) as air_cost_total,
  floor(tax+0.5) as taxes_total, floor(gross-disc-promo-comm-air-tax+0.5) as net_ticket_revenue,
  model_lf, model_pd, forecast_run_id from vw3)"""
_VIEW_RATES = ", ".join(rc(c) for c in RATES)


def view(spark, sf_dir):
    return baseline_view(future(spark, sf_dir).drop("departure_month", "season"), stored_results(spark, sf_dir))


@query("v_baseline_forecast", with_ctes("monthly future", f"""
select * exclude ({', '.join(RATES)}), {_VIEW_RATES} from vw""", _VIEW))
def q_view(spark, sf_dir):
    return shown(view(spark, sf_dir))


@query("waterfall_summary", with_ctes("monthly future", f"""
select forecast_month, brand, trade, {', '.join(f"{r(f'sum({a})', 2)} as {a}" for a in AMOUNTS)} from vw group by all""", _VIEW))
def q_waterfall_summary(spark, sf_dir):
    return shown(waterfall_summary(view(spark, sf_dir)))


@query("uncovered_sailings", with_ctes("monthly future", f"""
select sailing_id, brand, trade, ship_class, {month('departure_date')} as forecast_month from future f
where not exists (select 1 from res where res.brand <> 'ASIA' and horizon_month <= 6 and res.brand = f.brand and res.trade = f.trade and res.ship_class = f.ship_class
  and res.forecast_date = {month('departure_date')})""", _RES))
def q_uncovered(spark, sf_dir):
    # A run without one brand and with half the horizon, so that there is something to report.
    part = stored_results(spark, sf_dir).where("brand <> 'ASIA' and horizon_month <= 6")
    df = uncovered_sailings(future(spark, sf_dir), part)
    return df.select("sailing_id", *DIMS, "forecast_month")


# SQL surface and checks -------------------------------------------------------------------------

@query("sql_surface", with_ctes("monthly future", f"""
select s.brand, s.trade, cast(sum(s.net_ticket_revenue) as double) as ntr, max(d.lf_p50) as lf_p50
from (select brand, trade, net_ticket_revenue from vw where brand = 'ASIA') s
join (select brand, trade, {r('max(p)')} as lf_p50 from (
  select brand, trade, ship_class, quantile_cont(load_factor, 0.5) as p from monthly group by all) group by all) d
  using (brand, trade) group by all""", _VIEW))
def q_sql(spark, sf_dir):
    register_views(spark, history(spark, sf_dir), future(spark, sf_dir).drop("departure_month", "season"),
                   stored_results(spark, sf_dir))
    return shown(spark.sql("""
        select s.brand, s.trade, sum(s.net_ticket_revenue) as ntr, max(d.lf_p50) as lf_p50
        from v_waterfall_summary s
        join (select brand, trade, max(lf_p50) as lf_p50 from v_driver_distributions group by brand, trade) d
          on s.brand = d.brand and s.trade = d.trade
        where s.brand = :brand group by s.brand, s.trade""", args={"brand": "ASIA"}))


@query("sql_udf_waterfall", with_ctes("facts", f"""
select sailing_id, {r('gross', 2)} as gross_ticket_revenue,
  {r('gross*(1-discount_rate)*(1-commission_rate*(1-direct_booking_pct))-pax*(promo_cost_per_pax+air_inclusive_pct*air_cost_per_pax+taxes_fees_per_pax)', 2)} as net_ticket_revenue
from (select *, passengers_booked as pax, passengers_booked*gross_fare_per_diem*itinerary_length as gross from facts)"""))
def q_udf(spark, sf_dir):
    register_functions(spark)
    facts(spark, sf_dir).createOrReplaceTempView("sailings_all")
    return shown(spark.sql("""
        select sailing_id, waterfall_gross(passengers_booked, gross_fare_per_diem, itinerary_length) as gross_ticket_revenue,
          waterfall_net(passengers_booked, waterfall_gross(passengers_booked, gross_fare_per_diem, itinerary_length),
            discount_rate, commission_rate, direct_booking_pct, promo_cost_per_pax, air_inclusive_pct,
            air_cost_per_pax, taxes_fees_per_pax) as net_ticket_revenue
        from sailings_all"""))


@query("pk_violations", """
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1""")
def q_pk(spark, sf_dir):
    lines = spark.read.schema("l_orderkey bigint, l_linenumber int").parquet(f"{sf_dir}/lineitem.parquet")
    return store.duplicate_keys(lines.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint")),
                                ["l_orderkey", "l_linenumber"])


_REQ = schemas.SCHEDULE_COLUMNS


def _rules(table, source, cols, key):
    nn = " union all ".join(
        f"select '{table}' as \"table\", 'not null' as rule, '{c}' as \"column\", count(*) filter ({c} is null) as violations from {source}"
        for c in cols)
    return nn + f" union all select '{table}', 'primary key', '{', '.join(key)}', count(*)-count(distinct ({', '.join(key)})) from {source}"


_RES_REQ = [f.name for f in schemas.RESULTS.fields if not f.nullable]


@query("constraint_report", with_ctes("monthly future", " union all ".join([
    _rules("sailings_hist", "hist", _REQ, ["sailing_id"]), _rules("sailings_future", "future", _REQ, ["sailing_id"]),
    _rules("forecast_results", "res", _RES_REQ, schemas.RESULTS_KEY)]), _RES))
def q_constraints(spark, sf_dir):
    return (
        store.constraint_report(history(spark, sf_dir), schemas.HISTORY, ["sailing_id"], "sailings_hist")
        .unionByName(store.constraint_report(future(spark, sf_dir), schemas.SCHEDULE, ["sailing_id"], "sailings_future"))
        .unionByName(store.constraint_report(stored_results(spark, sf_dir), schemas.RESULTS, schemas.RESULTS_KEY, "forecast_results"))
    )


@query("scenario_writeback", """
select n_name as scenario_name, true as has_id, true as has_time, case when n_nationkey % 2 = 0
  then floor((0.40::double+n_nationkey/100.0::double)*1000000::double+0.5)/1000000::double end as load_factor_override from nation""")
def q_writeback(spark, sf_dir):
    path = fresh_path(spark, "scenarios")
    store.save_scenarios(scenarios(spark, sf_dir).drop("scenario_id", "created_at"), path)
    saved = store.read_scenarios(spark, path)
    return saved.select("scenario_name", (F.length("scenario_id") == 36).alias("has_id"),
                        F.col("created_at").isNotNull().alias("has_time"),
                        X.floor_round("load_factor_override", 6).alias("load_factor_override"))


# stored sailings ----------------------------------------------------------------------------------

_HIST_COLUMNS = ", ".join(rc(f.name, 2) if f.dataType.typeName() == "double" and f.name.endswith("revenue") else
                          rc(f.name) if f.dataType.typeName() == "double" else f.name for f in schemas.HISTORY.fields)


@query("clustered_read", with_ctes("hist", f"""
select {_HIST_COLUMNS} from hist where departure_date >= date '1998-02-10' and departure_date < date '1998-05-03'
  and brand in ('ASIA', 'EUROPE') and trade = '1-URGENT'"""))
def q_clustered(spark, sf_dir):
    path = fresh_path(spark, "sailings")
    store.write_clustered(history(spark, sf_dir).select(*schemas.HISTORY.fieldNames()), path)
    return shown(read_history(spark, path, "1998-02-10", "1998-05-03", ["ASIA", "EUROPE"], ["1-URGENT"]).drop("_loaded_at"))
