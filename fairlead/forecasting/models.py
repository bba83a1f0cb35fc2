"""Forecast models as expressions over series arrays.

Every model takes rows with ``pts``, ``ys``, ``n`` and ``last`` (see ``series.densify``) and adds three
columns: ``<name>_fc``, one value per future month, ``<name>_res``, the one-step errors inside the
sample, aligned to the end of the series, and ``<name>_wid``, by how much the error of each future month is
wider than that of one step. A model gives null where a series is too short for it.
Nothing is shuffled and no Python runs per row.
"""

from __future__ import annotations

import cmath
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.constants import HORIZON, SEASON
from fairlead.forecasting.series import KEYS

Model = Callable[[DataFrame, int], DataFrame]


def _grid(rows: list[dict]) -> str:
    """Array of parameter structs as SQL text."""
    text = [", ".join(f"'{k}', {float(v)!r}D" for k, v in r.items()) for r in rows]
    return "array(" + ", ".join(f"named_struct({t})" for t in text) + ")"


def _aicc(sse: str, n: str, k: str) -> str:
    """Corrected information criterion; infinite when there are too few points for the parameters."""
    return (f"if({n} - {k} - 1 > 0, {n} * ln(greatest({sse}, 1e-12D) / {n}) + 2 * {k} "
            f"+ 2 * {k} * ({k} + 1) / ({n} - {k} - 1), double('Infinity'))")


def _widths(horizon: int, weight: str) -> str:
    """Widths from the weight that an error keeps ``j`` months later: root of one plus the summed squares."""
    return (f"transform(sequence(1, {horizon}), h -> sqrt(1 + aggregate(filter(sequence(1, {horizon}), j -> j < h), 0D, "
            f"(s, j) -> s + power({weight}, 2))))")


# naive and means -------------------------------------------------------------------

def seasonal_naive(df: DataFrame, horizon: int = HORIZON, name: str = "seasonal_naive") -> DataFrame:
    """Latest observed value of the same calendar month, else the latest value."""
    return df.withColumns({
        f"{name}_fc": F.expr(f"""
            transform(sequence(1, {horizon}), h -> coalesce(
              try_element_at(filter(pts, p -> month(p.ds) = month(add_months(last, h))), -1).y,
              element_at(pts, -1).y))"""),
        f"{name}_res": F.expr(f"""
            if(n > {SEASON}, transform(sequence({SEASON}, n - 1), i -> ys[i] - ys[i - {SEASON}]),
               transform(slice(ys, 2, n), (y, i) -> y - ys[i]))"""),
        f"{name}_wid": F.expr(f"transform(sequence(1, {horizon}), h -> sqrt(floor((h - 1) / {SEASON}) + 1D))"),
    })


def seasonal_mean(df: DataFrame, horizon: int = HORIZON, name: str = "seasonal_mean") -> DataFrame:
    """Mean of the dense values of the same calendar month, else of all."""
    mean = lambda a: f"aggregate({a}, 0D, (s, v) -> s + v) / size({a})"
    same = f"filter(ys, (y, i) -> (n - 1 + h - i) % {SEASON} = 0)"
    return df.withColumns({
        f"{name}_fc": F.expr(f"""
            transform(sequence(1, {horizon}), h -> transform(array({same}), q ->
              if(size(q) > 0, {mean('q')}, {mean('ys')}))[0])"""),
        f"{name}_res": F.expr(f"""
            transform(ys, (y, i) -> y - transform(array(filter(ys, (v, j) -> (i - j) % {SEASON} = 0)), q ->
              {mean('q')})[0])"""),
        f"{name}_wid": F.expr(f"array_repeat(1D, {horizon})"),
    })


# exponential smoothing ---------------------------------------------------------------

def _ets_grid(seasonal: bool, level_only: bool = False) -> list[dict]:
    """Additive-error forms; ``k`` counts smoothing values, initial states and the variance."""
    rows = []
    if level_only:
        return [dict(a=i / 20, b=0, phi=1, c=0, t=0, k=3) for i in range(1, 20)]
    extra = 12 if seasonal else 0
    gammas = (0.05, 0.15, 0.3) if seasonal else (0,)
    for a, c in product((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9), gammas):
        rows.append(dict(a=a, b=0, phi=1, c=c, t=0, k=3 + extra))
    for a, b, c, phi in product((0.1, 0.3, 0.6), (0.01, 0.05, 0.15), gammas[:2], (1, 0.9)):
        rows.append(dict(a=a, b=b, phi=phi, c=c, t=1, k=(5 if phi == 1 else 6) + extra))
    return rows


def _ets_fold(seasonal: bool, g: str, keep: bool) -> str:
    """State recursion over ``ys``: level, trend, season (current month first), squared errors."""
    fit = f"(st.l + {g}.phi * st.b" + (" + st.s[0])" if seasonal else ")")
    err = f"(y - {fit})"
    init = f"'l', _l0, 'b', {g}.t * _b0" + (", 's', _s0" if seasonal else "") + ", 'sse', 0D"
    step = (f"'l', st.l + {g}.phi * st.b + {g}.a * {err}, 'b', {g}.phi * st.b + {g}.b * {err}"
            + (f", 's', array_append(slice(st.s, 2, {SEASON - 1}), st.s[0] + {g}.c * {err})" if seasonal else "")
            + f", 'sse', st.sse + {err} * {err}")
    if keep:
        init += ", 'res', cast(array() as array<double>)"
        step += f", 'res', array_append(st.res, {err})"
    return f"aggregate(ys, named_struct({init}), (st, y) -> named_struct({step}))"


def ets(df: DataFrame, horizon: int = HORIZON, name: str = "ets", level_only: bool = False) -> DataFrame:
    """Exponential smoothing: level, trend, damped trend, each with and without additive season.

    Every point of a fixed grid is scored over the series; the best by corrected information
    criterion is kept. Seasonal forms need two full years.
    """
    mean = lambda a: f"aggregate({a}, 0D, (s, v) -> s + v) / size({a})"
    m = SEASON
    forms = [False] if level_only else [False, True]
    out = df
    for seasonal in forms:
        tag = "s" if seasonal else "p"
        first = f"slice(ys, 1, {m})"
        year = f"n >= {2 * m}"
        l0 = "ys[0]" if not seasonal else mean(first)
        starts = {
            "_l0": F.expr(l0),
            "_b0": F.expr(f"if({year}, ({mean(f'slice(ys, {m + 1}, {m})')} - {mean(first)}) / {m}, 0D)"),
        }
        out = out.withColumns(starts)
        if seasonal:
            out = out.withColumn("_s0", F.expr(f"transform({first}, v -> v - _l0)"))
        score = (f"array_min(transform({_grid(_ets_grid(seasonal, level_only))}, g -> transform(array("
                 f"{_ets_fold(seasonal, 'g', False)}.sse), sse -> named_struct("
                 f"'aicc', {_aicc('sse', 'n', 'g.k')}, 'g', g))[0]))")
        out = out.withColumn(f"_{tag}", F.expr(f"if({year}, {score}, null)" if seasonal else score))
        out = out.withColumn(f"_{tag}g", F.col(f"_{tag}.g"))
        fold = _ets_fold(seasonal, f"_{tag}g", True)
        out = out.withColumn(f"_{tag}f", F.expr(f"if({year}, {fold}, null)" if seasonal else fold))
        out = out.drop("_l0", "_b0", "_s0")

    def values(tag, seasonal):
        g, f = f"_{tag}g", f"_{tag}f"
        damp = f"if({g}.phi = 1, cast(h as double), {g}.phi * (1 - power({g}.phi, h)) / (1 - {g}.phi))"
        season = f" + {f}.s[(h - 1) % {m}]" if seasonal else ""
        return f"transform(sequence(1, {horizon}), h -> {f}.l + {damp} * {f}.b{season})"

    use_s = "_s is not null and _s.aicc < _p.aicc"
    fc = values("p", False) if level_only else f"if({use_s}, {values('s', True)}, {values('p', False)})"
    res = "_pf.res" if level_only else f"if({use_s}, _sf.res, _pf.res)"
    hidden = [f"_{t}{x}" for t in "ps" for x in ("", "g", "f")]

    def widths(tag):
        g = f"_{tag}g"
        damp = f"if({g}.phi = 1, cast(j as double), {g}.phi * (1 - power({g}.phi, j)) / (1 - {g}.phi))"
        return _widths(horizon, f"{g}.a + {g}.b * {damp} + if(j % {m} = 0, {g}.c, 0D)")

    wid = widths("p") if level_only else f"if({use_s}, {widths('s')}, {widths('p')})"
    out = out.withColumns({f"{name}_fc": F.expr(fc), f"{name}_res": F.expr(res), f"{name}_wid": F.expr(wid)})
    if level_only:
        out = out.withColumn(f"{name}_alpha", F.expr("_pg.a"))
    return out.drop(*hidden)


def ets_level(df: DataFrame, horizon: int = HORIZON, name: str = "ets_level") -> DataFrame:
    return ets(df, horizon, name, level_only=True)


# complex exponential smoothing ----------------------------------------------------------

def _ces_grid() -> list[dict]:
    """Pairs of the complex smoothing value whose error recursion is stable."""
    rows = []
    for i, j in product(range(2, 10), range(1, 8)):
        a0, a1 = i / 4, j / 4
        trace = 2 - 2 * a0 + a1
        det = (1 - a0 + a1) * (1 - a0) - (a1 - 1) * (1 - a0 - a1)
        root = cmath.sqrt(trace * trace / 4 - det)
        if max(abs(trace / 2 + root), abs(trace / 2 - root)) < 1:
            rows.append(dict(a=a0, b=a1))
    return rows


def _ces_fold(over: str, var: str, err: str, init: str, g: str, more: tuple[str, str]) -> str:
    """Level and information term of one month, rotated: the current one is at the head of its array."""
    l, c = "st.l[0]", "st.c[0]"
    rest = lambda a: f"slice(st.{a}, 2, size(st.{a}))"
    step = (f"'l', array_append({rest('l')}, {l} - (1 - {g}.b) * {c} + ({g}.a - {g}.b) * {err}), "
            f"'c', array_append({rest('c')}, {l} + (1 - {g}.a) * {c} + ({g}.a + {g}.b) * {err})")
    return f"aggregate({over}, named_struct({init}, {more[0]}), (st, {var}) -> named_struct({step}, {more[1]}))"


def ces(df: DataFrame, horizon: int = HORIZON, name: str = "ces") -> DataFrame:
    """Complex exponential smoothing, plain and with one state per calendar month."""
    out, m, err = df, SEASON, "(y - st.l[0])"
    year = f"n >= {2 * m}"
    for tag, seasonal in (("p", False), ("s", True)):
        start = (f"slice(ys, 1, {m})" if seasonal else
                 "transform(array(slice(ys, 1, 10)), q -> aggregate(q, 0D, (s, v) -> s + v) / size(q))")
        out = out.withColumn("_l0", F.expr(start))
        init = "'l', _l0, 'c', transform(_l0, v -> v / 1.1D)"
        k = 5 if not seasonal else 3 + 2 * m
        sse = _ces_fold("ys", "y", err, init, "g", ("'sse', 0D", f"'sse', st.sse + {err} * {err}")) + ".sse"
        score = (f"array_min(transform({_grid(_ces_grid())}, g -> transform(array({sse}), sse -> "
                 f"named_struct('aicc', {_aicc('sse', 'n', str(k))}, 'g', g))[0]))")
        out = out.withColumn(f"_{tag}", F.expr(f"if({year}, {score}, null)" if seasonal else score))
        out = out.withColumn(f"_{tag}g", F.col(f"_{tag}.g"))
        kept = _ces_fold("ys", "y", err, init, f"_{tag}g",
                         ("'res', cast(array() as array<double>)", f"'res', array_append(st.res, {err})"))
        out = out.withColumn(f"_{tag}f", F.expr(f"if({year}, {kept}, null)" if seasonal else kept))
        ahead = _ces_fold(f"sequence(1, {horizon})", "h", "0D", f"'l', _{tag}f.l, 'c', _{tag}f.c", f"_{tag}g",
                          ("'out', cast(array() as array<double>)", "'out', array_append(st.out, st.l[0])"))
        out = out.withColumn(f"_{tag}o", F.expr(f"{ahead}.out")).drop("_l0")
    use_s = "_s is not null and _s.aicc < _p.aicc"
    def widths(tag, every):
        """Both states after an error of one, moved on; they show in every month or only in the error's own."""
        g = f"_{tag}g"
        shows = f"j % {every} = 0"
        return f"""transform(aggregate(sequence(1, {horizon - 1}),
            named_struct('l', {g}.a - {g}.b, 'c', {g}.a + {g}.b, 'v', array(1D)), (st, j) -> named_struct(
              'l', if({shows}, st.l - (1 - {g}.b) * st.c, st.l), 'c', if({shows}, st.l + (1 - {g}.a) * st.c, st.c),
              'v', array_append(st.v, element_at(st.v, -1) + if({shows}, st.l * st.l, 0D)))).v, v -> sqrt(v))"""

    out = out.withColumns({
        f"{name}_fc": F.expr(f"if({use_s}, _so, _po)"), f"{name}_res": F.expr(f"if({use_s}, _sf.res, _pf.res)"),
        f"{name}_wid": F.expr(f"if({use_s}, {widths('s', m)}, {widths('p', 1)})") if horizon > 1 else F.array(F.lit(1.0))})
    return out.drop(*[f"_{t}{x}" for t in "ps" for x in ("", "g", "f", "o")])


# seasonal autoregression ------------------------------------------------------------------

MIN_DIFFERENCES = 8


def _ar_fit(p: int) -> dict[str, str]:
    """Least squares of z on its first ``p`` lags with intercept, over the points that have two lags
    (one for p = 1 alone), as SQL text for the coefficients."""
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (u, v) -> u * v), 0D, (s, v) -> s + v)"
    c = {"11": dot("_x1", "_x1"), "01": dot("_x0", "_x1")}
    if p == 0:
        return {"f1": "0D", "f2": "0D"}
    if p == 1:
        return {"f1": f"coalesce(try_divide({c['01']}, {c['11']}), 0D)", "f2": "0D"}
    c |= {"22": dot("_x2", "_x2"), "12": dot("_x1", "_x2"), "02": dot("_x0", "_x2")}
    det = f"({c['11']} * {c['22']} - {c['12']} * {c['12']})"
    return {
        "f1": f"coalesce(try_divide({c['01']} * {c['22']} - {c['02']} * {c['12']}, {det}), 0D)",
        "f2": f"coalesce(try_divide({c['02']} * {c['11']} - {c['01']} * {c['12']}, {det}), 0D)",
    }


def _with_ar(df: DataFrame, p: int, lags: int, tag: str) -> DataFrame:
    """Fit order ``p`` on the differences that have ``lags`` predecessors: coefficients, errors, criterion."""
    mean = lambda a: f"aggregate({a}, 0D, (s, v) -> s + v) / size({a})"
    part = {f"_r{i}": F.expr(f"slice(_z, {lags - i + 1}, size(_z) - {lags})") for i in range(lags + 1)}
    df = df.withColumns(part)
    df = df.withColumns({f"_m{i}": F.expr(mean(f"_r{i}")) for i in range(lags + 1)})
    df = df.withColumns({f"_x{i}": F.expr(f"transform(_r{i}, v -> v - _m{i})") for i in range(lags + 1)})
    fit = _ar_fit(p)
    df = df.withColumns({"_f1": F.expr(fit["f1"]), "_f2": F.expr(fit["f2"])})
    df = df.withColumn("_f0", F.expr("_m0 - _f1 * _m1" + (" - _f2 * _m2" if lags > 1 else "")))
    lag2 = " - _f2 * _r2[i]" if lags > 1 else ""
    df = df.withColumn("_e", F.expr(f"transform(_r0, (v, i) -> v - _f0 - _f1 * _r1[i]{lag2})"))
    df = df.withColumn("_q", F.expr("aggregate(_e, 0D, (s, v) -> s + v * v)"))
    # An order whose coefficients would let forecasts run away is not chosen while there is another.
    stable = "abs(_f2) < 1 and _f2 + _f1 < 1 and _f2 - _f1 < 1"
    df = df.withColumn(f"_ar{tag}", F.struct(
        F.expr(f"if({stable}, {_aicc('_q', 'size(_e)', str(p + 2))}, double('Infinity'))").alias("aicc"), F.lit(p).alias("p"),
        F.col("_f0").alias("f0"), F.col("_f1").alias("f1"), F.col("_f2").alias("f2"), F.col("_e").alias("res")))
    hidden = [f"_{c}{i}" for c in "rmx" for i in range(3)] + ["_f0", "_f1", "_f2", "_e", "_q"]
    return df.drop(*hidden)


def sar(df: DataFrame, horizon: int = HORIZON, name: str = "sar", orders: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Autoregression of the yearly differences; the order is chosen by corrected information criterion."""
    m = SEASON
    df = df.withColumn("_z", F.expr(f"""
        if(n >= {m + MIN_DIFFERENCES}, transform(sequence({m}, n - 1), i -> ys[i] - ys[i - {m}]), null)"""))
    lags = max(1, max(orders))
    for p in orders:
        df = _with_ar(df, p, lags, str(p))
    df = df.withColumn("_ar", F.array_min(F.array(*[F.col(f"_ar{p}") for p in orders])))
    ahead = f"""
        aggregate(sequence(1, {horizon}),
          named_struct('z1', element_at(_z, -1), 'z2', element_at(_z, -2), 'out', cast(array() as array<double>)),
          (st, h) -> transform(array(_ar.f0 + _ar.f1 * st.z1 + _ar.f2 * st.z2), z -> named_struct(
            'z1', z, 'z2', st.z1,
            'out', array_append(st.out, z + if(h <= {m}, ys[n - {m} + h - 1], get(st.out, h - {m + 1})))))[0],
          st -> st.out)"""
    # Weights of an error in the yearly differences, added to its weight a year before.
    widths = f"""
        transform(aggregate(sequence(1, {horizon - 1}),
          named_struct('p1', 1D, 'p2', 0D, 'w', array(1D), 'v', array(1D)), (st, j) -> transform(array(
            _ar.f1 * st.p1 + _ar.f2 * st.p2), p -> transform(array(p + coalesce(get(st.w, j - {m}), 0D)), w -> named_struct(
              'p1', p, 'p2', st.p1, 'w', array_append(st.w, w),
              'v', array_append(st.v, element_at(st.v, -1) + w * w)))[0])[0]).v, v -> sqrt(v))"""
    df = df.withColumns({
        f"{name}_fc": F.expr(f"if(_z is not null, {ahead}, null)"),
        f"{name}_res": F.expr("if(_z is not null, _ar.res, null)"),
        f"{name}_wid": F.expr(f"if(_z is not null, {widths}, null)") if horizon > 1 else F.array(F.lit(1.0))})
    return df.drop("_z", "_ar", *[f"_ar{p}" for p in orders])


def sar1(df: DataFrame, horizon: int = HORIZON, name: str = "sar1") -> DataFrame:
    return sar(df, horizon, name, orders=(1,))


MODELS: dict[str, Model] = {"ets": ets, "sar": sar, "ces": ces, "seasonal_naive": seasonal_naive}
SIMPLE_MODELS: dict[str, Model] = {"seasonal_naive": seasonal_naive, "seasonal_mean": seasonal_mean, "sar1": sar1}
FALLBACK = "seasonal_naive"


def fit_models(dense: DataFrame, models: dict[str, Model], horizon: int = HORIZON) -> DataFrame:
    """Add forecasts, errors and widths of all models; a model without a forecast takes the naive one's, and ``<name>_used``
    says so."""
    df = dense
    todo = dict(models)
    todo.setdefault(FALLBACK, seasonal_naive)
    for name, model in todo.items():
        df = model(df, horizon, name)
    used = {f"{m}_used": F.when(F.col(f"{m}_fc").isNull(), FALLBACK).otherwise(m) for m in models}
    return df.withColumns(used).withColumns({
        f"{m}_{part}": F.coalesce(f"{m}_{part}", f"{FALLBACK}_{part}")
        for m in models if m != FALLBACK for part in ("fc", "res", "wid")})


def forecasts_long(fitted: DataFrame, models: list[str], keys: list[str] = KEYS) -> DataFrame:
    """(keys, model, h, ds, yhat, sigma, width, used): sigma is the error of one step, width its factor for step h, used the model
    that the forecast is really from."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}_used").alias("used"), F.col(f"{m}_fc").alias("fc"), F.col(f"{m}_wid").alias("wid"), F.expr(
            f"sqrt(aggregate({m}_res, 0D, (s, v) -> s + v * v) / nullif(size({m}_res), 0))").alias("sigma"))
        for m in models])
    df = fitted.select(*keys, "last", F.inline(rows))
    df = df.select(*keys, "last", "model", "used", "sigma", "wid", F.posexplode("fc").alias("i", "yhat"))
    h = F.col("i") + 1
    return df.select(*keys, "model", h.cast("bigint").alias("h"), F.add_months("last", h).alias("ds"), "yhat", "sigma",
                     F.get("wid", F.col("i")).alias("width"), "used")


def residuals_long(fitted: DataFrame, model: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, ds, e): the errors dated back from the last month."""
    res = f"{model}_res"
    df = fitted.select(*keys, "last", F.size(res).alias("_k"), F.posexplode(res).alias("i", "e"))
    return df.select(*keys, F.add_months("last", F.col("i") - F.col("_k") + 1).alias("ds"), "e")


def custom_model(series: DataFrame, fn, keys: list[str] = KEYS) -> DataFrame:
    """Forecasts of a user's pandas function; a group is one series, at most one row per month."""
    schema = ", ".join(f"{k} string" for k in keys) + ", h bigint, ds date, yhat double"
    return series.groupBy(*keys).applyInPandas(fn, schema)
