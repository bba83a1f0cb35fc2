import datetime as dt

import numpy as np
import pytest

from fairlead.forecasting import evaluate as E
from fairlead.forecasting import models as M
from fairlead.forecasting import series as S


def month(k):
    return dt.date(1995 + k // 12, k % 12 + 1, 1)


def frame(spark, *series, skip=()):
    rows = [("d", name, month(k), float(v)) for name, ys in series for k, v in enumerate(ys) if (name, k) not in skip]
    return spark.createDataFrame(rows, "driver string, unique_id string, ds date, y double")


def wave(n, seed=0, trend=0.05):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 10 + trend * t + 2 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.3, n)


def fitted(spark, df, until, model, name):
    return {r.unique_id: r for r in model(S.densify(S.series_arrays(df), until), 12, name).collect()}


def test_gap_fill_and_naive(spark):
    ys = wave(30)
    df = frame(spark, ("a", ys), ("one", [7.0]), skip={("a", 5), ("a", 29)})
    grid = {(r.unique_id, r.ds): r for r in S.dense_grid(df, "1997-06-01").collect()}
    assert len(grid) == 60 and grid[("a", month(5))].filled
    assert grid[("a", month(5))].y == pytest.approx(ys[17])  # the other June known is month 17; 29 is missing
    assert grid[("one", month(20))].y == 7.0
    got = fitted(spark, df, "1997-06-01", M.seasonal_naive, "m")
    assert got["a"].m_fc[11] == pytest.approx(ys[17]) and got["a"].m_fc[0] == pytest.approx(ys[18])
    assert got["one"].m_fc == [7.0] * 12


def ets_loop(ys, g, seasonal):
    l = np.mean(ys[:12]) if seasonal else ys[0]
    b = g["t"] * (np.mean(ys[12:24]) - np.mean(ys[:12])) / 12
    s = list(np.array(ys[:12]) - l) if seasonal else [0.0] * 12
    res = []
    for y in ys:
        e = y - (l + g["phi"] * b + s[0])
        res.append(e)
        l, b, s = l + g["phi"] * b + g["a"] * e, g["phi"] * b + g["b"] * e, s[1:] + [s[0] + g["c"] * e]
    damp = [sum(g["phi"] ** j for j in range(1, h + 1)) for h in range(1, 13)]
    return [l + damp[h] * b + s[h] for h in range(12)], res


def aicc(sse, n, k):
    return n * np.log(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def test_ets_matches_a_plain_loop(spark):
    series = {"trendy": wave(60, 1), "flat": 5 + np.random.default_rng(3).normal(0, 1, 60)}
    got = fitted(spark, frame(spark, *series.items()), "1999-12-01", M.ets, "m")
    for name, ys in series.items():
        best = min(
            ((aicc(float(np.dot(r, r)), 60, g["k"]), i, f, r)
             for seasonal in (False, True) for i, g in enumerate(M._ets_grid(seasonal))
             for f, r in [ets_loop(ys, g, seasonal)]), key=lambda x: x[:2])
        assert got[name].m_fc == pytest.approx(best[2], rel=1e-9)
        assert got[name].m_res == pytest.approx(best[3], rel=1e-9, abs=1e-12)


def ces_loop(ys, a0, a1, seasonal):
    l = list(ys[:12]) if seasonal else [float(np.mean(ys[:10]))]
    c, res, out = [v / 1.1 for v in l], [], []
    def move(e):
        x, z = l.pop(0), c.pop(0)
        l.append(x - (1 - a1) * z + (a0 - a1) * e)
        c.append(x + (1 - a0) * z + (a0 + a1) * e)
    for y in ys:
        e = y - l[0]
        res.append(e)
        move(e)
    for _ in range(12):
        out.append(l[0])
        move(0.0)
    return out, res


def test_ces_matches_a_plain_loop(spark):
    ys = wave(60, 2)
    got = fitted(spark, frame(spark, ("a", ys)), "1999-12-01", M.ces, "m")["a"]
    best = min(
        ((aicc(float(np.dot(r, r)), 60, k), i, f, r)
         for seasonal, k in ((False, 5), (True, 27)) for i, g in enumerate(M._ces_grid())
         for f, r in [ces_loop(ys, g["a"], g["b"], seasonal)]), key=lambda x: x[:2])
    assert got.m_fc == pytest.approx(best[2], rel=1e-8)
    assert got.m_res == pytest.approx(best[3], rel=1e-8, abs=1e-10)


def test_sar_matches_least_squares(spark):
    ys = wave(72, 4)
    got = fitted(spark, frame(spark, ("a", ys), ("short", ys[:15])), "2000-12-01", M.sar, "m")
    z = ys[12:] - ys[:-12]
    best = None
    for p in (0, 1, 2):
        X = np.column_stack([np.ones(len(z) - 2)] + [z[2 - j:len(z) - j] for j in range(1, p + 1)])
        beta = np.linalg.lstsq(X, z[2:], rcond=None)[0]
        e = z[2:] - X @ beta
        score = aicc(float(e @ e), len(e), p + 2)
        if best is None or score < best[0]:
            best = (score, p, beta, e)
    _, p, beta, e = best
    path, out = list(z), []
    for h in range(12):
        nxt = beta[0] + sum(beta[j] * path[-j] for j in range(1, p + 1))
        path.append(nxt)
        out.append(nxt + ys[60 + h])
    assert got["a"].m_fc == pytest.approx(out, rel=1e-8)
    assert got["a"].m_res == pytest.approx(e, rel=1e-7, abs=1e-9)


def test_long_horizon_and_short_series(spark):
    df = frame(spark, ("a", wave(40)), ("tiny", [3.0]), ("year", wave(13)))
    dense = S.densify(S.series_arrays(df), "1998-04-01")
    got = {r.unique_id: r for r in M.fit_models(dense.where("unique_id = 'a'"), M.MODELS, 30).collect()}
    assert all(len(got["a"][f"{m}_fc"]) == 30 and None not in got["a"][f"{m}_fc"] for m in M.MODELS)
    late = M.fit_models(S.densify(S.series_arrays(df), S.F.expr("pts[size(pts) - 1].ds")), M.MODELS, 12)
    for row in late.collect():
        for m in M.MODELS:
            assert None not in row[f"{m}_fc"], (row.unique_id, m)


def test_rolling_origin_uses_the_past_only(spark):
    ys = wave(48)
    changed = np.concatenate([ys[:36], ys[36:] + 100])
    models = {"seasonal_naive": M.seasonal_naive, "ets": M.ets}
    a = E.rolling_origin_errors(frame(spark, ("a", ys)), models, ["1997-12-01"], 6).orderBy("model", "h").collect()
    b = E.rolling_origin_errors(frame(spark, ("a", changed)), models, ["1997-12-01"], 6).orderBy("model", "h").collect()
    assert [r.yhat for r in a] == pytest.approx([r.yhat for r in b])
    assert [r.error + 100 for r in a] == pytest.approx([r.error for r in b])


def test_choice_ties_and_intervals(spark):
    mae = spark.createDataFrame([("d", "b", 1.0), ("d", "a", 1.0), ("d", "c", 2.0)], "driver string, model string, mae double")
    assert E.best_model(mae, ["c", "b", "a"]).first().model == "b"
    fc = spark.createDataFrame([("d", "u", "m", h, 10.0, 2.0) for h in (1, 12, 13)],
                               "driver string, unique_id string, model string, h long, yhat double, sigma double")
    lo = [r.lo for r in E.gaussian_interval(fc).orderBy("h").collect()]
    assert lo == pytest.approx([10 - 1.2815515655 * 2, 10 - 1.2815515655 * 2, 10 - 1.2815515655 * 2 * 2**0.5])
    err = spark.createDataFrame([("d", "u", "m", float(e)) for e in range(-5, 6)], "driver string, unique_id string, model string, error double")
    assert E.conformal_interval(fc, err).first().hi == pytest.approx(10 + np.quantile(np.abs(np.arange(-5, 6)), 0.8))


def test_custom_model(spark):
    from fairlead.catalog.forecasting import drift
    rows = M.custom_model(frame(spark, ("a", [1.0, 2.0, 3.0])), drift).orderBy("h").collect()
    assert rows[0].yhat == 4.0 and rows[11].ds == month(14)


def test_the_future_stays_unknown(spark):
    df = frame(spark, ("a", [1.0] * 67 + [8.0, 9.0]))
    df = df.unionByName(frame(spark, ("late", [5.0] * 69), skip={("late", k) for k in range(68)}))
    until = "2000-07-01"  # month 66
    got = fitted(spark, df, until, M.seasonal_naive, "m")
    assert set(got) == {"a"} and got["a"].m_fc == [1.0] * 12
    assert [(r.unique_id, r["first"]) for r in S.late_series(df, until).collect()] == [("late", month(68))]
    assert {r.unique_id for r in S.dense_grid(df, until).collect()} == {"a"}


def test_widths_match_simulated_impulses(spark):
    """An error of one in the last month moves each later forecast by its weight; widths add up the squares."""
    ys = wave(60, seed=4)
    horizon = 26
    def row(model, name, values):
        df = S.densify(S.series_arrays(frame(spark, ("a", values))), month(len(values) - 1).isoformat())
        return model(df, horizon, name).first()
    naive = row(M.seasonal_naive, "m", ys)
    assert naive.m_wid == pytest.approx([np.sqrt(h // 12 + 1) for h in range(horizon)])
    sar = row(M.sar1, "m", ys)
    z = np.array(ys[12:]) - np.array(ys[:-12])
    a, b = z[:-1] - z[:-1].mean(), z[1:] - z[1:].mean()
    f1 = a @ b / (a @ a)
    w = []
    for j in range(horizon):
        w.append(f1**j + (w[j - 12] if j >= 12 else 0.0))
    assert sar.m_wid == pytest.approx(np.sqrt(np.cumsum(np.square(w))))
    level = row(M.ets_level, "m", ys)
    assert level.m_wid == pytest.approx([np.sqrt(1 + h * level.m_alpha**2) for h in range(horizon)])
    for model in (M.ets, M.ces):
        wid = row(model, "m", ys).m_wid
        assert len(wid) == horizon and wid[0] == 1 and all(x <= y for x, y in zip(wid, wid[1:]))


def test_interval_levels(spark):
    df = spark.createDataFrame([(10.0, 2.0, 1.5)], "yhat double, sigma double, width double")
    for level, z in ((0.8, 1.2815515655), (0.95, 1.9599639845)):
        r = E.model_interval(df, level).first()
        assert (r.lo, r.hi) == pytest.approx((10 - 3 * z, 10 + 3 * z))


def test_running_away_orders_are_not_chosen(spark):
    ys = 10 + 1.12 ** np.arange(60)
    got = fitted(spark, frame(spark, ("a", ys)), month(59).isoformat(), M.sar, "m")["a"]
    assert max(np.abs(np.diff(got.m_fc))) < 10 * max(np.abs(np.diff(ys)))
