import math

import numpy as np
import pytest

from fairlead.forecasting import evaluate as E


def _plain(errors, level):
    """k-th smallest absolute error per (driver, model, series, h), else parent, else driver."""
    def pick(values):
        values = sorted(abs(v) for v in values)
        k = math.ceil((len(values) + 1) * level)
        return values[k - 1] if k <= len(values) else None

    pools = {}
    for d, m, u, h, e in errors:
        parent = u.rsplit("/", 1)[0]
        for key in (("s", d, m, u, h), ("p", d, m, parent, h), ("d", d, m, h)):
            pools.setdefault(key, []).append(e)
    return lambda d, m, u, h: next(((w, t) for t, key in (("series", ("s", d, m, u, h)), ("parent", ("p", d, m, u.rsplit("/", 1)[0], h)),
                                                           ("driver", ("d", d, m, h))) if (w := pick(pools.get(key, []))) is not None), (None, None))


def test_conformal_widths_and_back_off(spark):
    rng = np.random.default_rng(4)
    series = [f"A/T{t}/C{c}" for t in range(3) for c in range(3)] + ["B/T0/C0"]
    errors = []
    for u in series:
        for h in (1, 2, 3):
            n = {"A/T0/C0": 12, "A/T1/C1": 4}.get(u, 1 if u.startswith("B") else 2)
            errors += [("lf", "naive", u, h, float(rng.normal() * h)) for _ in range(n)]
    errors.append(("lf", "naive", "A/T0/C0", 1, errors[0][4]))            # ties
    forecasts = [("lf", "naive", u, h, 10.0) for u in series + ["C/T9/C9"] for h in (1, 2, 3, 4)]
    err = spark.createDataFrame(errors, "driver string, model string, unique_id string, h int, error double")
    fc = spark.createDataFrame(forecasts, "driver string, model string, unique_id string, h int, yhat double")
    for level in (0.8, 0.95):
        want = _plain(errors, level)
        got = E.conformal_by_horizon(fc, err, level).collect()
        assert len(got) == len(forecasts)
        for r in got:
            w, tier = want(r.driver, r.model, r.unique_id, r.h)
            assert r.interval_tier == tier and r.interval_level == level
            if w is None:
                assert r.lo is None and r.hi is None
            else:
                assert r.hi - r.yhat == pytest.approx(w) and r.yhat - r.lo == pytest.approx(w)


def test_conformal_coverage_on_held_out_errors(spark):
    rng = np.random.default_rng(7)
    fit = [("lf", "m", f"A/B/{s}", 1, float(rng.standard_t(5))) for s in range(40) for _ in range(30)]
    err = spark.createDataFrame(fit, "driver string, model string, unique_id string, h int, error double")
    fc = spark.createDataFrame([("lf", "m", f"A/B/{s}", 1, 0.0) for s in range(40)],
                               "driver string, model string, unique_id string, h int, yhat double")
    for level in (0.8, 0.95):
        half = {r.unique_id: r.hi for r in E.conformal_by_horizon(fc, err, level).collect()}
        new = rng.standard_t(5, size=(40, 2000))
        covered = np.mean([np.mean(np.abs(new[s]) <= half[f"A/B/{s}"]) for s in range(40)])
        assert covered >= level - 0.02
