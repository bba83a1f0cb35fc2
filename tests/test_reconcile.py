import datetime as dt
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.forecasting import reconcile as R
from fairlead.forecasting import series as S


def setup(spark, seed=5, brands="AB", trades="xy", classes="12", skip=()):
    """A tree of brands, trades and classes; 24 months of errors and three steps of base forecasts."""
    rng = np.random.default_rng(seed)
    bottoms = [b for b in ("/".join(x) for x in product(brands, trades, classes)) if b not in skip]
    nodes = list(brands) + sorted({b[:3] for b in bottoms}) + bottoms
    Smat = np.array([[float(b == n or b.startswith(n + "/")) for b in bottoms] for n in nodes])
    common = rng.normal(0, 1, (1, 24))
    e = rng.normal(0, 1, (len(nodes), 24)) * rng.uniform(0.5, 3, (len(nodes), 1)) + common
    y = rng.uniform(50, 100, (len(nodes), 3))
    month = lambda k: dt.date(2000 + k // 12, k % 12 + 1, 1)
    res = spark.createDataFrame([("d", n, month(t), float(e[i, t])) for i, n in enumerate(nodes) for t in range(24)],
                                "driver string, unique_id string, ds date, e double")
    fc = spark.createDataFrame([("d", n, h + 1, month(24 + h), float(y[i, h])) for i, n in enumerate(nodes) for h in range(3)],
                               "driver string, unique_id string, h long, ds date, yhat double")
    summing = S.summing_table(spark.createDataFrame([(b,) for b in bottoms], "unique_id string"))
    return nodes, Smat, e, y, fc, res, summing


def by_formula(Smat, e, y):
    """S (S' W^-1 S)^-1 S' W^-1 y with the shrunk covariance, all matrices written out."""
    n, T = e.shape
    c = e - e.mean(axis=1, keepdims=True)
    V = c @ c.T / (T - 1)
    x = c / np.sqrt(np.diag(V))[:, None]
    w = x[:, None, :] * x[None, :, :]
    mean = w.mean(axis=2)
    var = T / (T - 1) ** 3 * ((w - mean[:, :, None]) ** 2).sum(axis=2)
    corr = mean * T / (T - 1)
    off = ~np.eye(n, dtype=bool)
    lam = min(1.0, max(0.0, var[off].sum() / (corr[off] ** 2).sum()))
    W = lam * np.diag(np.diag(V)) + (1 - lam) * V
    Wi = np.linalg.inv(W)
    return lam, Smat @ np.linalg.solve(Smat.T @ Wi @ Smat, Smat.T @ Wi @ y)


@pytest.mark.parametrize("shape", [
    {}, {"skip": ("A/x/1", "A/x/2", "B/y/2")}, {"brands": "ABCDEF", "trades": "stuvwxyz", "classes": "123", "seed": 9}])
def test_matches_the_matrix_formula(spark, shape):
    """One way for 6, 5 and 54 upper nodes."""
    nodes, Smat, e, y, fc, res, summing = setup(spark, **shape)
    lam, want = by_formula(Smat, e, y)
    assert 0 < lam < 1
    assert R.shrinkage(R.standardised(res)).first().lam == pytest.approx(lam, rel=1e-9)
    out = R.reconcile(fc, res, summing)
    rows = out.orderBy("ds").collect()
    got = {n: [r.yhat for r in rows if r.unique_id == n] for n in nodes}
    for i, n in enumerate(nodes):
        assert got[n] == pytest.approx(want[i], rel=1e-6)
    assert R.coherence(out, summing).agg(F.sum("n_incoherent")).first()[0] == 0


@pytest.mark.parametrize("still", [("A/x/1",), ("A",), ("A", "A/x", "A/x/1", "A/x/2")])
def test_nodes_without_variance_stay(spark, still):
    """A series without errors keeps its forecast where the others can take up the difference."""
    nodes, Smat, e, y, fc, res, summing = setup(spark)
    res = res.withColumn("e", F.when(F.col("unique_id").isin(*still), 0.0).otherwise(F.col("e")))
    out = {(r.unique_id, r.ds.month): r.yhat for r in R.reconcile(fc, res, summing).collect()}
    for i, n in enumerate(nodes):
        for h in range(3):
            below = sum(out[(b, h + 1)] for b in nodes if len(b) == 5 and b.startswith(n))
            assert out[(n, h + 1)] == pytest.approx(below, rel=1e-9)
            if still in (("A/x/1",), ("A",)) and n in still:
                assert out[(n, h + 1)] == pytest.approx(y[i, h], rel=1e-4)


def test_no_errors_at_all_is_least_squares(spark):
    nodes, Smat, e, y, fc, res, summing = setup(spark)
    got = {(r.unique_id, r.ds.month): r.yhat for r in R.reconcile(fc, res.withColumn("e", F.lit(0.0)), summing).collect()}
    want = Smat @ np.linalg.lstsq(Smat, y, rcond=None)[0]
    assert all(got[(n, h + 1)] == pytest.approx(want[i, h], rel=1e-9) for i, n in enumerate(nodes) for h in range(3))


def test_coherent_input_stays(spark):
    nodes, Smat, e, y, _, res, summing = setup(spark)
    coherent = Smat @ y[6:]
    fc = spark.createDataFrame([("d", n, h + 1, dt.date(2002, h + 1, 1), float(coherent[i, h])) for i, n in enumerate(nodes) for h in range(3)],
                               "driver string, unique_id string, h long, ds date, yhat double")
    got = {(r.unique_id, r.ds.month): r.yhat for r in R.reconcile(fc, res, summing).collect()}
    assert all(got[(n, h + 1)] == pytest.approx(coherent[i, h]) for i, n in enumerate(nodes) for h in range(3))


def test_bottom_up_and_rollup(spark):
    *_, fc, res, summing = setup(spark)
    bottom = S.bottom_only(fc)
    up = {(r.unique_id, r.ds): r.yhat for r in R.bottom_up(bottom, summing).collect()}
    below = sum(r.yhat for r in bottom.where("unique_id like 'A/x/%' and h = 1").collect())
    assert up[("A/x", dt.date(2002, 1, 1))] == pytest.approx(below)
    df = spark.createDataFrame([("d", "A/x/1", dt.date(2000, 1, 1), 1.0), ("d", "B/x/1", dt.date(2000, 1, 1), 2.0)],
                               "driver string, unique_id string, ds date, y double")
    rolled = {(r.unique_id, r.level): r.y for r in S.rollup_series(df, total=True).collect()}
    assert rolled == {("A", 0): 1, ("A/x", 1): 1, ("A/x/1", 2): 1, ("B", 0): 2, ("B/x", 1): 2, ("B/x/1", 2): 2, ("Total", -1): 3}
