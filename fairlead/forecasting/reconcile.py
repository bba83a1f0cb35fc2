"""Coherent forecasts over the hierarchy.

The variance of the errors weighs how far each node moves: minimum trace with the shrunk covariance
W = s diag(V) + (1 - s) V. With U = the constraints "node minus its bottom series" the reconciled forecasts are
y - W U (U' W U)^-1 U' y. V has the rank of the months, V = F F' with one column per month, so

    (s U' D U + G G') g = u,   G = U' F,   u = U' y.

The diagonal part alone is the reconciliation of a tree: one pass up the levels, adding up variances and means, and one
pass down, sharing out what is left. It is done for the columns of G and u at once. What couples them is a
system of months x months, bounded by the calendar (Woodbury). There is one way for any number of nodes; work grows with
nodes x months x (months + horizon).

Tables with one row per driver, or per driver, month and step, are bounded by the calendar and broadcast;
tables that grow with the series never are by hint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.session import settle

#: Least shrinkage: at 0 the weights have only the rank of the months, and the solution is taken as the limit.
LEAST_SHRINKAGE = 1e-6
#: A node without variance gets this share of its driver's largest variance, so it moves only where nothing else can.
LEAST_VARIANCE = 1e-9
#: Columns of a tree pass: months as 0, 1, ..., steps ahead from here on.
STEPS_FROM = 1_000_000


def bottom_up(forecasts: DataFrame, summing: DataFrame, value: str = "yhat") -> DataFrame:
    """Every node as the sum of its bottom forecasts: (driver, unique_id, level, ds, value)."""
    bottom = forecasts.select("driver", F.col("unique_id").alias("bottom_id"), "ds", value)
    return (
        bottom.join(summing, "bottom_id")
        .groupBy("driver", F.col("node").alias("unique_id"), "level", "ds").agg(F.sum(value).alias(value))
    )


def standardised(residuals: DataFrame) -> DataFrame:
    """Centred errors ``e``, their variance ``v`` and the standardised errors ``x`` of each node.

    One row per node, arrays over the common months: a month without an error counts as no deviation.
    """
    stats = residuals.groupBy("driver", "unique_id").agg(
        F.avg("e").alias("m"), F.sort_array(F.collect_list(F.struct("ds", "e"))).alias("pts"))
    months = residuals.groupBy("driver").agg(F.sort_array(F.collect_set("ds")).alias("months"))
    df = stats.join(F.broadcast(months), "driver")
    df = df.withColumn("_known", F.map_from_entries("pts"))
    df = df.withColumn("e", F.expr("transform(months, d -> coalesce(try_element_at(_known, d) - m, 0D))"))
    df = df.withColumns({"n_months": F.size("months"), "v": F.expr("aggregate(e, 0D, (s, x) -> s + x * x) / (size(months) - 1)")})
    x = F.expr("transform(e, u -> if(v > 0, u / sqrt(v), 0D))")
    return df.select("driver", "unique_id", "months", "n_months", "e", "v", x.alias("x"))


def shrinkage(nodes: DataFrame) -> DataFrame:
    """Shrinkage per driver: summed variance of the correlations over their summed squares, in [0, 1].

    The sums over all pairs of nodes come from sums over pairs of months, so no pair of nodes is formed.
    """
    pairs = nodes.select("driver", "n_months", F.posexplode("x").alias("t", "a"), "x")
    pairs = pairs.select("driver", "n_months", "t", "a", F.posexplode("x").alias("s", "b")).where(F.col("s") >= F.col("t"))
    gram = pairs.groupBy("driver", "n_months", "t", "s").agg(
        F.sum(F.col("a") * F.col("b")).alias("g"),
        F.sum(F.when(F.col("s") == F.col("t"), F.pow("a", 4)).otherwise(0.0)).alias("q"))
    sums = gram.groupBy("driver", "n_months").agg(
        F.sum(F.when(F.col("s") == F.col("t"), 1.0).otherwise(2.0) * F.col("g") * F.col("g")).alias("gg"),
        F.sum(F.when(F.col("s") == F.col("t"), F.col("g") * F.col("g") - F.col("q")).otherwise(0.0)).alias("ww"))
    live = nodes.groupBy("driver").agg(F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).alias("n"))
    T = F.col("n_months").cast("double")
    squares = F.col("gg") / ((T - 1) * (T - 1)) - F.col("n")
    variance = T / F.pow(T - 1, 3) * (F.col("ww") - (T - 1) * (T - 1) / T * squares)
    lam = F.when(squares <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), variance / squares)))
    return sums.join(live, "driver").select("driver", lam.alias("lam"))


def _incoherence(forecasts: DataFrame, nodes: DataFrame, summing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per upper node what it differs from its bottom series: in errors by month, in forecasts by step."""
    upper = summing.where(F.col("node") != F.col("bottom_id")).select("node", "bottom_id")
    is_upper = upper.select("node").distinct()
    bottom_of = lambda df: df.join(upper, F.col("unique_id") == F.col("bottom_id"))

    e_long = nodes.select("driver", "unique_id", F.posexplode("e").alias("t", "e"))
    own = e_long.join(is_upper, F.col("unique_id") == F.col("node")).select("driver", "node", "t", "e")
    below = bottom_of(e_long).select("driver", "node", "t", (-F.col("e")).alias("e"))
    d = own.unionByName(below).groupBy("driver", "node", "t").agg(F.sum("e").alias("d"))

    own_y = forecasts.join(is_upper, F.col("unique_id") == F.col("node")).select("driver", "node", "h", "yhat")
    below_y = bottom_of(forecasts).select("driver", "node", "h", (-F.col("yhat")).alias("yhat"))
    u = own_y.unionByName(below_y).groupBy("driver", "node", "h").agg(F.sum("yhat").alias("u"))
    return d, u


def tree_edges(summing: DataFrame) -> DataFrame:
    """(parent, level, child): each upper node with its level and the nodes of the next level below it."""
    lines = summing.groupBy("bottom_id").agg(F.sort_array(F.collect_set(F.struct("level", "node"))).alias("line"))
    pairs = lines.select(F.explode(F.expr(
        "transform(slice(line, 1, size(line) - 1), (x, i) -> struct(x.node as parent, x.level as level, line[i + 1].node as child))"
    )).alias("p"))
    return pairs.select("p.*").distinct()


def tree_solution(r: DataFrame, variance: DataFrame, edges: DataFrame) -> DataFrame:
    """Least weighted changes that meet all constraints: (driver, node, c, x) with sum of x^2 / v least.

    ``r`` (driver, node, c, r) says by how much an upper node's change exceeds the changes of its bottom series, column by
    column; ``variance`` (driver, node, v) is positive for all nodes. Levels are few and walked one by one.
    """
    key, cell = ["driver", "node"], ["driver", "node", "c"]
    levels = sorted((x["level"] for x in edges.select("level").distinct().collect()), reverse=True)
    below, means = variance, None  # of the children: bottom series have their own variance and mean zero
    done = {}
    for level in levels:
        kids = edges.where(F.col("level") == level).select(F.col("parent"), F.col("child").alias("node"))
        spread = below.join(kids, "node").groupBy("driver", F.col("parent").alias("node")).agg(F.sum("v").alias("below_v"))
        own = spread.join(variance, key)
        cells = r.join(own, key)
        if means is None:
            cells = cells.withColumn("below_m", F.lit(0.0))
        else:
            summed = means.join(kids, "node").groupBy("driver", F.col("parent").alias("node"), "c").agg(F.sum("m").alias("below_m"))
            cells = cells.join(summed, cell)
        w = F.col("v") * F.col("below_v") / (F.col("v") + F.col("below_v"))
        cells = settle(cells.select(*cell, "r", "v", "below_v", "below_m", w.alias("w"), (w * (F.col("below_m") / F.col("below_v") - F.col("r") / F.col("v"))).alias("m")), "tree")
        done[level] = cells
        below, means = own.select(*key, w.alias("v")), cells.select(*cell, "m")
    parts, s = [], None
    for level in reversed(levels):
        cells = done[level]
        if s is None:
            here = cells.withColumn("s", F.col("m"))
        else:
            here = cells.join(s, cell).withColumn("s", F.col("m") + F.col("w") * F.col("rest"))
        here = settle(here.select(*cell, "r", "v", "below_v", "below_m", "s"), "tree")
        parts.append(here.select(*cell, (F.col("r") + F.col("s")).alias("x")))
        kids = edges.where(F.col("level") == level).select(F.col("parent"), "child")
        s = here.join(kids, F.col("node") == F.col("parent")).select(
            "driver", F.col("child").alias("node"), "c", ((F.col("s") - F.col("below_m")) / F.col("below_v")).alias("rest"))
    if s is not None:
        parts.append(s.join(variance, key).select(*cell, (F.col("v") * F.col("rest")).alias("x")))
    out = parts[0] if parts else r.select(*cell, F.col("r").alias("x"))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _coupling(x: DataFrame, variance: DataFrame, lam: DataFrame) -> DataFrame:
    """q (driver, t, h, q): the months' combined weights, from the products of the tree solutions' columns.

    The products are summed over all nodes by pairs of columns; one driver's system has a row per month.
    """
    rows = x.groupBy("driver", "node").agg(F.collect_list(F.struct("c", "x")).alias("cells")).join(variance, ["driver", "node"])
    pairs = rows.select("driver", "v", "cells", F.inline("cells")).where(F.col("c") < STEPS_FROM).select(
        "driver", "v", F.col("c").alias("a"), F.col("x").alias("xa"), F.inline("cells"))
    gram = pairs.groupBy("driver", "a", F.col("c").alias("b")).agg(F.sum(F.col("xa") * F.col("x") / F.col("v")).alias("p"))
    gram = gram.join(F.broadcast(lam), "driver").select("driver", "a", "b", (F.col("p") / F.col("lam")).alias("p"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        table = part.pivot(index="a", columns="b", values="p").fillna(0.0)
        months = list(table.index)
        steps = [c for c in table.columns if c >= STEPS_FROM]
        system = np.eye(len(months)) + table.reindex(columns=months, fill_value=0.0).to_numpy()
        q = np.linalg.solve(system, table[steps].to_numpy()) if steps else np.empty((len(months), 0))
        return pd.DataFrame({"driver": part["driver"].iloc[0], "t": np.repeat(months, len(steps)),
                             "h": np.tile(steps, len(months)) - STEPS_FROM if steps else np.empty(0, np.int64), "q": q.reshape(-1)})

    return gram.groupBy("driver").applyInPandas(solve, "driver string, t bigint, h bigint, q double")


def reconcile(forecasts: DataFrame, residuals: DataFrame, summing: DataFrame) -> DataFrame:
    """Coherent forecasts of all nodes: (driver, unique_id, level, ds, yhat).

    ``forecasts``: (driver, unique_id, h, ds, yhat) of every node; ``residuals``: (driver, unique_id,
    ds, e) of every node. Runs jobs while it is called.
    """
    nodes = settle(standardised(residuals), "nodes")
    forecasts = settle(forecasts.select("driver", "unique_id", F.col("h").cast("bigint").alias("h"), "ds", "yhat"), "base")
    lam = F.greatest(F.col("lam"), F.lit(LEAST_SHRINKAGE))
    share = F.sqrt((1 - F.col("lam")) / (F.col("n_months") - 1))
    months = nodes.groupBy("driver").agg(F.max("n_months").alias("n_months"), F.max("v").alias("largest"))
    per_driver = settle(shrinkage(nodes).select("driver", lam.alias("lam")).join(months, "driver").withColumn("share", share), "shrinkage")
    floor = F.when(F.col("largest") > 0, F.col("largest") * LEAST_VARIANCE).otherwise(1.0)
    variance = settle(nodes.join(F.broadcast(per_driver), "driver").select(
        "driver", F.col("unique_id").alias("node"), F.greatest("v", floor).alias("v")), "variances")
    d, u = _incoherence(forecasts, nodes, summing)
    d = d.join(F.broadcast(per_driver), "driver").select("driver", "node", F.col("t").cast("bigint").alias("c"), (F.col("d") * F.col("share")).alias("r"))
    r = settle(d.unionByName(u.select("driver", "node", (F.col("h") + STEPS_FROM).alias("c"), F.col("u").alias("r"))), "incoherence")
    x = settle(tree_solution(r, variance, settle(tree_edges(summing), "tree-edges")), "tree-solution")
    q = F.broadcast(settle(_coupling(x, variance, per_driver.select("driver", "lam")), "coupling"))

    is_bottom = summing.select(F.col("bottom_id").alias("node")).distinct()
    xb = x.join(is_bottom, "node", "left_semi")
    direct = xb.where(F.col("c") >= STEPS_FROM).select("driver", "node", (F.col("c") - STEPS_FROM).alias("h"), "x")
    through = xb.where(F.col("c") < STEPS_FROM).join(q, (xb["driver"] == q["driver"]) & (F.col("c") == F.col("t"))).select(
        xb["driver"], "node", "h", (-F.col("x") * F.col("q")).alias("x"))
    e = nodes.withColumnRenamed("unique_id", "node").join(is_bottom, "node", "left_semi").join(F.broadcast(per_driver.select("driver", "share")), "driver")
    e = e.select("driver", "node", "share", F.posexplode("e").alias("t", "e"))
    common = e.join(q, ["driver", "t"]).select("driver", "node", "h", (F.col("share") * F.col("e") * F.col("q")).alias("x"))
    move = direct.unionByName(through).unionByName(common).groupBy("driver", F.col("node").alias("unique_id"), "h").agg(F.sum("x").alias("move"))
    bottom = forecasts.join(is_bottom, F.col("unique_id") == F.col("node"), "left_semi").join(move, ["driver", "unique_id", "h"], "left").select(
        "driver", "unique_id", "ds", (F.col("yhat") - F.coalesce("move", F.lit(0.0))).alias("yhat"))
    return bottom_up(settle(bottom, "bottom"), summing)


def coherence(reconciled: DataFrame, summing: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per level: nodes and how many of them differ from the sum of their bottom series."""
    bottom = reconciled.join(summing.select("bottom_id").distinct(), F.col("unique_id") == F.col("bottom_id"), "left_semi")
    sums = bottom_up(bottom, summing).withColumnRenamed("yhat", "below")
    off = F.abs(F.col("yhat") - F.col("below")) > tolerance * F.greatest(F.lit(1.0), F.abs("yhat"))
    joined = reconciled.join(sums, ["driver", "unique_id", "level", "ds"], "left")
    per_node = joined.groupBy("driver", "level", "unique_id").agg(
        F.max(F.coalesce(off, F.lit(True)).cast("int")).alias("off"))
    return per_node.groupBy("driver", "level").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("off").cast("bigint").alias("n_incoherent"))
