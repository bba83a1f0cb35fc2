"""Exact quantiles of large and unevenly sized groups.

``percentile`` keeps every distinct value of a group in one task. That is fine where a group holds
one row per month, but a group of sailings may hold a third of all rows. Here the rows are first
counted per (group, measure, value), which spreads a hot group over all tasks. The counts are written, so the rows behind are
read once; where values hardly repeat they are as many as the rows. Ranks are then looked
up in steps: through the counts of coarse bins, and inside the few bins that hold a wanted rank.
Only sorts that can spill are used, and no step holds a group as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.session import settle


def value_counts(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, measure, value, n) for the non-null values; partially aggregated before the shuffle."""
    pairs = ", ".join(f"struct('{m}' as measure, cast({m} as double) as value)" for m in measures)
    long = df.selectExpr(*keys, f"inline(array({pairs}))").where("value is not null")
    return long.groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


#: Leading binary digits a bin keeps, and the size beyond which values share one bin so that no product overflows.
BITS = 12
LARGE = 1e290
#: Of wide bins: at most 32 per power of two.
WIDE_BITS = 6


def coarse_bin(value: Column, bits: int = BITS) -> Column:
    """The value rounded to ``bits`` binary digits: monotone, at most 2,048 bins per power of two for 12.

    Rounded by one product and two differences (Veltkamp's splitting). With a bin by powers and logarithms of ten, the
    stage that writes the counts took about five times as long.
    """
    scaled = value * float(2 ** (53 - bits) + 1)
    return (F.when(value > LARGE, 10 * LARGE).when(value < -LARGE, -10 * LARGE)
            .otherwise(scaled - (scaled - value)))


def settled_counts(counts: DataFrame) -> DataFrame:
    """Counts with their bins, written once: several lookups follow, the rows behind are read once."""
    return settle(counts.withColumn("bin", coarse_bin(F.col("value"))), "counts")


def moments_of_counts(counts: DataFrame) -> DataFrame:
    """(measure, mean, std): mean and sample deviation, the deviation around the mean in a second look."""
    means = counts.groupBy("measure").agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    off = F.col("value") - F.col("mean")
    # One row per measure: bounded by the list of drivers.
    return counts.join(F.broadcast(means), "measure").groupBy("measure", "mean").agg(
        F.sqrt(F.try_divide(F.sum(F.col("n") * off * off), F.max("total") - 1)).alias("std"))


def quantiles_of_counts(counts: DataFrame, keys: list[str], probs: dict[str, float],
                        measures: list[str], name=lambda measure, label: f"{measure}_{label}") -> DataFrame:
    """One row per key with a column for each measure and probability (linear interpolation).

    ``counts`` come from ``settled_counts``. Ranks are found through wide bins, of which a group has few however many
    values it has, then through the bins inside those, then through their values. The wide bins that hold a wanted rank
    and the counts inside them are written, so jobs run while this is called; all counts are read twice, and they are
    not shuffled where the wanted bins are small enough to broadcast.
    """
    group = [*keys, "measure"]
    wide = coarse_bin(F.col("bin"), WIDE_BITS)
    whole = Window.partitionBy(*group)
    # Each bin is one row here, so frames of rows are exact, and cheaper than frames of equal values.
    so_far = lambda window: F.sum("bin_n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    positions = [f"(total - 1) * {float(p)!r}D" for p in probs.values()]
    bins = (
        counts.groupBy(*group, wide.alias("wide")).agg(F.sum("n").alias("bin_n"))
        .withColumn("before", so_far(whole.orderBy("wide")) - F.col("bin_n"))
        .withColumn("total", F.sum("bin_n").over(whole))
        # Most bins hold no wanted rank: they go by plain comparisons before lists of ranks are built.
        .where(" or ".join(f"(floor({pos}) + 1 >= before and floor({pos}) < before + bin_n)" for pos in positions))
    )
    # Both neighbours of the position (total - 1) * p, with their weights; at most 2 per probability.
    wanted = []
    for label, pos in zip(probs, positions):
        wanted += [
            f"struct('{label}' as label, floor({pos}) as rank, 1 - ({pos} - floor({pos})) as weight)",
            f"struct('{label}' as label, floor({pos}) + 1 as rank, {pos} - floor({pos}) as weight)"]
    held = lambda ranks: F.expr(
        f"filter({ranks}, w -> w.weight > 0 and w.rank >= before and w.rank < before + bin_n)")

    def holding(found: DataFrame, ranks: str, bin: str) -> DataFrame:
        return (found.withColumn("wanted", held(ranks)).where("size(wanted) > 0")
                .selectExpr(*[f"{k} as _{k}" for k in [*group, bin]], "before", "wanted"))

    same = lambda bin: F.expr(" and ".join(f"{k} <=> _{k}" for k in [*group, bin]))
    named = [*group, "value", "n", "bin", "wide"]
    near = settle(
        counts.withColumn("wide", wide)
        .join(settle(holding(bins, f"array({', '.join(wanted)})", "wide"), "wide-bins"), same("wide"))
        .select(*named, "before", "wanted"), "near-counts")
    # The same within each wide bin; its ranks and what lies before it are the same in all of its rows.
    inside = Window.partitionBy(*group, "wide").orderBy("bin")
    fine = (
        near.groupBy(*group, "wide", "bin")
        .agg(F.sum("n").alias("bin_n"), F.first("before").alias("before"), F.first("wanted").alias("ranks"))
        .withColumn("before", F.col("before") + so_far(inside) - F.col("bin_n"))
    )
    up_to = F.sum("n").over(Window.partitionBy(*group, "bin").orderBy("value")) + F.col("before")
    picked = (
        near.select(*named).join(holding(fine, "ranks", "bin"), same("bin"))
        .withColumn("up_to", up_to)
        .select(*group, "value", "n", "up_to", F.inline("wanted"))
        .where("rank < up_to and rank >= up_to - n")
    )
    cells = [
        F.expr(f"sum(if(measure = '{m}' and label = '{label}', weight * value, null)) as {name(m, label)}")
        for m in measures for label in probs
    ]
    return picked.groupBy(*keys).agg(*cells)


def group_quantiles(df: DataFrame, keys: list[str], measures: list[str], probs: dict[str, float], **kw) -> DataFrame:
    return quantiles_of_counts(settled_counts(value_counts(df, keys, measures)), keys, probs, measures, **kw)


def roll_up_counts(counts: DataFrame, key_sets: list[list[str]]) -> DataFrame:
    """Counts at several levels from the counts of the finest, with the index of the key set as ``level``.

    The history is read once; only the counts are multiplied by the number of levels.
    """
    keys = list(dict.fromkeys(k for ks in key_sets for k in ks))
    if len(key_sets) == 1:
        return counts.select(F.lit(0).alias("level"), *keys, "measure", "value", "n")
    kept = lambda k, ks: f"{k} as {k}" if k in ks else f"cast(null as {counts.schema[k].dataType.simpleString()}) as {k}"
    rows = ", ".join(
        f"struct({', '.join([f'{i} as level', *[kept(k, ks) for k in keys]])})" for i, ks in enumerate(key_sets))
    return (
        counts.selectExpr(f"inline(array({rows}))", "measure", "value", "n")
        .groupBy("level", *keys, "measure", "value").agg(F.sum("n").alias("n"))
    )


def values_at_rank(counts: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """(keys, measure, value, total): the value at the 0-based ``rank`` of each group, in ascending order.

    ``rank`` is a SQL expression of ``total``, the group's count; a group whose rank falls outside 0 to total - 1
    gives no row. ``counts`` come from ``settled_counts``; as in ``quantiles_of_counts``, ranks are found through
    the counts of coarse bins and then inside the one bin that holds them, so no step holds a group whole.
    """
    group = [*keys, "measure"]
    whole = Window.partitionBy(*group)
    bins = (
        counts.groupBy(*group, "bin").agg(F.sum("n").alias("bin_n"))
        .withColumn("before", F.sum("bin_n").over(whole.orderBy("bin")) - F.col("bin_n"))
        .withColumn("total", F.sum("bin_n").over(whole))
        .withColumn("rank", F.expr(rank).cast("bigint"))
        .where("rank >= before and rank < before + bin_n")
        .selectExpr(*[f"{k} as _{k}" for k in [*group, "bin"]], "before", "rank", "total")
    )
    same = F.expr(" and ".join(f"{k} <=> _{k}" for k in [*group, "bin"]))
    up_to = F.sum("n").over(Window.partitionBy(*group, "bin").orderBy("value")) + F.col("before")
    return (counts.join(bins, same).withColumn("up_to", up_to)
            .where("rank < up_to and rank >= up_to - n").select(*group, "value", "total"))
