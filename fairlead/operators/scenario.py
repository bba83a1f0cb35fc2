"""Driver assumptions, scenarios, attribution and simulation.

An analyst's scenario fixes all six drivers to one value each. Passengers then depend on the capacity
alone and net revenue is linear in the columns that stay, so sailings with the same capacity and
length can be added up first: one small profile answers every question about fixed driver sets.
Scenarios with gaps (null = baseline) keep row-level drivers; their sums by capacity are prepared for
every choice of overridden drivers in the same single pass.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.constants import (
    DRIVER_SPEC, FEASIBILITY, HISTOGRAM_BINS, MIN_IMPACT_M, OVERRIDABLE, OVERRIDE_COLUMNS, SAME_VALUE,
    SIMULATIONS, TARGET_FACTORS,
)
from fairlead.functions.scalar import clip, floor_round, hashed_normal, safe_div, truncate
from fairlead.operators.waterfall import waterfall
from fairlead.session import settle


def _by_driver(values: dict[str, str]) -> str:
    """SQL text choosing a value by the column ``driver``."""
    return "case driver " + " ".join(f"when '{d}' then {v}" for d, v in values.items()) + " end"


def _spec(field: int) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else f"{float(v)!r}D"
    return _by_driver({d[0]: text(d[field]) for d in DRIVER_SPEC})


# profile of the schedule ------------------------------------------------------

def schedule_profile(forecast: DataFrame) -> DataFrame:
    """Sums per capacity and length: all that fixed driver sets need, plus baseline sums."""
    return forecast.groupBy("lower_berth_capacity", "itinerary_length").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(1.0 - F.col("direct_booking_pct")).alias("agency_share"),
        F.sum("air_cost_per_pax").alias("air_cost"),
        F.sum("taxes_fees_per_pax").alias("taxes"),
        F.sum("net_ticket_revenue").alias("net"),
        *[F.sum(d).alias(f"sum_{d}") for d in OVERRIDABLE],
    )


def sailing_rows(forecast: DataFrame) -> DataFrame:
    """The same columns without adding up: one row per sailing."""
    return forecast.select(
        "lower_berth_capacity", "itinerary_length", F.lit(1).alias("n"),
        (1.0 - F.col("direct_booking_pct")).alias("agency_share"), F.col("air_cost_per_pax").alias("air_cost"),
        F.col("taxes_fees_per_pax").alias("taxes"))


def baseline_figures(profile: DataFrame) -> DataFrame:
    """One row: baseline net revenue in millions and the mean of each driver."""
    return profile.agg(
        (F.sum("net") / 1e6).alias("baseline_ntr_m"),
        *[safe_div(F.sum(f"sum_{d}"), F.sum("n")).alias(d) for d in OVERRIDABLE])


def net_of_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Net revenue of every driver set (``set_id`` and six drivers) over all rows.

    The sets travel to the rows as one array, so their number must be bounded by the caller (draws,
    drivers); rows stay where they are and only one sum per set leaves a task.
    """
    packed = sets.select(F.collect_list(F.struct("set_id", *OVERRIDABLE))).scalar()
    pairs = rows.select("*", F.inline(packed))
    c = F.col
    pax = truncate(c("lower_berth_capacity") * c("load_factor"))
    kept = pax * c("gross_fare_per_diem") * c("itinerary_length") * (1.0 - c("discount_rate"))
    net = (
        kept * (c("n") - c("commission_rate") * c("agency_share"))
        - pax * (c("n") * c("promo_cost_per_pax") + c("air_inclusive_pct") * c("air_cost") + c("taxes"))
    )
    return pairs.select("set_id", net.alias("net")).groupBy("set_id").agg(F.sum("net").alias("net"))


# assumptions --------------------------------------------------------------------

def driver_inputs(stats: DataFrame, profile: DataFrame, edits: dict[str, float] | None = None) -> DataFrame:
    """Input table: percentiles, baseline mean and assumption of each driver, scaled and rounded.

    ``edits`` multiply the baseline of a driver before rounding. ``value`` is the assumption in
    driver units, ``in_bounds`` tells whether it keeps to the bounds of the driver.
    """
    factors = {d: f"{float((edits or {}).get(d, 1.0))!r}D" for d in OVERRIDABLE}
    df = stats.withColumn("_b", baseline_figures(profile).select(F.struct("*")).scalar()).selectExpr(
        "*", f"{_spec(4)} as _scale", f"{_by_driver({d: f'_b.{d}' for d in OVERRIDABLE})} as baseline_mean",
        f"power(10D, {_spec(7)}) as _dec", f"{_by_driver(factors)} as _edit")
    rounded = lambda x: f"floor({x} * _scale * _dec + 0.5D) / _dec"
    df = df.withColumn("assumption", F.expr("floor(baseline_mean * _scale * _edit * _dec + 0.5D) / _dec"))
    df = df.withColumn("value", F.expr("assumption / _scale"))
    return df.selectExpr(
        "driver", f"{_spec(2)} as label", f"{_spec(3)} as unit", "cast(_scale as bigint) as scale",
        f"{rounded('p50')} as hist_p50", f"{rounded('p10')} as hist_p10", f"{rounded('p90')} as hist_p90",
        f"{rounded('baseline_mean')} as baseline", "assumption", "value", "baseline_mean",
        *[f"{p} * _scale as {p}" for p in ("p10", "p25", "p50", "p75", "p90")], "std",
        f"value between {_spec(5)} and {_spec(6)} as in_bounds")


def grade(x: Column, p10: Column, p25: Column, p75: Column, p90: Column) -> Column:
    return F.when(x.between(p25, p75), "Normal").when(x.between(p10, p90), "Stretch").otherwise("Heroic")


def position(x: Column, p10: Column, p90: Column) -> Column:
    """Place between P10 and P90 as 0 to 100; 50 if they coincide."""
    return F.when(p90 == p10, 50.0).otherwise(clip(safe_div(x - p10, p90 - p10) * 100, 0, 100))


def grade_drivers(inputs: DataFrame) -> DataFrame:
    c = F.col
    return inputs.select(
        "driver", "label", "assumption",
        position(c("assumption"), c("p10"), c("p90")).alias("position"),
        grade(c("assumption"), c("p10"), c("p25"), c("p75"), c("p90")).alias("grade"), "in_bounds")


def assumed_values(inputs: DataFrame, column: str = "value", prefix: str = "") -> DataFrame:
    """The six values of an input table side by side in one row."""
    return inputs.agg(*[
        F.max(F.when(F.col("driver") == d, F.col(column))).alias(f"{prefix}{d}") for d in OVERRIDABLE])


# results -------------------------------------------------------------------------

def target_bounds(profile: DataFrame) -> DataFrame:
    lo, hi, default = TARGET_FACTORS
    b = F.col("baseline_ntr_m")
    return baseline_figures(profile).select(
        b, (b * lo).alias("min_target_m"), (b * hi).alias("max_target_m"),
        floor_round(b * default, 0).alias("default_target_m"))


def scenario_result(profile: DataFrame, inputs: DataFrame) -> DataFrame:
    """Scenario revenue against baseline and default target."""
    sets = assumed_values(inputs).withColumn("set_id", F.lit(0))
    bounds = target_bounds(profile).select(F.struct("*")).scalar()
    target, base, ntr = F.col("b.default_target_m"), F.col("b.baseline_ntr_m"), F.col("net") / 1e6
    return net_of_sets(profile, sets).withColumn("b", bounds).select(
        base.alias("baseline_ntr_m"), ntr.alias("scenario_ntr_m"), target.alias("target_ntr_m"),
        (ntr - base).alias("gap_m"), (ntr - target).alias("gap_vs_target_m"),
        (safe_div(target - base, base) * 100).alias("required_delta_pct"))


def attribution(profile: DataFrame, inputs: DataFrame) -> DataFrame:
    """Impact of each changed driver alone, the others at their baseline means; small impacts dropped."""
    means = assumed_values(inputs, "baseline_mean", "base_").select(F.struct("*")).scalar()
    changed = inputs.where(F.abs(F.col("value") - F.col("baseline_mean")) >= SAME_VALUE).withColumn("m", means)
    sets = changed.select(
        F.col("driver").alias("set_id"),
        *[F.when(F.col("driver") == d, F.col("value")).otherwise(F.col(f"m.base_{d}")).alias(d) for d in OVERRIDABLE])
    base = baseline_figures(profile).select("baseline_ntr_m").scalar()
    impact = F.col("net") / 1e6 - base
    return (
        net_of_sets(profile, sets)
        .withColumnRenamed("set_id", "driver").select("driver", F.expr(_spec(2)).alias("label"), impact.alias("impact_m"))
        .where(F.abs("impact_m") > MIN_IMPACT_M)
    )


def attribution_steps(profile: DataFrame, inputs: DataFrame) -> DataFrame:
    """Baseline, impacts and scenario as ordered steps."""
    order = F.expr(_by_driver({d: str(i) for i, d in enumerate(OVERRIDABLE, 1)}))
    row = lambda df, step, label, measure, value: df.select(
        step.cast("bigint").alias("step"), label.alias("label"), F.lit(measure).alias("measure"), value.alias("value_m"))
    result = scenario_result(profile, inputs)
    impacts = attribution(profile, inputs)
    return (
        row(result, F.lit(0), F.lit("Baseline"), "absolute", F.col("baseline_ntr_m"))
        .unionByName(row(impacts, order, F.col("label"), "relative", F.col("impact_m")))
        .unionByName(row(result, F.lit(99), F.lit("Your Scenario"), "total", F.col("scenario_ntr_m")))
    )


# simulation ------------------------------------------------------------------------

def draw_sets(inputs: DataFrame, n: int = SIMULATIONS) -> DataFrame:
    """``n`` driver sets: the assumption plus normal noise with the historical deviation."""
    row = inputs.agg(*[
        F.max(F.when(F.col("driver") == d, F.col(c))).alias(f"{d}_{c}") for d in OVERRIDABLE for c in ("value", "std")
    ]).select(F.struct("*")).scalar()
    draws = inputs.sparkSession.range(n).withColumn("o", row)
    return draws.select(F.col("id").alias("set_id"), *[
        (F.col(f"o.{d}_value") + F.col(f"o.{d}_std") * hashed_normal(F.col("id"), j)).alias(d)
        for j, d in enumerate(OVERRIDABLE)])


def monte_carlo(rows: DataFrame, inputs: DataFrame, n: int = SIMULATIONS) -> DataFrame:
    """Net revenue in millions of every draw; ``rows`` is a profile or single sailings."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartition(parts, "lower_berth_capacity", "itinerary_length", "agency_share", "taxes")
    return net_of_sets(spread, draw_sets(inputs, n)).select(
        F.col("set_id").alias("draw_id"), (F.col("net") / 1e6).alias("ntr_m"))


def feasibility_label(pct: Column) -> Column:
    (high, a), (mid, b), (_, c) = FEASIBILITY
    return F.when(pct >= high, a).when(pct >= mid, b).otherwise(c)


def simulation_summary(draws: DataFrame, target: Column) -> DataFrame:
    """Percentiles of the outcomes and the chance of reaching the target."""
    return draws.agg(
        F.count(F.lit(1)).alias("simulations"),
        F.percentile("ntr_m", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"),
        (F.avg((F.col("ntr_m") >= target).cast("int")) * 100).alias("feasibility_pct"),
    ).select("simulations", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"),
             "feasibility_pct", feasibility_label(F.col("feasibility_pct")).alias("feasibility"))


def simulation_histogram(draws: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal bins between the lowest and the highest outcome, empty bins included."""
    ends = draws.agg(F.min("ntr_m").alias("lo"), F.max("ntr_m").alias("hi"))
    place = F.coalesce(F.floor(safe_div(F.col("ntr_m") - F.col("e.lo"), F.col("e.hi") - F.col("e.lo")) * bins), F.lit(0))
    placed = draws.withColumn("e", ends.select(F.struct("*")).scalar()).select(
        F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    grid = ends.select("lo", "hi", F.explode(numbers).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + width * F.col("bin")).alias("from_m"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("to_m"), F.coalesce("n", F.lit(0)).alias("n"))


# saved scenarios ---------------------------------------------------------------------

def apply_scenario(forecast: DataFrame, scenario: DataFrame) -> DataFrame:
    """Waterfall of every sailing under one scenario row, null overrides meaning the baseline."""
    row = scenario.select(F.struct(*OVERRIDE_COLUMNS.values())).scalar()
    df = forecast.withColumn("_o", row)
    picks = {d: F.coalesce(F.col(f"_o.{o}"), F.col(d)) for d, o in OVERRIDE_COLUMNS.items()}
    return waterfall(df, picks, pax_mode="trunc").drop("_o")


def apply_scenarios(forecast: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Waterfall of every sailing under each of a set of scenarios, with ``scenario_id``.

    A row per sailing and scenario is the result that is asked for; the set is stated by the caller and goes to the
    sailings, which stay where they are.
    """
    rows = scenarios.select(F.collect_list(F.struct("scenario_id", *OVERRIDE_COLUMNS.values()))).scalar()
    df = forecast.withColumn("_o", F.explode(rows))
    picks = {d: F.coalesce(F.col(f"_o.{o}"), F.col(d)) for d, o in OVERRIDE_COLUMNS.items()}
    return waterfall(df, picks, pax_mode="trunc").withColumn("scenario_id", F.col("_o.scenario_id")).drop("_o")


def _masked_sums(weight: Column) -> dict[str, Column]:
    """Sums of the net formula with overridden drivers left out, for every choice of them.

    The name lists, by 0 and 1, whether per diem, discount, commission are overridden (promo and air
    share likewise); an overridden driver enters later as a factor.
    """
    c, one = F.col, F.lit(1.0)
    length = weight * c("itinerary_length")
    sums = {}
    for pd_o, disc_o in product((0, 1), repeat=2):
        kept = length * (one if pd_o else c("gross_fare_per_diem")) * (one if disc_o else 1.0 - c("discount_rate"))
        sums[f"kept_{pd_o}{disc_o}"] = kept
        for comm_o in (0, 1):
            rate = one if comm_o else c("commission_rate")
            sums[f"comm_{pd_o}{disc_o}{comm_o}"] = kept * rate * (1.0 - c("direct_booking_pct"))
    sums["promo_0"], sums["promo_1"] = weight * c("promo_cost_per_pax"), weight * one
    sums["air_0"] = weight * c("air_cost_per_pax") * c("air_inclusive_pct")
    sums["air_1"] = weight * c("air_cost_per_pax")
    sums["tax"] = weight * c("taxes_fees_per_pax")
    return sums


def override_profile(forecast: DataFrame) -> DataFrame:
    """One row per capacity: sums for baseline passengers (``b_``) and per passenger (``u_``)."""
    pax = truncate(F.col("lower_berth_capacity") * F.col("load_factor")).cast("double")
    sums = {f"b_{k}": v for k, v in _masked_sums(pax).items()}
    sums |= {f"u_{k}": v for k, v in _masked_sums(F.lit(1.0)).items()}
    return forecast.groupBy("lower_berth_capacity").agg(
        F.sum("net_ticket_revenue").alias("net"), *[F.sum(v).alias(k) for k, v in sums.items()])


#: Capacities of the profile that travel together.
PROFILE_BLOCK = 1000
#: A profile of at most so many blocks (counted) goes to every task; a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 64


def scenario_batch(scenarios: DataFrame, forecast: DataFrame) -> DataFrame:
    """Net revenue in millions of every saved scenario over the whole schedule.

    The schedule is read once. Its profile has one row per capacity (a whole number of berths). It is packed into blocks of about
    PROFILE_BLOCK capacities, and each scenario meets each block by a join; no array grows with the data, and scenarios stay
    distributed, however many there are.
    """
    profile = settle(override_profile(forecast), "profile")
    blocks = max(1, -(-profile.count() // PROFILE_BLOCK))
    packed = profile.groupBy(F.pmod(F.xxhash64("lower_berth_capacity"), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(*profile.columns)).alias("_rows"))
    rows = scenarios.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(packed, "_block")
    rows = rows.select(*scenarios.columns, F.explode("_rows").alias("s"))
    o = {d: F.col(c) for d, c in OVERRIDE_COLUMNS.items()}
    lf = o["load_factor"]
    pax = F.when(lf.isNull(), 1.0).otherwise(truncate(F.col("s.lower_berth_capacity") * lf).cast("double"))
    part = lambda name: F.when(lf.isNull(), F.col(f"s.b_{name}")).otherwise(F.col(f"s.u_{name}"))
    per_diem = F.coalesce(o["gross_fare_per_diem"], F.lit(1.0))
    rest = F.coalesce(1.0 - o["discount_rate"], F.lit(1.0))
    on = {d: c.isNotNull() for d, c in o.items()}

    def choose(name: str, drivers: list[str]) -> Column:
        choice = None
        for bits in product((0, 1), repeat=len(drivers)):
            test = F.lit(True)
            for d, bit in zip(drivers, bits):
                test = test & (on[d] if bit else ~on[d])
            value = part(f"{name}_{''.join(map(str, bits))}")
            choice = F.when(test, value) if choice is None else choice.when(test, value)
        return choice

    price = ["gross_fare_per_diem", "discount_rate"]
    net = pax * (
        per_diem * rest * (
            choose("kept", price)
            - F.coalesce(o["commission_rate"], F.lit(1.0)) * choose("comm", [*price, "commission_rate"]))
        - F.coalesce(o["promo_cost_per_pax"], F.lit(1.0)) * choose("promo", ["promo_cost_per_pax"])
        - F.coalesce(o["air_inclusive_pct"], F.lit(1.0)) * choose("air", ["air_inclusive_pct"])
        - part("tax"))
    sums = rows.select("scenario_id", net.alias("net"), F.col("s.net").alias("base"))
    sums = sums.groupBy("scenario_id").agg(
        (F.sum("net") / 1e6).alias("scenario_ntr_m"), (F.sum("base") / 1e6).alias("baseline_ntr_m"))
    return scenarios.join(sums, "scenario_id", "left")


def _profile_blocks(profile: DataFrame) -> DataFrame:
    """The profile packed into blocks of about PROFILE_BLOCK rows: (``_block``, ``_rows``)."""
    blocks = max(1, -(-profile.count() // PROFILE_BLOCK))
    return profile.groupBy(F.pmod(F.xxhash64(*profile.columns[:2]), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(*profile.columns)).alias("_rows")), blocks


def scenario_draws(scenarios: DataFrame, profile: DataFrame, inputs: DataFrame, n: int = SIMULATIONS) -> DataFrame:
    """(scenario_id, draw_id, ntr_m): every saved scenario under the same ``n`` draws of noise.

    A draw sets each driver to the scenario's value plus the driver's historical deviation times a hashed normal
    number, the same numbers for every scenario and the same as ``monte_carlo``'s; a null override means the driver's
    baseline mean, as on the page where the sliders start at it. With all six drivers fixed, a draw needs only the
    profile by capacity and length (``schedule_profile``).

    The draws travel as one array of ``n`` rows, a bound of the method; the scenarios stay distributed, each
    (scenario, draw) meets the profile in blocks of PROFILE_BLOCK rows, and only one sum per (scenario, draw, block)
    leaves a task. Scenarios with an equal id are summed as one.
    """
    spark = scenarios.sparkSession
    stats = inputs.agg(*[F.max(F.when(F.col("driver") == d, F.col(c))).alias(f"{c}_{d}")
                         for d in OVERRIDABLE for c in ("baseline_mean", "std")]).select(F.struct("*")).scalar()
    noise = spark.range(n).select(F.collect_list(F.struct(
        F.col("id").alias("draw_id"), *[hashed_normal(F.col("id"), j).alias(f"z_{d}") for j, d in enumerate(OVERRIDABLE)]))).scalar()
    fixed = scenarios.select(
        "scenario_id", *[F.coalesce(F.col(c).cast("double") if c in scenarios.columns else F.lit(None).cast("double"),
                                    F.lit(None).cast("double")).alias(f"o_{d}") for d, c in OVERRIDE_COLUMNS.items()]
    ).withColumn("_s", stats).select(
        "scenario_id", *[F.coalesce(F.col(f"o_{d}"), F.col(f"_s.baseline_mean_{d}")).alias(f"v_{d}") for d in OVERRIDABLE],
        *[F.col(f"_s.std_{d}").alias(f"s_{d}") for d in OVERRIDABLE])
    drawn = fixed.select("*", F.inline(noise)).select(
        "scenario_id", "draw_id", *[(F.col(f"v_{d}") + F.col(f"s_{d}") * F.col(f"z_{d}")).alias(d) for d in OVERRIDABLE])
    packed, blocks = _profile_blocks(profile)
    ids = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    packed = F.broadcast(packed) if blocks <= BROADCAST_BLOCKS else packed
    rows = drawn.withColumn("_block", ids).join(packed, "_block").select(
        "scenario_id", "draw_id", *OVERRIDABLE, F.inline("_rows"))
    c = F.col
    pax = truncate(c("lower_berth_capacity") * c("load_factor"))
    kept = pax * c("gross_fare_per_diem") * c("itinerary_length") * (1.0 - c("discount_rate"))
    net = (kept * (c("n") - c("commission_rate") * c("agency_share"))
           - pax * (c("n") * c("promo_cost_per_pax") + c("air_inclusive_pct") * c("air_cost") + c("taxes")))
    return rows.groupBy("scenario_id", "draw_id").agg((F.sum(net) / 1e6).alias("ntr_m"))


def scenario_feasibility(scenarios: DataFrame, profile: DataFrame, inputs: DataFrame, n: int = SIMULATIONS) -> DataFrame:
    """Per saved scenario: target, simulations, P10, P50, P90 of the draws and the chance of reaching the target.

    The target is the scenario's ``target_ntr_m`` where it has one, else the default target of ``target_bounds``.
    A scenario without rows in the profile (empty schedule) has no draws and is not returned.
    """
    default = target_bounds(profile).select("default_target_m").scalar()
    targets = scenarios.select(
        "scenario_id", (F.col("target_ntr_m").cast("double") if "target_ntr_m" in scenarios.columns
                        else F.lit(None).cast("double")).alias("_t")).groupBy("scenario_id").agg(F.max("_t").alias("_t"))
    draws = scenario_draws(scenarios, profile, inputs, n).join(targets, "scenario_id").withColumn(
        "target_ntr_m", F.coalesce("_t", default))
    return draws.groupBy("scenario_id", "target_ntr_m").agg(
        F.count(F.lit(1)).alias("simulations"),
        F.percentile("ntr_m", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"),
        (F.avg((F.col("ntr_m") >= F.col("target_ntr_m")).cast("int")) * 100).alias("feasibility_pct"),
    ).select("scenario_id", "target_ntr_m", "simulations", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"),
             F.col("p")[2].alias("p90"), "feasibility_pct", feasibility_label(F.col("feasibility_pct")).alias("feasibility"))


def isolated_attribution(forecast: DataFrame, inputs: DataFrame) -> DataFrame:
    """Impact of each assumption alone, the other drivers left at row level."""
    singles = inputs.select(F.col("driver").alias("scenario_id"), *[
        F.when(F.col("driver") == d, F.col("value")).alias(c) for d, c in OVERRIDE_COLUMNS.items()])
    return scenario_batch(singles, forecast).select(
        F.col("scenario_id").alias("driver"), (F.col("scenario_ntr_m") - F.col("baseline_ntr_m")).alias("impact_m"))


def scenario_comparison(scenarios: DataFrame, forecast: DataFrame) -> DataFrame:
    """Saved scenarios beside the baseline total, newest first."""
    base = forecast.agg((F.sum("net_ticket_revenue") / 1e6).alias("b")).scalar()
    df = scenarios.withColumn("baseline_ntr_m", base)
    delta = F.col("scenario_ntr_m") - F.col("baseline_ntr_m")
    return df.withColumns({
        "delta_vs_baseline_m": delta,
        "pct_vs_baseline": floor_round(safe_div(delta, F.col("baseline_ntr_m")) * 100, 1),
    }).orderBy(F.desc("created_at"))
