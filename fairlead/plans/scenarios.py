"""Life cycle of saved scenarios: versions, computed columns written back, the comparison view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.constants import OVERRIDE_COLUMNS
from fairlead.operators import scenario as X
from fairlead.session import drop_folder, fresh_path
from fairlead.sources import store

#: Columns of the comparison view, in its order.
COMPARISON_COLUMNS = [
    "scenario_id", "scenario_name", "created_by", "created_at", "target_ntr_m", "scenario_ntr_m", "feasibility_pct",
    "baseline_ntr_m", "delta_vs_baseline_m", "pct_vs_baseline", *OVERRIDE_COLUMNS.values(), "notes"]


def write_back(spark: SparkSession, path: str, forecast: DataFrame, profile: DataFrame, inputs: DataFrame) -> int:
    """Store scenario revenue and feasibility of the newest version of every scenario as a new version.

    Revenue applies the overrides to every sailing, a null override keeping the sailing's own driver
    (``scenario_batch``); feasibility draws all six drivers around the overrides, a null one around its baseline mean
    (``scenario_feasibility``). Runs jobs while called; the newest rows are staged once in the shared folder.
    """
    staged = fresh_path(spark, "scenarios-newest")
    store.newest_scenarios(spark, path).drop("scenario_ntr_m", "feasibility_pct").write.parquet(staged)
    base = spark.read.parquet(staged)
    revenue = X.scenario_batch(base, forecast).select("scenario_id", "scenario_ntr_m")
    chance = X.scenario_feasibility(base, profile, inputs).select("scenario_id", "feasibility_pct")
    version = store.save_scenario_versions(
        base.join(revenue, "scenario_id", "left").join(chance, "scenario_id", "left"), path)
    drop_folder(spark, staged)
    return version


def comparison(spark: SparkSession, path: str, reporting_view: DataFrame) -> DataFrame:
    """The newest saved scenarios beside the baseline total of the reporting view: 17 columns, newest first."""
    compared = X.scenario_comparison(store.newest_scenarios(spark, path), reporting_view)
    return compared.select(*COMPARISON_COLUMNS)


def register_scenario_views(spark: SparkSession, path: str, reporting_view: DataFrame) -> None:
    """Named views ``walk_to_target_runs`` (newest versions) and ``v_scenario_comparison``; plans, nothing copied."""
    store.newest_scenarios(spark, path).createOrReplaceTempView("walk_to_target_runs")
    comparison(spark, path, reporting_view).createOrReplaceTempView("v_scenario_comparison")
