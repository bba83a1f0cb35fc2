import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

CHECKED = [
    "facts_history", "facts_future", "baseline_forecast", "monthly_drivers", "driver_distributions", "driver_stats",
    "seasonal_medians_sets", "kpi_dashboard", "prior_year_compare", "period_table_formatted", "waterfall_steps",
    "dense_grid", "fc_sar1", "fc_ets_level", "best_model", "assemble_forecast", "v_baseline_forecast",
    "scenario_result", "attribution_steps", "montecarlo_summary", "scenario_batch", "sql_surface", "constraint_report",
]


def test_entry_has_rows(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    from check import compare, duck
    from fairlead.catalog import ORACLES, QUERIES
    ok, text = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, text
