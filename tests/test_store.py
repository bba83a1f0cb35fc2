import datetime as dt

from pyspark.sql import functions as F

from fairlead.plans.runs import baseline_view, uncovered_sailings
from fairlead.session import fresh_path, settle, shared_folder
from fairlead.sources.sailings import read_schedule
from fairlead.sources import schemas, store


def result(run, day, brand="A", lf=0.8):
    return (run, dt.datetime(2000, 8, 1), day, brand, "T", "C", 1, lf, lf - .1, lf + .1, 200.0, 180.0, 220.0,
            0.1, 0.1, 0.2, 300.0, 40.0, 90.0, 0.25, "m", "m")


def schedule(spark, *rows):
    return spark.createDataFrame([(i, "S", "C", b, "T", 7, d, cap) for i, b, d, cap in rows], schemas.SCHEDULE)


def test_runs_append_and_latest(spark):
    path = fresh_path(spark, "results")
    day = dt.date(2000, 8, 1)
    for run, lf in (("2000-07-01", 0.5), ("2000-08-01", 0.8)):
        status = store.append_results(spark.createDataFrame([result(run, day, lf=lf)], schemas.RESULTS), path).first()
        assert (status.status, status.run_id, status.rows_written, status.horizon_months) == ("success", run, 1, 1)
    table = store.read_results(spark, path)
    assert table.count() == 2
    newest = store.latest_run(table)
    assert [r.load_factor_fcst for r in newest.collect()] == [0.8]
    assert "run_id" in newest._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    store.append_results(spark.createDataFrame([result("2000-08-01", day)], schemas.RESULTS), path)
    assert store.duplicate_keys(store.read_results(spark, path), schemas.RESULTS_KEY).first().n == 2


def test_view_joins_the_month_and_reports_the_rest(spark):
    results = spark.createDataFrame([result("r", dt.date(2000, 8, 1))], schemas.RESULTS)
    future = schedule(spark, (1, "A", dt.date(2000, 8, 20), 101), (2, "A", dt.date(2000, 9, 1), 100), (3, "B", dt.date(2000, 8, 2), 100))
    rows = baseline_view(future, results).collect()
    assert [r.sailing_id for r in rows] == [1]
    pax = 101 * 0.8
    assert rows[0].passengers_forecast == 81.0 and rows[0].gross_ticket_revenue == float(int(pax * 200 * 7 + 0.5))
    assert rows[0].forecast_quarter == 3 and rows[0].forecast_run_id == "r"
    assert sorted(r.sailing_id for r in uncovered_sailings(future, results).collect()) == [2, 3]


def test_constraints(spark):
    bad = spark.createDataFrame(
        [(1, "S", "C", "A", "T", 7, dt.date(2000, 1, 1), 10), (1, None, "C", "A", "T", 7, dt.date(2000, 1, 1), 10)],
        "sailing_id long, ship_name string, ship_class string, brand string, trade string, itinerary_length int, "
        "departure_date date, lower_berth_capacity int")
    got = {(r.rule, r.column): r.violations for r in store.constraint_report(bad, schemas.SCHEDULE, ["sailing_id"], "t").collect()}
    assert got[("not null", "ship_name")] == 1 and got[("not null", "brand")] == 0 and got[("primary key", "sailing_id")] == 1
    empty = store.constraint_report(bad.where("false"), schemas.SCHEDULE, ["sailing_id"], "t").collect()
    assert all(r.violations == 0 for r in empty)


def test_saved_scenarios_get_defaults(spark):
    path = fresh_path(spark, "scenarios")
    store.save_scenarios(spark.createDataFrame([("x", 0.9)], "scenario_name string, load_factor_override double"), path)
    store.save_scenarios(spark.createDataFrame([("id1", "y")], "scenario_id string, scenario_name string"), path)
    rows = {r.scenario_name: r for r in store.read_scenarios(spark, path).collect()}
    assert len(rows["x"].scenario_id) == 36 and rows["x"].created_at is not None and rows["x"].notes is None
    assert rows["y"].scenario_id == "id1" and rows["y"].load_factor_override is None


def test_clustered_layout_prunes(spark):
    path = fresh_path(spark, "clustered")
    df = schedule(spark, *[(i, "AB"[i % 2], dt.date(2000, 1 + i % 12, 1 + i % 28), 100) for i in range(200)])
    store.write_clustered(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 200
    one = back.where(F.col("departure_ym") == "2000-03")
    assert one.count() == df.where(F.month("departure_date") == 3).count()


def test_date_ranges_prune_folders_and_row_groups(spark):
    path = fresh_path(spark, "clustered")
    df = schedule(spark, *[(i, "AB"[i % 2], dt.date(2000, 1 + i % 12, 1 + i % 28), 100) for i in range(200)])
    store.write_clustered(df, path)
    got = read_schedule(spark, path, "2000-03-05", "2000-05-02", ["A"])
    want = df.where("departure_date >= '2000-03-05' and departure_date < '2000-05-02' and brand = 'A'")
    assert {r.sailing_id for r in got.collect()} == {r.sailing_id for r in want.collect()} and want.count() > 0
    plan = got._jdf.queryExecution().sparkPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split(", PushedFilters")[0]
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "departure_ym" in folders and "departure_date" in pushed and "brand" in pushed


def test_months_later_keeps_to_the_calendar():
    from fairlead.sources.standin import _months_later
    assert [_months_later("2000-08-31", k) for k in (1, 6, 12, 18)] == ["2000-09-30", "2001-02-28", "2001-08-31", "2002-02-28"]


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = settle(spark.range(3).toDF("a"))
    assert df.count() == 3 and all(shared_folder(spark) in f for f in df.inputFiles())


def _scenario(spark, *rows):
    return spark.createDataFrame(rows, "scenario_id string, scenario_name string, load_factor_override double, notes string")


def test_scenario_versions_newest_and_tombstones(spark):
    path = fresh_path(spark, "versioned")
    v1 = store.save_scenario_versions(_scenario(spark, ("a", "first", 0.8, None), ("b", "bee", None, "n")), path)
    v2 = store.save_scenario_versions(_scenario(spark, ("a", "second", 0.9, "edited")), path)
    assert v2 > v1
    newest = {r.scenario_id: r for r in store.newest_scenarios(spark, path).collect()}
    assert newest["a"].scenario_name == "second" and newest["a"].load_factor_override == 0.9 and newest["b"].notes == "n"
    assert set(store.newest_scenarios(spark, path).columns) == set(schemas.SCENARIOS.fieldNames())
    store.delete_scenarios(_scenario(spark, ("b", None, None, None)), path)
    assert [r.scenario_id for r in store.newest_scenarios(spark, path).collect()] == ["a"]
    store.save_scenario_versions(_scenario(spark, ("b", "back", 0.7, None)), path)
    assert sorted(r.scenario_id for r in store.newest_scenarios(spark, path).collect()) == ["a", "b"]


def test_failed_save_leaves_the_table_readable(spark):
    path = fresh_path(spark, "versioned")
    store.save_scenario_versions(_scenario(spark, ("a", "kept", 0.8, None)), path)
    broken = _scenario(spark, ("a", "lost", 0.1, None), ("c", "lost", 0.1, None)).withColumn(
        "notes", F.when(F.col("scenario_id") == "c", F.raise_error(F.lit("disk gone"))).otherwise(F.lit("x")))
    try:
        store.save_scenario_versions(broken, path)
        raise AssertionError("the save should fail")
    except Exception as error:
        assert "disk gone" in str(error)
    rows = store.newest_scenarios(spark, path).collect()
    assert [(r.scenario_id, r.scenario_name) for r in rows] == [("a", "kept")]


def test_compaction_keeps_the_newest_rows_only(spark):
    path = fresh_path(spark, "versioned")
    for i in range(3):
        store.save_scenario_versions(_scenario(spark, *[(f"s{k}", f"v{i}", 0.5 + i / 10, None) for k in range(20)]), path)
    store.delete_scenarios(_scenario(spark, ("s3", None, None, None)), path)
    before = sorted(tuple(r) for r in store.newest_scenarios(spark, path).collect())
    store.compact_scenarios(spark, path)
    stored = spark.read.schema(store.STORED_SCENARIOS).parquet(path)
    assert stored.count() == 20 and stored.groupBy("scenario_id").count().where("count > 1").count() == 0
    assert sorted(tuple(r) for r in store.newest_scenarios(spark, path).collect()) == before
    assert len(before) == 19 and {r[1] for r in before} == {"v2"}


def test_repeated_ids_in_one_save_keep_the_last(spark):
    path = fresh_path(spark, "versioned")
    rows = _scenario(spark, ("a", "one", 0.1, None), ("a", "two", 0.2, None)).coalesce(1)
    store.save_scenario_versions(rows, path)
    assert [r.scenario_name for r in store.newest_scenarios(spark, path).collect()] == ["two"]


def test_publish_replaces_a_repeated_run_and_keeps_failed_ones_out(spark):
    path = fresh_path(spark, "published")
    day = dt.date(2000, 8, 1)
    first = store.publish_run(spark.createDataFrame([result("2000-07-01", day, lf=0.5)], schemas.RESULTS), path).first()
    assert (first.status, first.rows_written, first.violations) == ("published", 1, 0)
    two = [result("2000-08-01", day, lf=0.8), result("2000-08-01", day, brand="B", lf=0.7)]
    store.publish_run(spark.createDataFrame(two, schemas.RESULTS), path)
    again = store.publish_run(spark.createDataFrame(two, schemas.RESULTS), path).first()
    assert again.status == "published"
    table = store.read_published(spark, path)
    assert table.count() == 3 and store.duplicate_keys(table, schemas.RESULTS_KEY).count() == 0
    broken = spark.createDataFrame([result("2000-09-01", day)], schemas.RESULTS).withColumn(
        "brand", F.raise_error(F.lit("executor lost for good")))
    try:
        store.publish_run(broken, path)
        raise AssertionError("the run should fail")
    except Exception as error:
        assert "executor lost for good" in str(error)
    bad = spark.createDataFrame([result("2000-10-01", day), result("2000-10-01", day)], schemas.RESULTS)
    rejected = store.publish_run(bad, path).first()
    assert rejected.status == "rejected" and rejected.violations == 1
    assert sorted(r.run_id for r in store.read_manifest(spark, path).collect()) == ["2000-07-01", "2000-08-01", "2000-08-01"]
    assert store.read_published(spark, path).count() == 3
    newest = store.latest_published(spark, path)
    assert sorted(r.load_factor_fcst for r in newest.collect()) == [0.7, 0.8]
