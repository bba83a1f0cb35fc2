import datetime as dt

from pyspark.sql import functions as F

from fairlead.plans import incremental as I
from fairlead.session import fresh_path
from fairlead.sources import schemas
from test_drivers import sailings


def _history(spark):
    return spark.createDataFrame(sailings(600, seed=3)).select(*schemas.HISTORY.fieldNames())


def test_three_loads_equal_one_full_load(spark):
    hist = _history(spark)
    one_loads, one_parts = fresh_path(spark, "loads"), fresh_path(spark, "parts")
    I.append_load(hist, one_loads, I.load_key(dt.datetime(2001, 1, 1)))
    I.refresh_monthly(spark, one_loads, one_parts)
    loads, parts = fresh_path(spark, "loads"), fresh_path(spark, "parts")
    for k in range(3):
        I.append_load(hist.where(F.pmod(F.xxhash64("sailing_id"), F.lit(3)) == k).repartition(k + 1), loads,
                      I.load_key(dt.datetime(2001, 1, 1 + k)))
        assert I.refresh_monthly(spark, loads, parts) == I.load_key(dt.datetime(2001, 1, 1 + k))
    assert I.refresh_monthly(spark, loads, parts) is None
    once = sorted(tuple(r) for r in I.read_monthly(spark, one_parts).collect())
    thrice = sorted(tuple(r) for r in I.read_monthly(spark, parts).collect())
    assert once == thrice and len(once) > 10


def test_refresh_reads_new_loads_and_rewrites_touched_months_only(spark):
    hist = _history(spark)
    loads, parts = fresh_path(spark, "loads"), fresh_path(spark, "parts")
    I.append_load(hist, loads, I.load_key(dt.datetime(2001, 1, 1)))
    I.refresh_monthly(spark, loads, parts)
    before = {r.month: r for r in I.read_monthly(spark, parts).groupBy("month").agg(F.sum("n_sailings").alias("n")).collect()}
    late = hist.limit(1).withColumn("sailing_id", F.lit(10**9))
    I.append_load(late, loads, I.load_key(dt.datetime(2001, 2, 1)))
    plan = I.read_loads(spark, loads, I.load_key(dt.datetime(2001, 1, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "_load" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = set(spark.read.parquet(parts).inputFiles())
    I.refresh_monthly(spark, loads, parts)
    after = {r.month: r for r in I.read_monthly(spark, parts).groupBy("month").agg(F.sum("n_sailings").alias("n")).collect()}
    changed = [m for m in after if after[m].n != before[m].n]
    assert len(changed) == 1
    kept = set(spark.read.parquet(parts).inputFiles()) & files
    assert kept and all(str(changed[0]) not in f for f in kept)
