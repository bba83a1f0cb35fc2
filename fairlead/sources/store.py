"""Forecast and scenario tables, physical layout and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.sources.schemas import RESULTS, RESULTS_KEY, SCENARIOS


def append_results(results: DataFrame, path: str) -> DataFrame:
    """Append forecast rows, one folder per run, and return the run status.

    The count is taken while writing, not by a second pass.
    """
    rows = results.select(*RESULTS.fieldNames())
    spark = results.sparkSession
    run = read_observed(rows, path)
    status = T.StructType([
        T.StructField("status", T.StringType()), T.StructField("run_id", T.StringType()),
        T.StructField("rows_written", T.LongType()), T.StructField("horizon_months", T.LongType())])
    return spark.createDataFrame([("success", run["run_id"], run["n"], run["horizon"])], status)


def read_observed(rows: DataFrame, path: str) -> dict:
    from pyspark.sql import Observation

    seen = Observation("run")
    rows = rows.observe(
        seen, F.count(F.lit(1)).alias("n"), F.max("run_id").alias("run_id"),
        F.max("horizon_month").cast("bigint").alias("horizon"))
    rows.write.mode("append").partitionBy("run_id").parquet(path)
    return seen.get


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).parquet(path)


def latest_run(results: DataFrame) -> DataFrame:
    """Rows of the highest run id; on the stored table only that run's folder is read."""
    newest = results.agg(F.max("run_id")).scalar()
    return results.where(F.col("run_id") == newest)


def save_scenarios(df: DataFrame, path: str) -> None:
    """Append scenarios; id and time are filled where absent, missing columns are null."""
    filled = {
        "scenario_id": F.coalesce(F.col("scenario_id"), F.expr("uuid()")) if "scenario_id" in df.columns else F.expr("uuid()"),
        "created_at": F.localtimestamp() if "created_at" not in df.columns
        else F.coalesce(F.col("created_at"), F.localtimestamp()),
    }
    df = df.withColumns(filled)
    df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCENARIOS.fields
    ]).write.mode("append").parquet(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENARIOS).parquet(path)


def write_clustered(df: DataFrame, path: str, date: str = "departure_date", then: tuple[str, ...] = ("brand", "trade")) -> None:
    """Write by month folder, ordered inside, so that date, brand and trade filters skip files and row groups.

    Range partitioning splits a crowded month over several tasks instead of sending it to one.
    """
    month = F.date_format(date, "yyyy-MM")
    (
        df.withColumn("departure_ym", month)
        .repartitionByRange("departure_ym", date, *then)
        .sortWithinPartitions("departure_ym", date, *then)
        .write.mode("append").partitionBy("departure_ym").parquet(path)
    )


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def constraint_report(df: DataFrame, schema: T.StructType, key: list[str], table: str) -> DataFrame:
    """(table, rule, column, violations): nulls in required columns and surplus rows per key."""
    required = [f.name for f in schema.fields if not f.nullable and f.name in df.columns]
    nulls = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in required])
    rows = F.array(*[
        F.struct(F.lit("not null").alias("rule"), F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("violations"))
        for c in required])
    surplus = df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("violations"))
    keyed = surplus.select(F.lit("primary key").alias("rule"), F.lit(", ".join(key)).alias("column"), "violations")
    return nulls.select(F.inline(rows)).unionByName(keyed).select(F.lit(table).alias("table"), "rule", "column", "violations")


# versioned scenario store -------------------------------------------------------------------------

#: Folders of the versioned scenario store; an id always lands in the same one.
SCENARIO_BUCKETS = 16
STORED_SCENARIOS = T.StructType([*SCENARIOS.fields, T.StructField("deleted", T.BooleanType()),
                                 T.StructField("version", T.LongType()), T.StructField("seq", T.LongType())])


def _next_version(spark: SparkSession, path: str) -> int:
    """Microseconds of the driver's clock, above every stored version."""
    import time

    now = time.time_ns() // 1000
    try:
        stored = spark.read.schema(STORED_SCENARIOS).parquet(path).agg(F.max("version")).first()[0]
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
        stored = None
    return max(now, (stored or 0) + 1)


def save_scenario_versions(df: DataFrame, path: str, deleted: bool = False) -> int:
    """Append one new version of every row of ``df`` and return its number.

    Ids and times are filled where absent; absent columns are null. Rows of one id in the same save are ordered by
    ``seq``, the last wins. A save is one Spark job whose files appear only when it commits: a failed save leaves the
    table as it was. ``deleted`` writes tombstones, which hide the ids from ``newest_scenarios``.
    """
    spark = df.sparkSession
    version = _next_version(spark, path)
    filled = {
        "scenario_id": F.coalesce(F.col("scenario_id"), F.expr("uuid()")) if "scenario_id" in df.columns else F.expr("uuid()"),
        "created_at": F.localtimestamp() if "created_at" not in df.columns
        else F.coalesce(F.col("created_at"), F.localtimestamp()),
    }
    df = df.withColumns(filled)
    rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in SCENARIOS.fields])
    rows = rows.select("*", F.lit(deleted).alias("deleted"), F.lit(version).alias("version"),
                       F.monotonically_increasing_id().alias("seq"),
                       F.pmod(F.xxhash64("scenario_id"), F.lit(SCENARIO_BUCKETS)).cast("int").alias("bucket"))
    rows.write.mode("append").partitionBy("bucket").parquet(path)
    return version


def delete_scenarios(ids: DataFrame, path: str) -> int:
    """Tombstones for the ids in column ``scenario_id`` of ``ids``."""
    return save_scenario_versions(ids.select("scenario_id").distinct(), path, deleted=True)


def newest_scenarios(spark: SparkSession, path: str, with_deleted: bool = False) -> DataFrame:
    """The newest version of every scenario id, by ``max_by`` over (version, seq); tombstoned ids are left out.

    One aggregation by id: an id's versions meet in one task, and their number is bounded by the saves of that id.
    """
    stored = spark.read.schema(STORED_SCENARIOS).parquet(path)
    columns = [f.name for f in SCENARIOS.fields] + ["deleted", "version", "seq"]
    newest = stored.groupBy("scenario_id").agg(
        F.max_by(F.struct(*columns), F.struct("version", "seq")).alias("r")).select("r.*")
    return newest if with_deleted else newest.where(~F.col("deleted")).drop("deleted", "version", "seq")


def compact_scenarios(spark: SparkSession, path: str) -> None:
    """Keep only the newest version of every id (tombstones included), bucket by bucket.

    The newest rows are first written to the shared folder; the buckets that hold them are then replaced by a
    dynamic partition overwrite, other buckets are not touched. A failure before the overwrite's commit leaves all
    versions readable, and reading the newest gives the same rows before and after.
    """
    from fairlead.session import drop_folder, fresh_path

    staged = fresh_path(spark, "scenario-compaction")
    newest = newest_scenarios(spark, path, with_deleted=True)
    newest.withColumn("bucket", F.pmod(F.xxhash64("scenario_id"), F.lit(SCENARIO_BUCKETS)).cast("int")).write.parquet(staged)
    (spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    drop_folder(spark, staged)


# write, audit, publish of forecast runs ---------------------------------------------------------------

MANIFEST = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("rows_written", T.LongType()),
    T.StructField("horizon_months", T.LongType()), T.StructField("published_at", T.TimestampNTZType())])
STATUS = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("rows_written", T.LongType()), T.StructField("horizon_months", T.LongType()),
    T.StructField("violations", T.LongType())])


def manifest_path(path: str) -> str:
    """The run manifest beside the result table: one line per publication."""
    return path.rstrip("/") + "_runs"


def publish_run(results: DataFrame, path: str) -> DataFrame:
    """Stage, audit and publish one run; returns one status row.

    Stage: the rows go to a folder of their own in the shared folder, counted while written; a failure there
    publishes nothing. Audit: required columns not null, the result key unique, exactly one run id; a run that
    fails is ``rejected`` and not published. Publish: the run's own partition of the table is replaced by a
    dynamic partition overwrite, so a repeated run id replaces its rows instead of doubling them, and one line is
    appended to the manifest. Readers that go through the manifest never see a run before its line is written.
    """
    from fairlead.session import drop_folder, fresh_path

    spark = results.sparkSession
    staged = fresh_path(spark, "run-staging")
    seen = read_observed_plain(results.select(*RESULTS.fieldNames()), staged)
    rows = spark.read.schema(RESULTS).parquet(staged)
    report = constraint_report(rows, RESULTS, RESULTS_KEY, "staged")
    violations = report.agg(F.sum("violations")).first()[0] or 0
    runs = rows.select("run_id").distinct().limit(2).count()
    status = "published" if violations == 0 and runs == 1 else "rejected"
    violations += 0 if runs == 1 else 1
    if status == "published":
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))
        spark.createDataFrame([(seen["run_id"], seen["n"], seen["horizon"])], "run_id string, rows_written long, horizon_months long").select(
            "run_id", "rows_written", "horizon_months", F.localtimestamp().alias("published_at")).write.mode("append").parquet(manifest_path(path))
    drop_folder(spark, staged)
    return spark.createDataFrame([(status, seen["run_id"], seen["n"], seen["horizon"], int(violations))], STATUS)


def read_observed_plain(rows: DataFrame, path: str) -> dict:
    """Write ``rows`` to ``path`` (no partitions) and return their count, largest run id and horizon."""
    from pyspark.sql import Observation

    seen = Observation("staged")
    rows.observe(seen, F.count(F.lit(1)).alias("n"), F.max("run_id").alias("run_id"),
                 F.max("horizon_month").cast("bigint").alias("horizon")).write.parquet(path)
    return seen.get


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(manifest_path(path))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of the runs in the manifest only."""
    runs = read_manifest(spark, path).select("run_id").distinct()
    return read_results(spark, path).join(runs, "run_id", "left_semi")


def latest_published(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the highest published run id; the manifest names it and only that run's folder is read."""
    newest = read_manifest(spark, path).agg(F.max("run_id")).scalar()
    return read_results(spark, path).where(F.col("run_id") == newest)
