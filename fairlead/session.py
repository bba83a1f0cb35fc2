"""Session helpers: shared folder and small settled tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for written tables and checkpoints, one that the driver and all executors see.

    The folder the cluster names in ``spark.checkpoint.dir``, else the session's checkpoint folder, else a
    folder in the warehouse. A warehouse on a machine's own disk is shared only when everything runs on
    that machine; on a cluster this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    own = f"{warehouse}/_work"
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write an aggregated or slim table to the shared folder and read it back.

    Plans built on it start at a plain scan: its real size is known, so the planner broadcasts it only
    below its own threshold and otherwise does not; lost executors cost nothing but a re-read.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate table once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
