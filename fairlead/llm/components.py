"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.session import drop_folder, fresh_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and is not itself a root; root is the smallest reachable node.

    ``edges`` has two bigint columns u and v in any order; loops and repeats do no harm. Each round is written to
    the shared folder, so plans stay short and lost executors cost a re-read; the round before is then removed. Rounds
    grow with the logarithm of the longest path. A hub's edges meet its minimum in a plain join, which adaptive
    execution splits. Runs jobs while it is called.
    """
    spark = edges.sparkSession
    schema = "u bigint, v bigint"

    def put(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = fresh_path(spark, "star")
        df.write.parquet(path)
        saved = spark.read.schema(schema).parquet(path)
        return path, saved, tuple(saved.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    path, now, mark = put(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark[0]:
        new_path, new, new_mark = put(_small_star(_large_star(now)))
        drop_folder(spark, path)
        done, path, now, mark = new_mark == mark, new_path, new, new_mark
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
