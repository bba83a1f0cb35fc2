"""Reading the corpus tables, and helpers the operators share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

#: Characters that separate words: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus table; columns beyond the known ones are not read."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id"):
    """crc32 of an id written as text; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def prepare_session(spark: SparkSession) -> None:
    """Settings for operators that run Python on the executors.

    Rows reach Python in batches bounded by rows and bytes, so that memory follows neither long texts nor large partitions.
    On this machine workers may import the package when only the driver's path has it; on a cluster the package is installed
    or sent with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
