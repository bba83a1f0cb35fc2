"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fairlead.llm import bpe, decontaminate, secretscan, simhash, toxicity  # noqa: E402
from fairlead.llm.tables import prepare_session, table  # noqa: E402
from fairlead.session import settle  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    prepare_session(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, a row with the smallest id; documents without an id stay.

    Rows are told apart by a written number, so that ids may repeat within and across groups.
    """
    prepare_session(spark)
    rows = settle(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    groups = settle(simhash.near_duplicates(rows, key="_row").select("_row", "component_id"), "near-duplicates")
    named = settle(rows.where("doc_id is not null").select("_row", "doc_id").join(groups, "_row"), "grouped-rows")
    kept = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("least")).select(F.col("least._row").alias("_row"))
    gone = settle(named.select("_row").join(kept, "_row", "left_anti"), "duplicate-rows")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    prepare_session(spark)
    return decontaminate.without_passages(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars counted anew."""
    prepare_session(spark)
    return secretscan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, their number, and the digest of the text they decode to."""
    prepare_session(spark)
    vocab = bpe.vocabulary()
    encoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), vocab, keep_text=False)
    return bpe.decode(encoded, vocab).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scans", secrets),
    ("bpe", tokens),
]

#: SQL cannot express the stages; tests compare the result with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table. Each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{name}")
    return docs
