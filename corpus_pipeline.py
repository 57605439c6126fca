"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Every stage works on all rows its predecessor kept. All but the last return the
columns of ``documents``; the mix repeats a document as often as it takes it. Decisions
are made on narrow tables with each document's place in its file; texts are read
again and filtered, never shuffled or staged beside the stages' own results.

Null and empty texts fail the host rules' least number of words, null sources are a host
and a source of their own, null ids take part. Exact repeats are near-duplicates of each
other: one stays. Texts of any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import host_rules, mixing, nbsvm, packing, simhash
from ledgerline.llm.common import bounded, keep_rows, keyed, stage, table, unstage
from ledgerline.llm.queries import WEIGHTS, quality_model, vocabulary


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, fitted to the labelled documents, calls good."""
    scored = nbsvm.score(docs, quality_model(spark, docs, sf_dir), docs.columns)
    return scored.filter("predicted = 1").select("_row.*")


@bounded
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and come from hosts that pass theirs."""
    rows = keyed(docs)
    read = rows.select("_file", "_at", F.col("_row.source").alias("source"), F.col("_row.text").alias("text"))
    kept = host_rules.host_rules(read, ["_file", "_at"]).filter("kept").select("_row.*")
    return keep_rows(rows, kept).select("_row.*")


@bounded
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every near-duplicate component."""
    return simhash.keep_one(docs, docs.columns)


@bounded
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents as the mix of sources says."""
    mixed = mixing.mix(docs, docs.columns, WEIGHTS).filter("epochs > 0")
    return mixed.withColumn("_n", F.explode(F.expr("sequence(1, epochs)"))).select("_row.*")


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality", quality), ("rules", rules), ("dedup", dedup), ("mixture", mixture), ("packing", packed)]

# The classifier, the fingerprints and the packer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        done = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
