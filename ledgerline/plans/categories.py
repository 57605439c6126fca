"""New-SKU resolution: corrected category references published as versions.

:func:`publish_categories` writes a version under a label of the caller's choice, for
one publisher at a time. :func:`commit_categories` is for several: versions are numbered
by a log, and whoever comes second builds on the version that came first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import upsert
from ledgerline.schemas import schema
from ledgerline.session import create_once, delete_path, hadoop_path, read_small
from ledgerline.sources import read_report, write_report

COLUMNS = ["sku", "sku_name", "category"]


def publish_categories(category: DataFrame, updates: DataFrame, path: str, version: str) -> int:
    """Apply ``(sku, sku_name, category)`` corrections and write the result as version ``version``.

    Matched SKUs take the new category and name; new SKUs are inserted. The
    result goes to a new partition of ``path``, never over the version being
    read. Returns the rows written.
    """
    merged = upsert(category.select("sku", "sku_name", "category"), updates.select("sku", "sku_name", "category"),
                    "sku", ["category", "sku_name"])
    return write_report(merged.select("sku", "sku_name", "category"), path, version, sort_by=["sku"])


def latest_categories(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version of the category reference.

    Labels that are all dates compare as dates, labels that are all numbers as
    numbers, others as text. Only the version labels reach the driver; the read is
    pruned to that partition.
    """
    versions = spark.read.parquet(path).select(F.col("report_date").cast("string").alias("v")).distinct()
    day, number = F.col("v").try_cast("date"), F.col("v").try_cast("double")
    kinds = versions.agg(F.bool_and(day.isNotNull()).alias("days"), F.bool_and(number.isNotNull()).alias("numbers")).first()
    # A number such as 2024 also reads as a date; as numbers their order is the same.
    key = number if kinds["numbers"] else day if kinds["days"] else F.col("v")
    newest = versions.agg(F.max_by("v", key).alias("v")).first()["v"]
    return read_report(spark, path, newest).drop("report_date")


def committed_version(spark: SparkSession, path: str) -> int:
    """The number of the newest committed version; 0 before the first."""
    log, filesystem = hadoop_path(spark, f"{path.rstrip('/')}/_log")
    if not filesystem.exists(log):
        return 0
    names = [f.getPath().getName() for f in filesystem.listStatus(log)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def committed_categories(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A committed version of the category reference (the newest unless one is named); an empty table before the first."""
    number = committed_version(spark, path) if version is None else version
    if not number:
        return spark.createDataFrame([], schema("category"))
    folder = read_small(spark, f"{path.rstrip('/')}/_log/{number:012d}")
    return spark.read.schema(schema("category")).parquet(f"{path.rstrip('/')}/{folder}")


def commit_categories(spark: SparkSession, path: str, updates: DataFrame, attempts: int = 10,
                      before_commit: Callable[[int], None] | None = None) -> int:
    """Apply ``(sku, sku_name, category)`` corrections to the newest version and commit the result as the next one.

    The rows are written to a folder of their own; the version exists once its log
    entry does, and only one publisher can create the entry of a number. One that finds
    it taken drops its rows, applies its corrections to the version that took it, and
    tries the next number. Readers see whole versions only. Returns the version number;
    ``before_commit`` is called with it before each try.
    """
    root = path.rstrip("/")
    for _ in range(attempts):
        seen = committed_version(spark, root)
        merged = upsert(committed_categories(spark, root, seen), updates.select(*COLUMNS), "sku", ["category", "sku_name"])
        folder = f"rows-{uuid.uuid4().hex}"
        merged.select(*COLUMNS).write.parquet(f"{root}/{folder}")
        if before_commit:
            before_commit(seen + 1)
        if create_once(spark, f"{root}/_log/{seen + 1:012d}", folder):
            return seen + 1
        delete_path(spark, f"{root}/{folder}")
    raise RuntimeError(f"{root}: other publishers committed first {attempts} times")
