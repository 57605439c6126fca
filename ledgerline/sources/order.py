"""A global row order for writes, without a second copy of the rows.

Spark's own range partitioner samples the plan it orders, so the plan runs twice or
its rows are staged. Here bounds come from the key columns alone, best of a table
whose keys are spread alike (the extract behind a report): any bounds give the right
order, good ones give even files. The rows are then computed once, dealt to their
range, sorted there and written.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.session import hadoop_path

# Sampled keys for each range; rows of a range, where there are ranges enough for all cores.
SAMPLE = 60
FULL_RANGE, LEAST_RANGE = 250_000, 10_000
# Children of a node in the search tree of the bounds.
FANOUT = 16
# Rows of a pass, and the most passes of one ordered table; every pass is a job of its own.
PASS_ROWS, MOST_PASSES = 1_000_000, 16
# Rows of a task that splits a staged part, where there are tasks enough for all cores: it writes a file for each split.
TASK_ROWS = 500_000
# Texts with about as many values as rows: dictionaries of them take more room than the texts.
KEY_TEXTS = ("customer_id", "customer_name", "doc_no", "order_no", "sku")


def compact(keys: Sequence[str] = KEY_TEXTS) -> dict[str, str]:
    """Parquet options for tables whose room on disk counts."""
    return {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", **{f"parquet.enable.dictionary#{c}": "false" for c in keys}}


def _order(keys: Sequence[str]) -> Column:
    """The keys as one comparable value, missing ones last."""
    parts = []
    for i, k in enumerate(keys):
        parts += [F.col(k).isNull().alias(f"n{i}"), F.col(k).alias(f"k{i}")]
    return F.struct(*parts)


def key_bounds(like: DataFrame, keys: Sequence[str], ranges: int, rows: int) -> list:
    """About ``ranges - 1`` keys that part ``like`` evenly, in order; a bounded sample reaches the driver."""
    share = min(1.0, SAMPLE * ranges / max(rows, 1))
    some = like.select(_order(keys).alias("o"))
    # Every partition is sampled by a task of its own; only the sampled keys meet in one.
    some = (some.sample(share, seed=11) if share < 1 else some).repartition(1).sortWithinPartitions("o").collect()
    picked = [some[len(some) * i // ranges]["o"] for i in range(1, ranges)] if some else []
    return [b for i, b in enumerate(picked) if i == 0 or b != picked[i - 1]]


def _levels(bounds: list) -> list[list[tuple[int, list]]]:
    """The bounds as levels of a search tree, from the top: rows of a node's number and its bounds.

    The child of node ``n`` after ``c`` of its bounds is node ``n * FANOUT + c``; the
    numbers of the last level's children are those of the ranges. A row thus meets ``FANOUT``
    bounds at each of a few levels, never the whole list.
    """
    levels, width = [], 1
    while width <= len(bounds):
        width *= FANOUT
    while width > 1:
        step = width // FANOUT  # ranges of a child
        ends = range(0, len(bounds) + 1, width)
        levels.append([(n, [bounds[i - 1] for i in range(start + step, min(start + width, len(bounds) + 1), step)]) for n, start in enumerate(ends)])
        width = step
    return levels


def _like(df: DataFrame, keys: Sequence[str], like: DataFrame | None) -> DataFrame:
    """The key columns of ``like``, in the types of ``df``; by default those of ``df`` itself."""
    return df.select(*keys) if like is None else like.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys])


def _past(low: int, high: int) -> Column:
    """How many of ``__bounds`` the ``__key`` is not below, known to be from ``low`` to ``high``: a binary search that compiles."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    # A bound that is not there compares as NULL, so the search goes on below it.
    return F.when(F.get("__bounds", F.lit(mid)) <= F.col("__key"), _past(mid + 1, high)).otherwise(_past(low, mid))


def _numbered(df: DataFrame, keys: Sequence[str], bounds: list, like: DataFrame) -> DataFrame:
    """``df`` with ``__range``: how many of the bounds, which were taken from ``like``, a row's key is not below."""
    out = df.withColumns({"__range": F.lit(0), "__key": _order(keys)})
    for level in _levels(bounds):
        schema = like.select(F.lit(1).alias("__range"), F.array(_order(keys)).alias("__bounds")).schema
        held = F.broadcast(df.sparkSession.createDataFrame(level, schema))
        out = out.join(held, "__range").withColumn("__range", F.col("__range") * FANOUT + _past(0, FANOUT - 1)).drop("__bounds")
    return out.drop("__key")


def pass_bounds(like: DataFrame, keys: Sequence[str]) -> list:
    """Keys that part a table spread like ``like`` into passes of about ``PASS_ROWS`` rows, ``MOST_PASSES`` at most."""
    rows = like.count()
    passes = min(MOST_PASSES, max(1, rows // PASS_ROWS))
    fine = key_bounds(like.select(*keys), keys, passes * FANOUT, rows) if passes > 1 else []
    return [b for i, b in enumerate(fine) if (i + 1) % FANOUT == 0]


def split(df: DataFrame, number: Column, path: str) -> None:
    """Add the rows to the staged table at ``path``, in a folder for each ``number``."""
    df.withColumn("__split", number).drop("__range").write.mode("append").options(**compact()).partitionBy("__split").parquet(path)


def split_by_pass(df: DataFrame, keys: Sequence[str], bounds: list, like: DataFrame, path: str, rows: int | None = None) -> None:
    """:func:`split` by the bounds of :func:`pass_bounds`: keys of one split are all below those of the next.

    With ``rows``, about how many there are, no more tasks than they need write, so that files are not tiny.
    """
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS))
    split(_numbered(df, keys, bounds, _like(df, keys, like)), F.col("__range"), path)


def splits(spark: SparkSession, path: str, schema: StructType, count: int) -> list[DataFrame]:
    """The ``count`` splits of a staged table, also those without rows."""
    found = []
    for i in range(count):
        folder, filesystem = hadoop_path(spark, split_path(path, i))
        found.append(spark.read.schema(schema).parquet(split_path(path, i)) if filesystem.exists(folder) else spark.createDataFrame([], schema))
    return found


def split_path(path: str, number: int) -> str:
    return f"{path}/__split={number}"


def deal_in_order(df: DataFrame, keys: Sequence[str], like: DataFrame | None = None, rows_per_range: int | None = None,
                  most_ranges: int = 4096) -> DataFrame:
    """``df`` in the order of ``keys`` over its partitions and inside them, missing keys last.

    ``like`` holds the key columns of a table with a similar spread; by default the
    plan's own key columns, pruned of all else, are read for it. Rows that are equal in
    all keys share a range, so let the keys end in columns that tell rows apart. Ranges
    hold ``rows_per_range`` rows, by default enough for every core to have one.
    """
    spark = df.sparkSession
    like = _like(df, keys, like)
    rows = like.count()
    if rows_per_range is None:
        # Ranges of few rows are merged where the session lets small partitions be merged.
        merge = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
        rows_per_range = max(LEAST_RANGE if merge else 1, min(FULL_RANGE, math.ceil(rows / spark.sparkContext.defaultParallelism)))
    ranges = max(1, min(most_ranges, math.ceil(rows / rows_per_range)))
    bounds = key_bounds(like, keys, ranges, rows) if ranges > 1 else []
    ordered = [F.col(k).asc_nulls_last() for k in keys]
    if not bounds:
        return df.repartition(1).sortWithinPartitions(*ordered)
    dealt = _numbered(df, keys, bounds, like)
    return dealt.repartitionById(len(bounds) + 1, F.col("__range")).drop("__range").sortWithinPartitions(*ordered)
