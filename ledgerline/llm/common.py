"""Shared helpers: word expressions, staging in the shared folder, global ranks."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import delete_path, scratch_dir, ship_package

# A word is a maximal run of characters other than space and U+0009..U+000D.
GAP = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]"

# Documents handed to a Python worker at a time: bounds the Arrow batch for tables of long texts.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the Python workers."""
    ship_package(spark)
    return spark


def bounded(query):
    """A registered query or stage that first bounds the session's Arrow batches."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return query(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage (a lost executor costs a reread, not a recomputation), keeps
    the expensive step from running twice, and gives the planner measured sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            delete_path(df.sparkSession, path)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows as struct ``_row`` with ``_file`` and ``_at``, which name a row for good.

    A table read from files has them already. Anything else is staged first: its rows
    need not come out in the same order when they are computed again.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        docs = stage(docs, "rows")
    place = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), place["file_path"].alias("_file"), place["row_index"].alias("_at"))


def keep_rows(rows: DataFrame, kept: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The ``_row`` structs of the keyed ``rows`` whose ``_file`` and ``_at`` are among ``kept``.

    What is kept is gathered into bitmaps of 32,768 rows of a file, a bit for each row.
    Their size is measured; up to ``broadcast_bytes`` they are broadcast, so the wide rows
    stay where they are read. Beyond it the wide rows are shuffled to the kept keys.
    """
    kept = stage(kept.select("_file", "_at"), "kept")
    place = F.col("_at") + 1
    bits = kept.groupBy("_file", F.bitmap_bucket_number(place).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    bits = stage(bits, "kept-bits")
    held = bits.agg(F.coalesce(F.sum(F.octet_length("_bits") + F.octet_length("_file")), F.lit(0))).first()[0]
    if held > broadcast_bytes:
        return rows.join(kept, ["_file", "_at"], "left_semi").select("_row")
    unstage(kept)
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_part", F.bitmap_bucket_number(place)).join(F.broadcast(bits), ["_file", "_part"])
    return found.filter(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))) % 2 == 1).select("_row")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a one-element transform binds it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{GAP}+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list[str], name: str, rank: str = "rank") -> tuple[DataFrame, int]:
    """``df`` with a gapless 0-based ``rank`` over ``order``, and the number of rows.

    Rows are dealt by range and sorted inside each partition; a row's rank is its
    place there plus the rows of all earlier partitions. Only one count per
    partition reaches the driver. ``order`` should end in columns that tell rows
    apart, so that a heavy value is split over several partitions.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    starts = spark.createDataFrame(before or [(0, 0)], "p long, before long")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = dealt.withColumn("p", part).join(F.broadcast(starts), "p").withColumn(rank, F.col("before") + local)
    return ranked.drop("p", "before", "_at"), total


def hash_sample(df: DataFrame, column: str, rows: int) -> DataFrame:
    """About ``rows`` of the table's distinct ``column`` hashes, one row each; all of them if there are no more.

    Hashes are uniform, so a bound on the hash picks the share; nothing is sorted and
    no task sends more than its own share.
    """
    marked = df.withColumn("_hash", F.xxhash64(column))
    total = df.count()
    if total > rows:
        marked = marked.filter(F.col("_hash") < int(-(1 << 63) + (1 << 64) * rows // total))
    return marked.dropDuplicates(["_hash"]).orderBy("_hash")
