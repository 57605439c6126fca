"""Joins of facts with reference tables and the deduction list.

Plain lookups carry no ``broadcast()`` hint. Spark broadcasts a side when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and, with AQE,
when the measured size of a finished shuffle stage is under the adaptive
threshold; otherwise it sort-merges (AQE splits skewed partitions). Landed
reference tables (category, supervisor, calendar, free goods) have exact file
sizes and end up broadcast; the customer dimension is sort-merged once it
outgrows the threshold.

A dimension computed inside the plan (an aggregate, an outer join) has no
usable size estimate, so Spark would shuffle the whole fact side before AQE
can switch. :func:`bounded_broadcast` settles that case with a real count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import doc_key


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    cols: Sequence[str] | None = None,
    how: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Attach ``cols`` of ``dim`` to ``fact`` by equality on ``on``.

    Only the key and the requested columns are taken from ``dim`` (column pruning
    reaches its scan). Missing keys never match unless ``null_safe`` is set.
    Duplicate dimension keys fan the fact out, as in the source reports; measure
    it with :func:`ledgerline.operators.key_fanout`.
    """
    keys = [on] if isinstance(on, str) else list(on)
    cols = [c for c in (cols if cols is not None else dim.columns) if c not in keys]
    right = dim.select(*keys, *cols)
    if not null_safe:
        return fact.join(right, keys, how)
    renamed = right.select(*[F.col(k).alias(f"__dim_{k}") for k in keys], *cols)
    cond = None
    for k in keys:
        c = fact[k].eqNullSafe(renamed[f"__dim_{k}"])
        cond = c if cond is None else cond & c
    return fact.join(renamed, cond, how).drop(*[f"__dim_{k}" for k in keys])


def bounded_broadcast(dim: DataFrame, max_rows: int, max_bytes: int = 256 << 20, path: str | None = None) -> DataFrame:
    """Broadcast ``dim`` only when it provably has at most ``max_rows`` rows and
    at most ``max_bytes`` of Parquet on disk.

    The dimension is computed once and written as a Parquet table in the shared
    scratch folder (``spark.checkpoint.dir``): lost executors cannot lose it, its
    lineage is cut, and the planner sees its real file size. Rows are counted by
    the write job itself and bytes summed from the written files. Within both
    bounds the result carries a broadcast hint; beyond either no hint is given
    and the join sort-merges. ``path`` names the table for a caller that deletes
    it later; by default it gets a new name in the scratch folder.
    """
    import uuid

    from pyspark.sql import Observation

    from ledgerline.session import hadoop_path, scratch_dir

    spark = dim.sparkSession
    path = path or f"{scratch_dir(spark)}/materialised/{uuid.uuid4().hex}"
    seen = Observation()
    dim.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    rows = int(seen.get["rows"])
    hpath, filesystem = hadoop_path(spark, path)
    size = filesystem.getContentSummary(hpath).getLength()
    materialised = spark.read.parquet(path)
    return F.broadcast(materialised) if rows <= max_rows and size <= max_bytes else materialised


def attach_calendar(fact: DataFrame, calendar: DataFrame, date_col: str = "txn_date") -> DataFrame:
    """Inner join on the transaction date; facts on dates missing from the calendar drop out.

    Both sides are compared as dates, so a timestamp with a time of day still finds its day.
    """
    cal = calendar.select(F.to_date("txn_date").alias(date_col), "week")
    return fact.withColumn(date_col, F.to_date(date_col)).join(cal, date_col, "inner")


def combine_prices(nonvan: DataFrame, van: DataFrame) -> DataFrame:
    """Full outer join of two ``(sku, price)`` lists; the key is coalesced by the USING join."""
    return nonvan.join(van, "sku", "full_outer")


def _keyed(df: DataFrame, doc: str, sku: str) -> DataFrame:
    return df.withColumn("__ded_key", doc_key(F.col(doc), F.col(sku)))


def _key_list(keys: DataFrame, key_col: str) -> DataFrame:
    return keys.select(F.col(key_col).alias("__ded_key")).where(F.col("__ded_key").isNotNull())


def deduct(df: DataFrame, keys: DataFrame, key_col: str, doc: str = "doc_no", sku: str = "sku") -> DataFrame:
    """Remove rows whose ``<doc>_<sku>`` key is listed in ``keys[key_col]``.

    A left anti join: a missing key on either side never matches, so rows with a
    missing document or SKU are kept and NULL list entries remove nothing.
    """
    return _keyed(df, doc, sku).join(_key_list(keys, key_col), "__ded_key", "left_anti").drop("__ded_key")


def key_sieve(keys: DataFrame, bits_per_key: int = 16, max_bytes: int = 64 << 20) -> tuple[DataFrame, int] | None:
    """Bitmaps of the hashed distinct ``__ded_key`` values and their number of bits; None if they would outgrow ``max_bytes``.

    The keys are counted first. Of the bitmaps' rows (4 KB for 32,768 bits) only those
    with a bit set exist, so their size is bounded by the smaller of the bits and 4 KB a key.
    """
    count = keys.agg(F.count_distinct("__ded_key")).first()[0]
    bits = max(1 << 15, 1 << (bits_per_key * count - 1).bit_length()) if count else 1 << 15
    if bits // 8 > max_bytes:
        return None
    place = F.pmod(F.xxhash64("__ded_key"), F.lit(bits)) + 1
    marks = keys.select(F.bitmap_bucket_number(place).alias("__part"), F.bitmap_bit_position(place).alias("__bit"))
    return marks.groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits")), bits


def deduct_sieved(df: DataFrame, keys: DataFrame, key_col: str, doc: str = "doc_no", sku: str = "sku",
                  max_bytes: int = 64 << 20) -> DataFrame:
    """:func:`deduct` for lists that are too long to broadcast: only rows that may be listed are shuffled.

    A hashed bitmap of the list (about two bytes a key, its size checked against
    ``max_bytes``) is broadcast. A row whose bit is not set is surely not listed and stays
    where it is; the others, listed rows and one in some sixteen by chance, go through the
    anti join. The table is read twice for it, each time with the filter of its part. A list
    beyond the bound is joined as it is.
    """
    listed = _key_list(keys, key_col)
    sieve = key_sieve(listed, max_bytes=max_bytes)
    if sieve is None:
        return deduct(df, keys, key_col, doc, sku)
    rows = _sieved(df, sieve, doc, sku)
    stays = rows.filter(~F.col("__maybe")).select(*df.columns)
    return stays.unionByName(rows.filter("__maybe").join(listed, "__ded_key", "left_anti").select(*df.columns))


def _sieved(df: DataFrame, sieve: tuple[DataFrame, int], doc: str, sku: str) -> DataFrame:
    """``df`` with ``__ded_key`` and ``__maybe``, whether the bitmaps of :func:`key_sieve` have the key's bit."""
    marks, bits = sieve
    place = F.pmod(F.xxhash64("__ded_key"), F.lit(bits)) + 1
    rows = _keyed(df, doc, sku).withColumn("__at", F.when(F.col("__ded_key").isNotNull(), place))
    rows = rows.join(F.broadcast(marks), F.bitmap_bucket_number("__at") == F.col("__part"), "left")
    at = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))) % 2 == 1, F.lit(False))
    return rows.select(*df.columns, "__ded_key", maybe.alias("__maybe"))


def only_deducted(df: DataFrame, keys: DataFrame, key_col: str, doc: str = "doc_no", sku: str = "sku") -> DataFrame:
    """Rows whose ``<doc>_<sku>`` key is listed (left semi join)."""
    return _keyed(df, doc, sku).join(_key_list(keys, key_col), "__ded_key", "left_semi").drop("__ded_key")


def only_deducted_sieved(df: DataFrame, keys: DataFrame, key_col: str, doc: str = "doc_no", sku: str = "sku",
                         max_bytes: int = 64 << 20) -> DataFrame:
    """:func:`only_deducted` for long lists: only rows that may be listed are shuffled, as in :func:`deduct_sieved`."""
    listed = _key_list(keys, key_col)
    sieve = key_sieve(listed, max_bytes=max_bytes)
    if sieve is None:
        return only_deducted(df, keys, key_col, doc, sku)
    rows = _sieved(df, sieve, doc, sku).filter("__maybe").drop("__maybe")
    return rows.join(listed, "__ded_key", "left_semi").select(*df.columns)


def deduct_orders(
    orders: DataFrame,
    invoices: DataFrame,
    keys: DataFrame,
    key_col: str = "invoice_key",
    path: str | None = None,
) -> DataFrame:
    """Carry invoice deductions to sales orders.

    Deducted invoice lines give ``(order_no, sku)`` pairs; order lines with such a
    pair are removed. Both joins are against deduction-sized lists. ``path`` is a folder
    for the pairs: they are then staged there, and both lists are sieved.
    """
    lines = invoices.select("doc_no", "sku", "order_no")
    deducted = only_deducted(lines, keys, key_col) if path is None else only_deducted_sieved(lines, keys, key_col)
    order_keys = deducted.select(doc_key(F.col("order_no"), F.col("sku")).alias("order_key"))
    if path is None:
        return deduct(orders, order_keys, "order_key", doc="order_no")
    order_keys.write.parquet(path)
    staged = orders.sparkSession.read.schema(order_keys.schema).parquet(path)
    return deduct_sieved(orders, staged, "order_key", doc="order_no")

