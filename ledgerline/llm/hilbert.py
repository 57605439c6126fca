"""Operator 5: shards as runs of a Hilbert curve over several metadata columns.

Each column is quantised at quantiles of its own distribution (strings by their
place among the column's distinct values, compared whole), the cells are
numbered along a Hilbert curve, rows are sorted by that number, and equal runs of
the order become shards: a shard's files span a compact box in every column, so
predicates on any of them prune.

Null values take the first cell. Ties on the curve are ordered by text hash, size, id
and place in the staged table, so one hot cell, or one row repeated any number of
times, is cut like any other run. Repeated rows are placed each on its own. Texts of
any length count by their size. An empty table gives no rows. Only the id and the
dimensions are carried, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import global_rank, prepare, stage

BITS = 6


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n x dimensions, values below 2**bits).

    From the highest bit down, each level undoes the reflection and the exchange of
    axes that the curve applies inside the sub-cube the point is in; the Gray code of
    what is left, read across the axes, is the index.
    """
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(dims):
            high = (x[:, d] & level) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    parity = np.zeros(n, np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        parity ^= np.where((x[:, -1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= parity[:, None]
    index = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[:, d] >> b) & 1)
    return index


def with_place(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the place of a string among the column's distinct values; null for null."""
    values = rows.select(F.col(column).alias("_value")).filter("_value is not null").distinct()
    places = stage(global_rank(values, ["_value"], "values", name)[0], "places")
    return rows.join(places, rows[column] == places["_value"], "left").drop("_value")


def with_curve(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve``, the Hilbert index over ``dimensions``; strings count by their place among all values."""
    numbers = {}
    for k, c in enumerate(dimensions):
        name = c
        if isinstance(rows.schema[c].dataType, T.StringType):
            name = f"_place{k}"
            rows = with_place(rows, c, name)
        numbers[c] = F.coalesce(F.col(name).cast("double"), F.lit(-1.0))
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(v, steps, 1 << (bits + 4)).alias(c) for c, v in numbers.items()]).first()
    edges = [np.array(cuts[c] or [], np.float64) for c in dimensions]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        cells = np.column_stack([np.searchsorted(e, c.to_numpy(), side="right") for e, c in zip(edges, columns)])
        return pd.Series(hilbert_index(cells, bits))

    return rows.withColumn("curve", curve(*numbers.values())).drop(*[f"_place{k}" for k in range(len(dimensions))])


def hilbert_shards(docs: DataFrame, dimensions: list[str], shards: int = 16, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Per row: id, the dimensions, size, text_crc32, curve, shard and slot.

    Law ``rows``: the order is cut into ``shards`` runs whose counts differ by one at
    most. ``size`` is the text's UTF-8 bytes plus 1 and may be named as a dimension.
    """
    prepare(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c) for c in dimensions if c != "size"],
                       (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
    rows = stage(rows, "sizes")
    place = rows.metadataColumn("_metadata")  # tells repeated rows apart, so that any number of them is dealt over many tasks
    rows = rows.select("*", F.xxhash64(place["file_path"]).alias("_tie_file"), place["row_index"].alias("_tie_row"))
    ranked, total = global_rank(with_curve(rows, dimensions), ["curve", "text_crc32", "size", "_id", "_tie_file", "_tie_row"], "curve")
    placed = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
    # The first rank of shard s is the smallest r with r * shards >= s * total.
    placed = placed.withColumn("slot", F.expr(f"rank - (shard * {total}L + {shards - 1}) div {shards}"))
    return placed.withColumnRenamed("_id", id_col).drop("rank", "_tie_file", "_tie_row")
