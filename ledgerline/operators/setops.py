"""Unions and the reference upsert."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.window import first_per_key


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column absent from one input is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def upsert(base: DataFrame, updates: DataFrame, key: str, cols: Sequence[str], order: str | None = None) -> DataFrame:
    """Matched keys take the update's ``cols``; unmatched update rows are inserted.

    ``updates`` is first reduced to one row per key (largest ``order`` wins, ties
    broken on the values). Every base row with a matched key is updated, so
    duplicate base keys stay duplicates. Write the result to a new location
    instead of overwriting the table being read.
    """
    cols = list(cols)
    if order is not None:
        ranked = updates.select(key, *cols, (-F.col(order)).alias("__rank"))
        upd = first_per_key(ranked, [key], ["__rank"]).drop("__rank")
    else:
        upd = first_per_key(updates.select(key, *cols), [key])
    upd = upd.select(key, *[F.col(c).alias(f"__new_{c}") for c in cols], F.lit(True).alias("__matched"))
    other = [c for c in base.columns if c != key and c not in cols]
    joined = base.join(upd, key, "full_outer")
    return joined.select(
        key,
        *[F.when(F.col("__matched"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        *other,
    )
