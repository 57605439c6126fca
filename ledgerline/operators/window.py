"""First row per key by an ordering, without a window over whole groups.

``min(struct(order..., payload...))`` is an ordinary aggregate: it is partially
evaluated before the shuffle, so a key holding a third of all rows is reduced
map-side instead of being sorted inside one task as ``row_number()`` would do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per ``keys``: the smallest by ``order`` (ascending, missing last).

    Ties are broken by every remaining column in order (missing first), so the
    result does not depend on input order or partitioning.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    ordering = []
    for i, c in enumerate(order):
        c = F.col(c) if isinstance(c, str) else c
        ordering += [c.isNull().alias(f"__null{i}"), c.alias(f"__ord{i}")]
    best = F.min(F.struct(*ordering, *[F.col(f"`{c}`").alias(f"__p_{c}") for c in payload]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(
        *keys, *[F.col("__best").getField(f"__p_{c}").alias(c) for c in payload]
    )
