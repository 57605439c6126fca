"""Aggregations. All are hash/sort aggregates with a partial (map-side) phase, so a
hot key is combined before the shuffle instead of landing whole in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_sum(
    df: DataFrame,
    keys: Sequence[str],
    pivot_col: str,
    values: Sequence[str],
    measure: str,
    names: Mapping[str, str] | None = None,
    only_listed: bool = True,
) -> DataFrame:
    """Sum ``measure`` per ``keys`` into one column per listed ``pivot_col`` value.

    Spreadsheet pivot semantics: rows with a missing key or pivot value are left
    out; an absent combination is 0; every listed value yields a column even when
    no row has it. With ``only_listed`` rows with unlisted pivot values are left
    out as well; without it they still form their group (all listed columns 0).
    """
    keys = list(keys)
    names = dict(names or {})
    cond = F.col(pivot_col).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    if only_listed:
        cond = cond & F.col(pivot_col).isin(list(values))
    # One conditional sum per listed value: a single aggregate with a map-side
    # partial phase and one shuffle (DataFrame.pivot would aggregate twice).
    sums = [F.coalesce(F.sum(F.when(F.col(pivot_col) == F.lit(v), F.col(measure))), F.lit(0)).alias(names.get(v, v))
            for v in values]
    return df.filter(cond).groupBy(*keys).agg(*sums)


def totals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the sum of each column (a report's total line)."""
    return df.agg(*[F.sum(c).alias(c) for c in cols])


def rollup_totals(df: DataFrame, levels: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Total rows by level: the sums of ``cols`` for every group of ``levels``, of each shorter list of them, and of all rows.

    ``level`` counts the levels that a row sums over (0: a group of all ``levels``), which
    tells a total row from a group whose value is missing. One aggregate over grouping sets.
    """
    over = F.bit_count(F.grouping_id()).cast("int").alias("level")
    return df.rollup(*levels).agg(over, F.count(F.lit(1)).cast("bigint").alias("rows"), *[F.sum(c).alias(c) for c in cols]).select(
        "level", *levels, "rows", *cols)


def non_null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: count of present values per column."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count(F.col(f"`{c}`")).cast("bigint").alias(c) for c in cols])


def missing_counts(df: DataFrame, cols: Sequence[str], table: str) -> DataFrame:
    """Rows ``(table, column_name, missing)``: how many rows lack each key column."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column_name", "missing").select(
        F.lit(table).alias("table_name"), "column_name", "missing"
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows ``(table_name, rows)`` for each named DataFrame, in one job."""
    parts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def text_widths(df: DataFrame, cols: Sequence[str], padding: int = 2) -> DataFrame:
    """Rows ``(column_name, width)``: longest text of each column plus padding (column sizing)."""
    wide = df.agg(*[(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)) + padding)
                    .cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column_name", "width")
