"""Row filters. All are plain predicates, so Catalyst pushes them into the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import ne_keep_null


def exclude_value(df: DataFrame, col: str, value) -> DataFrame:
    """Drop rows equal to ``value``; rows where ``col`` is missing are kept."""
    return df.filter(ne_keep_null(col, value))


def keep_value(df: DataFrame, col: str, value) -> DataFrame:
    """Keep rows equal to ``value`` (missing values are dropped)."""
    return df.filter(F.col(col) == F.lit(value))


def keep_token(df: DataFrame, col: str, token: str | None, mode: str) -> DataFrame:
    """Mode ``Y``: keep codes containing ``token`` (missing codes dropped). Mode ``N``: keep all."""
    if mode == "N":
        return df
    if mode != "Y":
        raise ValueError(f"mode must be 'Y' or 'N', got {mode!r}")
    if not token:
        raise ValueError("mode 'Y' needs a token")
    return df.filter(F.coalesce(F.col(col).cast("string").contains(token), F.lit(False)))


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (in ``cols`` or in every column)."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def rename_columns(df: DataFrame, mapping: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Rename columns by a map (e.g. display names supplied at run time).

    Names absent from ``df`` are ignored unless ``strict``, in which case they
    raise, so a stale mapping is caught before any job runs.
    """
    missing = [c for c in mapping if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not in the report: {missing}")
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
