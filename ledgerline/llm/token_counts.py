"""Operator 4: exact token counts of every prefix.

One pass of dynamic programming per text stores the token count of every prefix
of 1, 2, ... code points; the total, budget tests and truncation points are read
from it without encoding again.

Null texts count as empty (0 tokens). Repeated rows are counted each. Texts of
any length are processed whole, in chunks cut where a word surely ends. An empty table
gives no rows. Only the id is carried, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import load
from ledgerline.llm.common import prepare


def fit_chars(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix whose token count is within ``budget``."""
    ok = np.flatnonzero(counts <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def token_counts(docs: DataFrame, vocabulary: str, budgets: list[int], text: str = "text", id_col: str = "doc_id",
                 with_prefixes: bool = False) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``n_tokens``, ``fits_<b>`` (code points that fit budget b)
    for each budget, and, if asked, ``prefix_counts`` (array<int>, one entry per code point).

    ``vocabulary`` is the path of a byte-level BPE file, readable on the executors.
    """
    prepare(docs.sparkSession)
    fits = [f"fits_{b}" for b in budgets]
    schema = "n_bytes long, n_tokens long" + "".join(f", {c} long" for c in fits)
    schema += ", prefix_counts array<int>" if with_prefixes else ""

    @F.pandas_udf(f"struct<{schema.replace(' long', ':long').replace(' array', ':array')}>")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for batch in texts:
            strings = batch.fillna("").tolist()
            prefixes = bpe.counts(strings)
            out = {"n_bytes": [len(s.encode()) for s in strings], "n_tokens": [int(p[-1]) if len(p) else 0 for p in prefixes]}
            for b, c in zip(budgets, fits):
                out[c] = [fit_chars(p, b) for p in prefixes]
            if with_prefixes:
                out["prefix_counts"] = [p.astype(np.int32) for p in prefixes]
            yield pd.DataFrame(out)

    counted = docs.select(F.col(id_col).alias("_id"), count(F.col(text)).alias("_c"))
    return counted.select(F.col("_id").alias(id_col), "_c.*")
