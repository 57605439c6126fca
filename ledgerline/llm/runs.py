"""Operator 11: periodic runs of words by seed-and-extend on diagonals.

A run is a maximal stretch of consecutive words with smallest period q and at
least ``max(min_length, min_repeats * q)`` words. On the diagonal of lag q (word i
against word i + q) it is a stretch of at least ``max(min_length - q,
(min_repeats - 1) * q)`` equal pairs, so every run holds two equal word k-grams, q
words apart, for each k up to that bound: the minimum guaranteed overlap.

Positions are indexed by their k-gram for k = seed, 2 * seed, 4 * seed, ...; the
k-grams of length k seed the lags up to k that no shorter k-gram seeds. As k is
not below the lag, a period's two occurrences are neighbours among the
occurrences of their k-gram (one between them would give a smaller period), so
only neighbouring occurrences are paired: a text of n words has at most n pairs
for each k. A pair is extended both ways along its diagonal, and the furthest
place covered on each lag suppresses the pairs that lie in a stretch already found.

Names of 2k-grams are made from those of two k-grams, so equality is exact, and
a text without a repeated k-gram stops there. Whole texts are processed, in about
n log n steps.

Null, empty and blank texts have no words and no runs. Repeated rows each give
their own row. An empty table gives no rows. ``keep`` columns come as struct
``_row``, so no name in them can clash with the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import prepare


@dataclass(frozen=True)
class RunRule:
    """Runs of at least ``min_length`` words and ``min_repeats`` whole periods; fewer than three guarantee too short an overlap."""

    min_length: int = 24
    min_repeats: int = 3

    def __post_init__(self):
        if self.min_repeats < 3:
            raise ValueError("min_repeats must be 3 or more")

    @property
    def seed(self) -> int:
        """The smallest overlap that any run guarantees on its own diagonal, over all periods."""
        repeats = self.min_repeats - 1
        lags = range(1, max(2, -(-self.min_length // self.min_repeats) + 1))
        return max(1, min(max(self.min_length - q, repeats * q) for q in lags))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _matched(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """Equal pairs (ids[i], ids[i + lag]) in a row from ``at`` on, forwards (step 1) or backwards (-1)."""
    limit = len(ids) - lag - at if step > 0 else at + 1
    done, width = 0, 64
    while done < limit:
        n = min(width, limit - done)
        if step > 0:
            a = at + done
            differ = ids[a : a + n] != ids[a + lag : a + lag + n]
        else:
            a = at - done - n + 1
            differ = (ids[a : a + n] != ids[a + lag : a + lag + n])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += n
        width *= 2
    return done


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number per distinct pair of numbers."""
    _, named = np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)
    return named.astype(np.int64)


def find_runs(ids: np.ndarray, rule: RunRule = RunRule()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbered words, by start, then period."""
    n, k = len(ids), rule.seed
    if n < max(rule.min_length, rule.min_repeats):
        return []
    names, have = ids, 1  # names[i]: number of the have-gram at i
    while have < k:
        add = min(have, k - have)
        names = _paired(names[: n - have - add + 1], names[add : n - have + 1])
        have += add
    covered: dict[int, int] = {}
    found, lowest = [], 1
    while len(names) > 1:
        order = np.argsort(names, kind="stable")  # by k-gram, then position
        sorted_names = names[order]
        same = sorted_names[1:] == sorted_names[:-1]
        if not same.any():
            break
        left, lag = order[:-1][same], np.diff(order)[same]
        seeds = (lag >= lowest) & (lag <= k)
        left, lag = left[seeds], lag[seeds]
        by_place = np.argsort(left, kind="stable")
        for i, q in zip(left[by_place].tolist(), lag[by_place].tolist()):
            if covered.get(q, -1) > i:
                continue
            end = i + _matched(ids, i, q, 1)
            start = i - (_matched(ids, i - 1, q, -1) if i else 0)
            covered[q] = end
            length = end - start + q
            if length >= max(rule.min_length, rule.min_repeats * q):
                found.append((start, length, q))
        lowest, longer = k + 1, 2 * k
        if rule.min_repeats * lowest > n or len(names) <= k:
            break
        names = _paired(names[:-k], names[k:])
        k = longer
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that lie in a run after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    if not runs:
        return b" ".join(words)
    return b" ".join(w for w, d in zip(words, np.cumsum(drop).tolist()) if not d)


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", rule: RunRule = RunRule()) -> DataFrame:
    """Every row's ``keep`` columns as struct ``_row``, with ``runs`` (by start, then period) and ``collapsed``, the text without repeats."""
    prepare(docs.sparkSession)

    @F.pandas_udf(f"struct<runs:{RUN},collapsed:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs, texts = [], []
            for t in batch.tolist():
                words = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []
                found = find_runs(word_ids(words), rule) if len(words) >= rule.min_length else []
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(collapse(words, found).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"runs": pd.Series(runs, dtype=object), "collapsed": texts})

    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), run(F.col(text)).alias("_r"))
    return rows.select("_row", "_r.*")
