"""Operator 10: quality classifier with naive Bayes support vectors.

A text's features are the byte n-grams it contains and the n-grams of its word
shapes (a word's case and symbols, or that it repeats the word before). Each
indicator is scaled by its class log-count ratio, vectors are brought to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent.

Null texts count as empty: they have no features and get the score of the bias.
Ids that carry contradicting labels, or none, are not used for fitting; of several
texts of one id the one with the smallest hash is. Without labels of both classes every
text gets 0.5. Repeated rows are scored each. Texts of any length are read whole. An
empty table gives no rows. Kept columns come as struct ``_row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import prepare

TRIGRAM_BITS = 17
SHAPES = 8
SHAPE_GRAMS = 4
_PAIRS = 256
_TRIPLES = _PAIRS + 256 * 256
_SHAPE_AT = [_TRIPLES + (1 << TRIGRAM_BITS) + sum(SHAPES**k for k in range(1, n)) for n in range(1, SHAPE_GRAMS + 1)]
DIM = _SHAPE_AT[-1] + SHAPES**SHAPE_GRAMS

# Word shapes. A repeat is told before any other shape.
LOWER, TITLE, UPPER, DIGITS, SYMBOLS, MARKED, OTHER, REPEAT = range(SHAPES)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOPS = np.zeros(256, bool)
_STOPS[[33, 44, 46, 58, 59, 63]] = True


@dataclass(frozen=True)
class NbSvmParams:
    """``train_rows`` bounds the labelled rows that the fit uses, half of them for each class at most."""

    train_rows: int = 4000
    alpha: float = 1.0
    cost: float = 1.0
    epochs: int = 20
    slope: float = 4.0
    seed: int = 3


def shapes(data: bytes, raw: np.ndarray) -> np.ndarray:
    """The shape of every word of a text."""
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask[raw])])
        return upto[end] - upto[start]

    upper, lower, digit, stops, size = count(_UPPER), count(_LOWER), count(_DIGIT), count(_STOPS), end - start
    marks = size - upper - lower - digit - stops
    out = np.full(len(start), OTHER)
    out[(lower > 0) & (upper == 0)] = LOWER
    out[(lower > 0) & (upper > 0)] = TITLE
    out[(upper > 1) & (lower == 0)] = UPPER
    out[digit > 0] = DIGITS
    out[marks > 0] = MARKED
    out[(marks > 0) & (upper + lower + digit == 0)] = SYMBOLS
    words = data.split()
    out[1:][np.fromiter((a == b for a, b in zip(words, words[1:])), bool, len(words) - 1)] = REPEAT
    return out


class Features:
    """The sorted feature ids of a text; keeps one scratch array of flags."""

    def __init__(self):
        self._flag = np.zeros(DIM, bool)

    def ids(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass")
        raw = np.frombuffer(data, np.uint8)
        flag = self._flag
        flag[raw] = True
        wide = raw.astype(np.int64)
        pairs = wide[:-1] << 8 | wide[1:]
        flag[_PAIRS + pairs] = True
        triples = (pairs[:-1] << 8 | wide[2:]) * 0x9E3779B1
        flag[_TRIPLES + ((triples >> 12) & ((1 << TRIGRAM_BITS) - 1))] = True
        shape = shapes(data, raw)
        gram = np.zeros(len(shape), np.int64)
        for n in range(SHAPE_GRAMS):
            if len(shape) <= n:
                break
            gram = gram[: len(shape) - n] * SHAPES + shape[n:]
            flag[_SHAPE_AT[n] + gram] = True
        found = np.flatnonzero(flag)
        flag[found] = False
        return found


@dataclass
class Model:
    """Per feature the fitted weight times its ratio, and the squared ratio; the bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float

    def score(self, ids: np.ndarray) -> float:
        length = np.sqrt(self.square[ids].sum()) if len(ids) else 0.0
        margin = self.bias + (self.weight[ids].sum() / length if length > 0 else 0.0)
        return float(1 / (1 + np.exp(np.clip(-self.slope * margin, -700, 700))))


def fit(rows: list[np.ndarray], labels: list[int], params: NbSvmParams) -> Model:
    """Log-count ratios over the rows, then dual coordinate descent on the hinge loss."""
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, params.slope)
    has = [np.full(DIM, params.alpha), np.full(DIM, params.alpha)]
    for ids, label in zip(rows, y):
        has[int(label > 0)][ids] += 1
    ratio = np.log(has[1] / has[1].sum()) - np.log(has[0] / has[0].sum())
    square = ratio**2
    length = [max(np.sqrt(square[ids].sum()), 1e-12) for ids in rows]
    # The weights are kept as multiples of the ratios: weight * ratio is what a feature adds to a margin.
    w, bias, dual = np.zeros(DIM), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(params.seed)
    for _ in range(params.epochs):
        for i in rng.permutation(len(rows)):
            ids = rows[i]
            slope = y[i] * ((w[ids] * ratio[ids]).sum() / length[i] + bias) - 1
            step = min(max(dual[i] - slope / 2.0, 0.0), params.cost) - dual[i]  # squared length with the bias: 2
            if step:
                dual[i] += step
                w[ids] += step * y[i] / length[i] * ratio[ids]
                bias += step * y[i]
    return Model(w * ratio, square, float(bias), params.slope)


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Features()
        for batch in batches:
            yield pd.Series([made.ids(t if isinstance(t, str) else None).astype(np.int32) for t in batch.tolist()])

    return run(text)


def train(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text",
          params: NbSvmParams = NbSvmParams()) -> Model:
    """Fit on the labelled rows (``id_col``, ``label`` 0/1) that come first in hash order of their ids."""
    prepare(docs.sparkSession)
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    marks = marks.agg(F.min(label).alias("_y"), F.max(label).alias("_z")).filter("_y = _z").select("_id", "_y")
    order = F.xxhash64("_id")
    half = [marks.filter(F.col("_y") == y).orderBy(order, "_id").limit(params.train_rows // 2) for y in (0, 1)]
    chosen = F.broadcast(half[0].union(half[1]))  # at most train_rows rows
    found = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).join(chosen, "_id")
    found = found.groupBy("_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))
    found = found.select("_id", "_y", feature_column(F.col("_t")).alias("_f"))
    rows = sorted(found.collect(), key=lambda r: r["_id"])
    return fit([np.array(r["_f"], np.int64) for r in rows], [r["_y"] for r in rows], params)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Every row's ``keep`` columns as struct ``_row`` with ``score`` (0 to 1) and ``predicted`` (0 or 1)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of DIM numbers

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made, fitted = Features(), shared.value
        for batch in batches:
            yield pd.Series([fitted.score(made.ids(t if isinstance(t, str) else None)) for t in batch.tolist()], dtype="float64")

    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), run(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
