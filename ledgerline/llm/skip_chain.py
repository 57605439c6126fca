"""Operator 12: personal data by a skip-chain conditional random field.

Base rules find e-mail addresses, IP addresses, card and phone numbers. On top, the
words of a text that hold a digit or ``@`` are the nodes of a random field with one
label each (none, or a kind). Potentials join a node with its own shape, with the
next word (chain) and with the previous node of the same word or of a similar one
(skip: the same letters and digits, or the same last digits), however far away it is.
Loopy belief propagation passes messages along all of them; nodes inside base spans
are held at their kind. What repeats or resembles a found entity is thereby labelled
like it, also where it is written in a way that the rules miss.

The weights are fitted by pseudo-likelihood to the labels that the base rules give on
a bounded sample of texts. The shape of every third node is hidden while fitting, so
that the edges have to explain its label.

Spans are added where a node outside the base spans has a kind with at least
``threshold`` probability, and skip edges or neighbouring words of that kind lead from
it to a base span: what only looks like an entity adds nothing. Base spans stay.
A node has one skip edge for each of its keys, to a node of a base span if one has
the key, else to the nearest earlier one, so work and memory grow with the words of a text. Whole texts are processed.

Null, empty and blank texts have no spans. Repeated rows each give their own. An
empty table gives no rows; without any labelled node nothing is added. ``keep``
columns come as struct ``_row``, so no name in them can clash with the results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import hash_sample, prepare

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none


@dataclass(frozen=True)
class FieldParams:
    """``train_texts`` and ``train_nodes`` (of one text) bound the sample that the fit uses."""

    train_texts: int = 2000
    train_nodes: int = 256
    rounds: int = 150
    ridge: float = 1e-3
    # Log odds by which two nodes of the same word agree, as far as the sample doesn't tell otherwise.
    agreement: float = 3.0
    passes: int = 20
    threshold: float = 0.5


# --- base rules --------------------------------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches begin and end with whole runs of digits, so the look-behind only keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(v) <= 3 and int(v or "0") <= 255 for v in (p.lstrip("0") for p in text.split(".")))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# --- the field of a text -----------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|[\W_]")
_DIGIT_CLASS = np.minimum(np.searchsorted([1, 2, 3, 4, 5, 7, 9, 12, 15, 16, 17, 20], np.arange(64), side="right"), 12)
# Values of each feature of a node: digits, letters, @, dots, hyphens, brackets, plus, Luhn, octets, other symbols, shape.
_VALUES = (13, 3, 3, 6, 4, 2, 2, 3, 2, 3, 4096)
_OFFSETS = np.cumsum((0, *_VALUES))
SHAPE_FEATURES = len(_VALUES)
# Features that a hidden node keeps: a bias, and whether a word without marks stands before and after it.
_BIAS, _LEFT, _RIGHT, FEATURES = (int(_OFFSETS[-1]) + k for k in range(4))
NO_FEATURE = FEATURES  # a row of zeros
CHAIN, SAME, ALIKE = range(3)


def shape_features(word: str) -> list[int]:
    digits = _digits(word)
    letters = sum(map(str.isalpha, word))
    count = word.count
    other = len(word) - len(digits) - letters - sum(map(count, "@.-()+"))
    shape = _RUN.sub(lambda m: f"d{min(len(m[0]), 20)}" if "0" <= m[0][0] <= "9" else "a" if m[0][0].isalpha() else m[0], word)
    checked = 0 if not 12 <= len(digits) <= 19 else 1 if luhn(digits) else 2
    values = (int(_DIGIT_CLASS[min(len(digits), 63)]), 0 if not letters else 1 if letters < len(digits) else 2, min(count("@"), 2),
              min(count("."), 5), min(count("-"), 3), int("(" in word or ")" in word), int(word[0] == "+"), checked,
              int(word.count(".") == 3 and bool(_IP.fullmatch(word)) and _octets(word)), min(other, 2),
              zlib.crc32(shape.encode("utf-8", "surrogatepass")) % _VALUES[-1])
    return [int(o) + v for o, v in zip(_OFFSETS, values)]


def _keys(word: str) -> tuple[str, str | None]:
    """What the same words share, and what similar ones share (None: too short to tell)."""
    folded = word.casefold().strip("!\"#$%&'*,.:;<=>?[]^_`{|}~")
    plain = "".join(filter(str.isalnum, folded))
    digits = _digits(plain)
    if len(digits) == len(plain):
        return folded, digits[-7:] if len(digits) >= 7 else None
    return folded, plain if len(plain) >= 6 else None


@dataclass
class Field:
    """Nodes (start and end in the text, features, label of the base rules) and edges (from, to, kind) of one or more texts."""

    place: np.ndarray
    word: np.ndarray
    features: np.ndarray
    label: np.ndarray
    edges: np.ndarray

    @staticmethod
    def joined(fields: list[Field]) -> Field:
        at = np.cumsum([0, *(len(f.label) for f in fields)])
        edges = [f.edges + np.array([a, a, 0]) for f, a in zip(fields, at)]
        return Field(*(np.concatenate([getattr(f, n) for f in fields]) for n in ("place", "word", "features", "label")), np.concatenate(edges))


def field_of(text: str, base: list[tuple[int, int, int]], known: dict[str, tuple] | None = None, limit: int | None = None) -> Field:
    """The field of a text; ``known`` keeps features and keys of words, ``limit`` bounds the nodes (for the fit)."""
    known = {} if known is None else known
    place, number, features, keys = [], [], [], []
    for n, m in enumerate(_WORD.finditer(text)):
        word = m[0]
        if not _MARK.search(word):
            continue
        if (held := known.get(word)) is None:
            held = known[word] = (shape_features(word), *_keys(word))
        place.append(m.span())
        number.append(n)
        features.append(held[0])
        keys.append(held[1:])
        if limit is not None and len(place) == limit:
            break
    place, number = np.array(place, np.int64).reshape(-1, 2), np.array(number, np.int64)
    n = len(number)
    around = np.diff(number) == 1
    alone = np.concatenate([[True], ~around]) if n else np.zeros(0, bool), np.concatenate([~around, [True]]) if n else np.zeros(0, bool)
    context = np.stack([np.full(n, _BIAS), np.where(alone[0], _LEFT, NO_FEATURE), np.where(alone[1], _RIGHT, NO_FEATURE)], axis=1)
    rows = np.concatenate([np.array(features, np.int64).reshape(n, SHAPE_FEATURES), context], axis=1)
    label = np.zeros(n, np.int64)
    for start, kind, end in reversed(base):  # where spans overlap, the first one labels the node
        a, b = np.searchsorted(place[:, 1], start, side="right"), np.searchsorted(place[:, 0], end, side="left")
        label[a:b] = kind + 1
    # A skip edge leads to a node of a base span with the same key if there is one, else to the key's previous node.
    edges, last, found = [(i, i + 1, CHAIN) for i in np.flatnonzero(around).tolist()], ({}, {}), ({}, {})
    for i in np.flatnonzero(label).tolist():
        for k in (SAME, ALIKE):
            found[k - 1].setdefault(keys[i][k - 1], i)
    for i, pair in enumerate(keys):
        partner = [None, None]
        for k, key in enumerate(pair):
            if key:
                partner[k] = found[k].get(key, last[k].get(key)) if not label[i] else last[k].get(key)
                last[k][key] = i
        if partner[0] is not None:
            edges.append((partner[0], i, SAME))
        if partner[1] is not None and partner[1] != partner[0]:
            edges.append((partner[1], i, ALIKE))
    return Field(place, number, rows, label, np.array(edges, np.int64).reshape(-1, 3))


# --- weights -----------------------------------------------------------------------------------------------------


@dataclass
class Weights:
    """Log potentials: of a feature and a label, and of the two labels of an edge by its kind (similar words: added to the same words')."""

    node: np.ndarray
    edge: np.ndarray

    def potentials(self) -> np.ndarray:
        return np.stack([self.edge[CHAIN], self.edge[SAME], self.edge[SAME] + self.edge[ALIKE]])

    @staticmethod
    def zero() -> Weights:
        return Weights(np.zeros((FEATURES + 1, LABELS)), np.zeros((3, LABELS, LABELS)))


def _normalised(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(field: Field, params: FieldParams = FieldParams()) -> Weights:
    """Pseudo-likelihood of the labels: every node given its features and its neighbours' labels, by adaptive gradients."""
    weights = Weights.zero()
    n = len(field.label)
    if not field.label.any():
        return weights
    prior = np.zeros_like(weights.edge)
    prior[SAME] = params.agreement * np.eye(LABELS)
    weights.edge += prior
    features = field.features.copy()
    features[2::3, :SHAPE_FEATURES] = NO_FEATURE
    a, b, kind = field.edges.T
    target = np.eye(LABELS)[field.label]
    seen = [np.zeros_like(weights.node), np.zeros_like(weights.edge)]
    for _ in range(params.rounds):
        logits = weights.node[features].sum(axis=1)
        potential = weights.potentials()
        np.add.at(logits, b, potential[kind, field.label[a]])
        np.add.at(logits, a, potential[kind, :, field.label[b]])
        error = target - _normalised(logits)
        node, edge = np.zeros_like(weights.node), np.zeros_like(weights.edge)
        np.add.at(node, features.ravel(), np.repeat(error, features.shape[1], axis=0))
        np.add.at(edge, (kind, field.label[a]), error[b])
        np.add.at(edge.transpose(0, 2, 1), (kind, field.label[b]), error[a])
        edge[SAME] += edge[ALIKE]
        node -= params.ridge * n * weights.node
        edge -= params.ridge * n * (weights.edge - prior)
        node[NO_FEATURE] = 0
        for value, slope, squares in ((weights.node, node, seen[0]), (weights.edge, edge, seen[1])):
            squares += slope**2
            value += 0.5 * slope / np.sqrt(squares + 1e-12)
    return weights


def beliefs(field: Field, weights: Weights, held: np.ndarray, passes: int) -> np.ndarray:
    """Label probabilities of every node after loopy sum-product; ``held`` nodes keep their label."""
    n = len(field.label)
    own = weights.node[field.features].sum(axis=1)
    own[held] = -60.0
    own[held, field.label[held]] = 60.0
    if not len(field.edges):
        return _normalised(own)
    a, b, kind = field.edges.T
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    both = weights.potentials()
    pair = np.concatenate([both, both.transpose(0, 2, 1)])  # from a to b, then from b to a: [label of source, of target]
    pair_of = np.concatenate([kind, kind + len(both)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), LABELS))
    for _ in range(passes):
        total = own.copy()
        np.add.at(total, target, message)
        sent = np.where(held[source, None], own[source], total[source] - message[back])  # what is held hears nothing
        new = sent[:, :1] + pair[pair_of, 0]
        for label in range(1, LABELS):
            new = np.logaddexp(new, sent[:, label : label + 1] + pair[pair_of, label])
        new -= new.max(axis=1, keepdims=True)
        if np.abs(new - message).max() <= 1e-3:
            message = new
            break
        message = 0.5 * (message + new)
    total = own.copy()
    np.add.at(total, target, message)
    total[held] = own[held]
    return _normalised(total)


def added_spans(field: Field, weights: Weights, params: FieldParams) -> tuple[np.ndarray, np.ndarray]:
    """Per node the kind that the field adds (0: none), and its probability."""
    held = field.label > 0
    p = beliefs(field, weights, held, params.passes)
    kind = p[:, 1:].argmax(axis=1) + 1
    sure = p[np.arange(len(p)), kind]
    kind[sure < params.threshold] = 0
    backed = held.copy()
    skips = [(i, j) for i, j, of in field.edges.tolist() if of != CHAIN and kind[i] and kind[i] == kind[j]]
    # Words next to each other and of one kind (the parts of a number) are backed together.
    apart = (np.diff(field.word) != 1) | (np.diff(kind) != 0)
    stretch = np.concatenate([[0], np.cumsum(apart)])[: len(kind)]
    while True:
        before = backed.sum()
        for order in (skips, reversed(skips)):  # two ways carry along any chain of equal words
            for i, j in order:
                backed[i] = backed[j] = backed[i] or backed[j]
        backed |= (np.bincount(stretch, backed) > 0)[stretch]
        if backed.sum() == before:
            return np.where(held | ~backed, 0, kind), sure


# --- the operator ------------------------------------------------------------------------------------------------

# Digits of a number that may be written in several words; an address is one word.
_MOST_DIGITS = (0, 0, 19, 15)
# Fields of several texts are solved together up to so many nodes; a longer one is solved alone.
FIELD_NODES = 50_000
SPAN = "kind:string,start:bigint,end:bigint,base:boolean,probability:double"


def train(docs: DataFrame, text: str = "text", params: FieldParams = FieldParams()) -> Weights:
    """Fit to the base rules' labels on about ``train_texts`` texts with a digit or ``@``, ``train_nodes`` words of each at most."""
    prepare(docs.sparkSession)
    marked = docs.select(F.col(text).alias("_t")).filter(F.col("_t").rlike("[0-9@]"))

    @F.pandas_udf("struct<place:array<bigint>,word:array<bigint>,features:array<bigint>,label:array<bigint>,edges:array<bigint>>")
    def nodes(texts: pd.Series) -> pd.DataFrame:
        fields = [field_of(t, base_spans(t), limit=params.train_nodes) for t in texts.tolist()]
        return pd.DataFrame({n: [getattr(f, n).ravel() for f in fields] for n in ("place", "word", "features", "label", "edges")})

    rows = hash_sample(marked, "_t", params.train_texts).select("_hash", nodes("_t").alias("_n")).select("_hash", "_n.*").collect()
    if not rows:
        return Weights.zero()
    rows.sort(key=lambda r: r["_hash"])
    made = [[np.array(r[n], np.int64) for n in ("place", "word", "features", "label", "edges")] for r in rows]
    width = SHAPE_FEATURES + 3
    return fit(Field.joined([Field(p.reshape(-1, 2), w, f.reshape(-1, width), y, e.reshape(-1, 3)) for p, w, f, y, e in made]), params)


def spans_of(texts: list[str], weights: Weights, params: FieldParams = FieldParams()) -> list[list[dict]]:
    """All spans of every text, by start, then kind."""
    out, fields, of, known = [], [], [], {}

    def add() -> None:
        field = Field.joined(fields)
        kinds, sure = added_spans(field, weights, params)
        at = 0
        for f, i in zip(fields, of):
            out[i] += _as_spans(texts[i], f, kinds[at : at + len(f.label)], sure[at : at + len(f.label)])
            at += len(f.label)
        fields.clear(), of.clear(), known.clear()

    for i, text in enumerate(texts):
        base = base_spans(text) if _MARK.search(text) else []
        out.append([(s, k, e, True, 1.0) for s, k, e in base])
        if base:  # without one there is nothing to resemble
            fields.append(field_of(text, base, known))
            of.append(i)
            if sum(len(f.label) for f in fields) > FIELD_NODES:
                add()
    if fields:
        add()
    return [[{"kind": KINDS[k], "start": s, "end": e, "base": b, "probability": p} for s, k, e, b, p in sorted(rows)] for rows in out]


def _as_spans(text: str, field: Field, kinds: np.ndarray, sure: np.ndarray) -> list[tuple]:
    """Neighbouring words of one kind make one span, up to the digits that a number of the kind can have."""
    found, last = [], None
    for i in np.flatnonzero(kinds).tolist():
        kind, (start, end) = int(kinds[i]) - 1, field.place[i].tolist()
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if start == end:
            continue
        digits = len(_digits(text[start:end]))
        if last == (i - 1, kind) and field.word[i] == field.word[i - 1] + 1 and found[-1][5] + digits <= _MOST_DIGITS[kind]:
            start, p, digits = found[-1][0], min(found[-1][4], sure[i]), digits + found.pop()[5]
        else:
            p = sure[i]
        found.append((start, kind, end, False, float(p), digits))
        last = i, kind
    return [row[:5] for row in found]


def personal_data(docs: DataFrame, weights: Weights, keep: list[str], text: str = "text", params: FieldParams = FieldParams()) -> DataFrame:
    """Every row's ``keep`` columns as struct ``_row`` with ``spans``: kind, start, end (code points, end exclusive), whether
    a base rule found it, and its probability; by start, then kind."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one number per feature and label

    @F.pandas_udf(f"array<struct<{SPAN}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(spans_of([t if isinstance(t, str) else "" for t in batch.tolist()], shared.value, params), dtype=object)

    return docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), run(F.col(text)).alias("spans"))
