"""Operator 13: ranked lexical search over bit-sliced Bloom signatures.

Index: documents are dealt into blocks of similar length. A block is a bit matrix
with a column per document and a few thousand rows; a term sets one bit in each of
``hashes`` rows of its document's column, and once more, under another name, for
every level (2, 3, 4, ... 64) that its occurrences reach. The rows are stored sliced: one bitmap
of the block's documents per row.

Search: the bitmaps of a term's rows, joined by AND, hold every document of the
block that has the term (and a few others). Summing the terms' weights over these
slices, level by level of their occurrences, gives for every document an upper
bound of its score, because a score grows with the occurrences and the slices
never miss one. Two passes follow:

1. every block names its documents with the highest bounds; the best of them over
   all blocks are scored exactly, and the k-th best exact score is the item's floor;
2. every document whose bound reaches the floor is scored exactly on its whole
   text. All others are provably outside the first k.

Score of a document for an item, in 64-bit integers (``weight`` in doubles):
sum over the item's terms, with repeats, of
``weight * ((10**9 * tf) div (1000 * tf + 12 * m))`` with ``weight =
floor(1000 * ln((2N + 2) / (2 df + 1)))`` and ``m = 100 - 25 + (25 n N) div L``.

Null, empty and blank texts have no terms and are never found; an item without
terms has no rows. Items with the same id are ranked each on its own. Repeated
documents each take a rank; equal scores go by id, null last. Without documents or
items there are no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import prepare, stage

# ASCII letters and digits and every byte of a non-ASCII character are parts of a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
# A term is stored once for each of these numbers that its occurrences reach.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, 12, 16, 32, 64])
# What a score's quotient stays below at any number of occurrences.
LIMIT = 1_000_000


@dataclass(frozen=True)
class SignatureParams:
    """At most ``block_rows`` documents per block; about half of a block's bits are set at ``hashes`` rows per term."""

    block_rows: int = 2048
    # A block of this many documents ends before one that is more than twice as long as its first: one long
    # document among short ones would have most of its bits set, and with them a loose bound.
    even_rows: int = 128
    hashes: int = 8
    # Documents scored per item to find its floor, as a multiple of k.
    floor_pool: int = 10
    # Items searched together; more items are searched in further rounds over the index.
    item_bytes: int = 1 << 20
    # Scored pairs (item, document) are met by a broadcast up to this many, else by a shuffle.
    broadcast_rows: int = 1_000_000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n, n_docs: int, n_terms: int):
    """The score's m, for a number or an array of term counts."""
    return 75 + 25 * n * n_docs // n_terms


# --- index -------------------------------------------------------------------------------------------------------

def _row_places(hashes: np.ndarray, level: int, rows: int, k: int) -> np.ndarray:
    """The ``k`` rows of every (term hash, level) in a matrix of ``rows`` rows."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    base = hashes + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
    base ^= base >> np.uint64(29)
    return ((base[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) % np.uint64(rows)).astype(np.int64)


def build_block(texts: list[str | None], params: SignatureParams) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, lengths in terms, and the bit-sliced matrix (rows x bytes of documents) of a block."""
    seen: dict[bytes, int] = {}
    columns, hashes, times, lengths = [], [], [], np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        terms = terms_of(text)
        lengths[d] = len(terms)
        for t, tf in Counter(terms).items():
            h = seen.get(t)
            if h is None:
                h = seen[t] = xxhash.xxh3_64_intdigest(t)
            columns.append(d)
            hashes.append(h)
            times.append(tf)
    column, hashed, reached = np.array(columns, np.int64), np.array(hashes, np.uint64), np.array(times, np.int64)
    stored = sum(int((reached >= level).sum()) for level in LEVELS)
    rows = max(64, int(stored / max(1, len(texts)) * params.hashes / math.log(2)) + 1)
    width = -(-len(texts) // 8)
    bits = np.zeros((rows, width), np.uint8)
    for v, level in enumerate(LEVELS):
        pick = reached >= level
        place = _row_places(hashed[pick], v, rows, params.hashes)
        at = np.repeat(column[pick], params.hashes)
        np.bitwise_or.at(bits, (place.ravel(), at >> 3), (1 << (at & 7)).astype(np.uint8))
    return rows, lengths, bits


def build_index(docs: DataFrame, id_col: str, text: str, params: SignatureParams) -> DataFrame:
    """One row per block: its size, the documents' ids and lengths, and the sliced matrix.

    ``ids`` is an array in the documents' order. A task cuts its rows into blocks, sorted by
    length inside stretches of a few blocks, so that a block's columns are about equally full.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"ids array<{id_type}>, lengths binary, rows int, slices binary"

    def blocks(keys: list, texts: list) -> Iterator[tuple]:
        order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
        size = [len(texts[i] or "") for i in order]
        at = 0
        while at < len(order):
            end = min(at + params.block_rows, len(order))
            end = min(end, max(bisect_right(size, 2 * size[at]), at + params.even_rows))
            of, at = order[at:end], end
            rows, lengths, bits = build_block([texts[i] for i in of], params)
            yield [keys[i] for i in of], lengths.astype("<i8").tobytes(), rows, bits.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, texts, chars = [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame(list(blocks(keys, texts)), columns=["ids", "lengths", "rows", "slices"])

        for batch in batches:
            keys += [None if pd.isna(k) else k for k in batch["_id"].tolist()]
            new = [t if isinstance(t, str) else None for t in batch["_t"].tolist()]
            texts += new
            chars += sum(len(t) for t in new if t)
            if len(texts) >= 4 * params.block_rows or chars > 1 << 24:
                yield flush()
                keys, texts, chars = [], [], 0
        if texts:
            yield flush()

    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).filter("_t is not null and _t <> ''")
    return source.mapInPandas(run, schema)


# --- statistics --------------------------------------------------------------------------------------------------


def statistics(docs: DataFrame, text: str, wanted: frozenset[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """N, L and the document counts of the ``wanted`` terms, over all documents.

    Each task counts its own rows, so a shuffle of one row per task and term remains.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_docs, n_terms, of = shared.value, 0, 0, Counter()
        for batch in batches:
            for t in batch["_t"].tolist():
                terms = terms_of(t)
                n_docs += bool(terms)
                n_terms += len(terms)
                of.update(held.intersection(terms))
        rows = [(b"", n_docs, n_terms), *((t, n, 0) for t, n in of.items())]  # no term is empty
        yield pd.DataFrame(rows, columns=["term", "docs", "terms"])

    source = docs.select(F.col(text).alias("_t")).filter("_t is not null and _t <> ''")
    counted = source.mapInPandas(run, "term binary, docs long, terms long")
    rows = counted.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect()  # the items' terms
    found = {bytes(r["term"]): (r["docs"], r["terms"]) for r in rows}
    n_docs, n_terms = found.pop(b"", (0, 0))
    return n_docs, n_terms, {t: d for t, (d, _) in found.items()}


# --- search ------------------------------------------------------------------------------------------------------


@dataclass
class Queries:
    """The items of a round: per item the numbers of its terms and their summed weights."""

    terms: list[bytes]
    hashes: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]
    n_docs: int
    n_terms: int


def _queries(texts: list[str | None], n_docs: int, n_terms: int, df: dict[bytes, int]) -> Queries:
    number: dict[bytes, int] = {}
    items = []
    for text in texts:
        held = {t: c * weight(n_docs, df[t]) for t, c in Counter(terms_of(text)).items() if t in df}
        held = {t: w for t, w in held.items() if w > 0}
        items.append((np.array([number.setdefault(t, len(number)) for t in held], np.int64), np.array(list(held.values()), np.int64)))
    return Queries(list(number), np.array([xxhash.xxh3_64_intdigest(t) for t in number], np.uint64), items, n_docs, n_terms)


def _gain(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def upper_bounds(queries: Queries, rows: int, lengths: np.ndarray, bits: np.ndarray, hashes: int) -> Iterator[np.ndarray]:
    """For each item an upper bound of the score of every document of the block."""
    n = len(lengths)
    m = length_norm(lengths, queries.n_docs, queries.n_terms)
    highest = [*(_gain(np.int64(level - 1), m) for level in LEVELS[1:]), np.full(n, LIMIT)]
    step = [highest[0], *(b - a for a, b in zip(highest, highest[1:]))]
    slices, alive = [], np.arange(len(queries.terms))  # terms that reach a level anywhere in the block
    for v in range(len(LEVELS)):
        held = np.bitwise_and.reduce(bits[_row_places(queries.hashes[alive], v, rows, hashes)], axis=1)
        if v:
            held &= slices[-1][1][np.searchsorted(slices[-1][0], alive)]
        some = held.any(axis=1)
        alive = alive[some]
        if not len(alive):
            break
        slices.append((alive, held[some]))
    for terms, weights in queries.items:
        bound = np.zeros(n, np.int64)
        for v, (present, held) in enumerate(slices):
            at = np.searchsorted(present, terms)
            hit = at < len(present)
            hit[hit] = present[at[hit]] == terms[hit]
            if not hit.any():
                break
            ones = np.unpackbits(held[at[hit]], axis=1, count=n, bitorder="little")
            bound += step[v] * (weights[hit].astype(np.float64) @ ones).astype(np.int64)  # exact: far below 2**53
        yield bound


def _candidates(index: DataFrame, id_type: str, queries: Queries, params: SignatureParams, best: int | None = None,
                floors: list[int] | None = None) -> DataFrame:
    """(item, id, bound): every block's ``best`` documents by bound, or all that reach their item's floor."""
    shared = index.sparkSession.sparkContext.broadcast((queries, floors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, floor = shared.value
        for batch in batches:
            for ids, lengths, rows, raw in zip(batch["ids"], batch["lengths"], batch["rows"], batch["slices"]):
                length = np.frombuffer(lengths, "<i8")
                bits = np.frombuffer(raw, np.uint8).reshape(rows, -1)
                out = {"item": [], "id": [], "bound": []}
                for i, bound in enumerate(upper_bounds(asked, rows, length, bits, params.hashes)):
                    if floor is not None:
                        at = np.flatnonzero((bound >= floor[i]) & (bound > 0))
                    else:
                        at = np.argpartition(-bound, best - 1)[:best] if len(bound) > best else np.arange(len(bound))
                        at = at[bound[at] > 0]
                    out["item"] += [i] * len(at)
                    out["id"] += [ids[j] for j in at.tolist()]
                    out["bound"] += bound[at].tolist()
                yield pd.DataFrame({"item": pd.Series(out["item"], dtype="int32"), "id": pd.Series(out["id"], dtype=object),
                                    "bound": pd.Series(out["bound"], dtype="int64")})

    return index.mapInPandas(run, f"item int, id {id_type}, bound long")


def _rescore(docs: DataFrame, id_col: str, text: str, pairs: DataFrame, queries: Queries, params: SignatureParams) -> DataFrame:
    """The exact scores above 0 of the (item, id) ``pairs``, from the whole texts.

    Pairs are gathered by document (at most one per item of the round). They are
    broadcast up to a bound on their measured number; else the documents are shuffled to them.
    """
    spark = docs.sparkSession
    wanted = stage(pairs.groupBy("id").agg(F.collect_set("item").alias("items")), "search-pairs")
    size = wanted.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    wanted = wanted.withColumnRenamed("id", "_wanted")
    if size <= params.broadcast_rows:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).join(wanted, F.col("_id").eqNullSafe(F.col("_wanted")))
    shared = spark.sparkContext.broadcast(queries)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        number = {t: i for i, t in enumerate(asked.terms)}
        times = np.zeros(len(number), np.int64)
        for batch in batches:
            out = []
            for key, t, items in zip(batch["_id"].tolist(), batch["_t"].tolist(), batch["items"]):
                terms = terms_of(t if isinstance(t, str) else None)
                m = length_norm(len(terms), asked.n_docs, asked.n_terms)
                held = Counter(filter(number.__contains__, terms))
                at = np.array([number[x] for x in held], np.int64)
                times[at] = list(held.values())
                for i in items:
                    of, weights = asked.items[i]
                    score = int((weights * _gain(times[of], m)).sum())
                    if score > 0:
                        out.append((i, None if pd.isna(key) else key, score))
                times[at] = 0
            found = pd.DataFrame(out, columns=["item", "id", "score"])
            yield found.astype({"item": "int32", "id": object, "score": "int64"})

    return rows.select("_id", "_t", "items").mapInPandas(run, f"item int, id {id_type}, score long")


def _first(scored: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each item, highest score first, equal ones by id."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", params: SignatureParams = SignatureParams()) -> DataFrame:
    """``item_id``, rank (from 1), ``id_col`` and score of the ``k`` best documents of every item.

    The items are the stated queries: they are read to the driver in rounds of at most
    ``item_bytes`` of text, and every round runs against all blocks of the index.
    """
    spark = prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    index = stage(build_index(docs, id_col, text, params), "signatures")
    asked = items.select(F.col(item_id).alias("_item"), F.coalesce(F.col(item_text), F.lit("")).alias("_text"))
    out = spark.createDataFrame([], f"`{item_id}` {item_type}, rank int, `{id_col}` {id_type}, score long")
    for held in _rounds(asked, params.item_bytes):
        texts = [r["_text"] for r in held]
        n_docs, n_terms, df = statistics(docs, text, frozenset(t for x in texts for t in terms_of(x)))
        queries = _queries(texts, n_docs, n_terms, df)
        if not len(queries.terms):
            continue
        # Floors: the k-th best exact score among the documents with the highest bounds.
        high = stage(_candidates(index, id_type, queries, params, best=k), "search-bounds")
        high = _first(high.withColumnRenamed("bound", "score"), params.floor_pool * k).select("item", "id")
        exact = stage(_rescore(docs, id_col, text, high, queries, params), "search-floors")
        floors = [0] * len(texts)
        for r in _first(exact, k).filter(F.col("rank") == k).select("item", "score").collect():
            floors[r["item"]] = r["score"]
        reached = _candidates(index, id_type, queries, params, floors=floors).select("item", "id")
        scored = _rescore(docs, id_col, text, reached, queries, params)
        names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(held)], f"item int, _item {item_type}")
        found = _first(scored, k).join(F.broadcast(names), "item")  # one row per item of the round
        found = found.select(F.col("_item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = out.unionByName(found)
    return out


def _rounds(items: DataFrame, most: int) -> Iterator[list]:
    """The items in rounds of at most ``most`` bytes of text (one item at least)."""
    held, size = [], 0
    for r in items.toLocalIterator():
        n = len(r["_text"].encode("utf-8", "surrogatepass"))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield held
