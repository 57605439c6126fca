"""Operator 6: SimHash near-duplicates by tiled exact comparison.

A fingerprint has one bit per position that is set in over half of the hashes of
the text's word shingles. Distinct fingerprints are grouped into tiles by the
population counts of their two halves. The summed difference of the counts is a
lower bound of the bit distance, so tile pairs further apart than the radius are
skipped; all others are compared whole with exclusive-or and bit counts. Inside a
tile pair, the counts of four quarters skip sub-tiles in the same way.

A tile pair returns a spanning forest of its links, never all pairs: the links of
all forests connect exactly what all links connect. Components come from rounds of
hooking to the smallest neighbour over staged tables.

Null and blank texts have fingerprint zero and are linked like any other. Equal
texts share a fingerprint and are compared once. Null ids take part; a component's
id is the smallest non-null one. Texts of any length are read whole. An empty table
gives no rows. Kept columns come as struct ``_row``, so no name in them can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import keep_rows, keyed, prepare, stage, unstage

SEED = 42
# Fingerprints of a tile: the least, and the most that a task holds of either side (32 MB). Between them tiles
# grow with the table, so that about so many chunks are met by every fingerprint and the shuffle stays near its size.
TILE_ROWS, MOST_ROWS = 4096, 4 << 20
FEW_CHUNKS = 512
_BLOCK = 1 << 18
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, width: int) -> int:
    """The 64-bit fingerprint of a text's ``width``-word shingles (unsigned)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    span = min(width, len(words))
    first, last = start[: len(words) - span + 1].tolist(), end[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(packed.view(np.uint64)[0])


def fingerprint_column(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            prints = np.array([simhash(t if isinstance(t, str) else None, width) for t in batch.tolist()], np.uint64)
            yield pd.Series(prints.view(np.int64))

    return run(text)


def _ones(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def _quarters(values: np.ndarray) -> np.ndarray:
    return _ones(values.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between ``a`` and ``b`` (or within ``a``)."""
    nodes = a if b is None else np.concatenate([a, b])
    other = 0 if b is None else len(a)
    b = a if b is None else b
    parent = np.arange(len(nodes))
    edges: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def flatten() -> None:
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up

    def runs(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        classes, of = np.unique(_quarters(values), axis=0, return_inverse=True)
        order = np.argsort(of, kind="stable")
        return classes.astype(np.int16), np.split(order, np.cumsum(np.bincount(of, minlength=len(classes)))[:-1])

    class_a, rows_a = runs(a)
    class_b, rows_b = runs(b)
    for ca, ra in zip(class_a, rows_a):
        near = np.flatnonzero(np.abs(class_b - ca).sum(axis=1) <= radius)
        if not len(near):
            continue
        rb = np.concatenate([rows_b[k] for k in near])
        step = max(1, _BLOCK // len(rb))
        for at in range(0, len(ra), step):
            row = ra[at : at + step]
            linked = _ones(a[row][:, None] ^ b[rb][None, :]) <= radius
            while True:
                linked &= parent[row][:, None] != parent[rb + other][None, :]
                hit = np.flatnonzero(linked.any(axis=1))
                if not len(hit):
                    break
                for i, j in zip(row[hit].tolist(), (rb[linked[hit].argmax(axis=1)] + other).tolist()):
                    x, y = root(i), root(j)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        edges.append((i, j))
                flatten()
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def tile_plan(counts: dict[tuple[int, int], int], radius: int) -> list[tuple]:
    """For each class of population counts its chunks and the classes it meets: rows (lo, hi, chunks, [(pair, side, other_chunks), ...]).

    ``counts``: fingerprints by the population counts of the two halves, 33 x 33 classes
    at most, whatever the table's size; each meets the 41 at most that are within reach.
    A pair of classes has a number; in the pair of a class with itself the side is -1.
    """
    total = sum(counts.values())
    rows = min(max(TILE_ROWS, -(-total // FEW_CHUNKS)), MOST_ROWS)
    chunks = {t: -(-n // rows) for t, n in counts.items()}
    meets: dict[tuple[int, int], list[tuple[int, int, int]]] = {t: [] for t in counts}
    pair = 0
    for x in counts:
        for lo in range(x[0], x[0] + radius + 1):
            reach = radius - (lo - x[0])
            for hi in range(x[1] - reach, x[1] + reach + 1):
                y = (lo, hi)
                if y in chunks and y >= x:
                    meets[x].append((pair, 0 if y != x else -1, chunks[y]))
                    if y != x:
                        meets[y].append((pair, 1, chunks[x]))
                    pair += 1
    return [(*t, chunks[t], meets[t]) for t in counts]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints ``fp`` at ``radius`` bits or fewer.

    A tile is a chunk of a class. Every fingerprint is dealt to the pairs of its tile
    with each chunk of each class within reach; which these are follows from the classes alone.
    """
    spark = prints.sparkSession
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)))
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    tiles = prints.select("fp", low.cast("int").alias("lo"), high.cast("int").alias("hi"))
    histogram = {(r["lo"], r["hi"]): r["count"] for r in tiles.groupBy("lo", "hi").count().collect()}
    plan = spark.createDataFrame(tile_plan(histogram, radius), "lo int, hi int, chunks int, meets array<struct<pair:int,side:int,others:int>>")
    placed = tiles.join(F.broadcast(plan), ["lo", "hi"]).withColumn("own", F.expr("cast(pmod(xxhash64(fp), chunks) as int)"))
    met = placed.select("fp", "own", F.explode("meets").alias("m")).select("fp", "own", "m.pair", "m.side", F.explode(F.expr("sequence(0, m.others - 1)")).alias("other"))
    first = F.expr("if(side = 1 or (side = -1 and other < own), other, own)").alias("first")
    second = F.expr("if(side = 1 or (side = -1 and other < own), own, other)").alias("second")
    later = F.expr("if(side = -1, own > other, side = 1)").alias("later")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        values, second = group["fp"].to_numpy().view(np.uint64), group["later"].to_numpy()
        u, v = tile_forest(values[~second], values[second] if second.any() else None, radius) if not second.all() else (values[:0], values[:0])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return met.select("pair", first, second, later, "fp").groupBy("pair", "first", "second").applyInPandas(compare, "u long, v long")


def _to_roots(hook: DataFrame) -> DataFrame:
    """Follow the hooks (u, to), which only lead downwards, until each points at its last node."""
    while True:
        further = hook.select(F.col("u").alias("to"), F.col("to").alias("next"))
        jumped = stage(hook.join(further, "to").select("u", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("on")), "hooks")
        unstage(hook)
        hook = jumped
        if jumped.filter("on").isEmpty():
            return hook


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the same for connected nodes) of every node of ``edges`` (u, v).

    Each round hooks every node to its smallest neighbour, follows the hooks to their
    ends by doubling, and rewrites the edges; equal ends and repeats go. Every table is
    staged, so a lost executor costs a reread.
    """
    edges = stage(edges.filter("u <> v").distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    labels = stage(nodes.withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to"))
        hook = _to_roots(stage(hook, "hooks"))
        of_u = hook.select("u", F.col("to").alias("a"))
        of_v = hook.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = edges.join(of_u, "u").join(of_v, "v").filter("a <> b")
        moved = stage(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        step = hook.select(F.col("u").alias("root"), "to")
        renamed = stage(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        unstage(edges, hook, labels)
        edges, labels = moved, renamed
    unstage(edges)
    return labels


def fingerprints(docs: DataFrame, keep: list[str], width: int, id_col: str, text: str) -> DataFrame:
    """Staged rows: ``keep`` columns as struct ``_row``, ``_id`` and ``fp``."""
    prepare(docs.sparkSession)
    return stage(docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(id_col).alias("_id"),
                             fingerprint_column(F.col(text), width).alias("fp")), "prints")


def linked_classes(prints: DataFrame, radius: int) -> DataFrame:
    """``fp`` and ``root`` of the distinct fingerprints that have a link; ``root`` names the component."""
    found = components(links(prints, radius))
    renamed = found.withColumnRenamed("node", "fp")
    renamed._staged_at = found._staged_at
    return renamed


def classes(rows: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``root`` and ``component_id`` of every distinct fingerprint of ``rows``.

    ``root`` names the component (a fingerprint without links is its own);
    ``component_id`` is the smallest id in it. Only fingerprints with links are grouped
    by component, and the group's row is staged, so that a join with a large component can be split.
    """
    prints = stage(rows.groupBy("fp").agg(F.min("_id").alias("first_id")), "distinct-prints")
    labels = linked_classes(prints, radius)
    named = stage(prints.join(labels, "fp", "left"), "named-prints")
    linked = named.filter("root is not null")
    smallest = stage(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    alone = named.filter("root is null").select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"))
    found = stage(linked.join(smallest, "root").select("fp", "root", "component_id").union(alone), "components")
    unstage(prints, labels, named, smallest)
    return found


def near_duplicates(docs: DataFrame, keep: list[str], width: int = 4, radius: int = 4, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Every row's ``keep`` columns as struct ``_row``, with ``_id``, ``fp``, ``root`` and ``component_id``."""
    rows = fingerprints(docs, keep, width, id_col, text)
    return rows.join(classes(rows, radius), "fp")


def keep_one(docs: DataFrame, keep: list[str], width: int = 4, radius: int = 4, id_col: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The ``keep`` columns of one row of each component: the one with the smallest id (null last).

    Narrow rows with the place of each document are staged; the first of each fingerprint,
    then of each component, is kept. The documents themselves are only read again and filtered.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs)
    prints = stage(rows.select(fingerprint_column(F.col(f"_row.`{text}`"), width).alias("fp"), F.col(f"_row.`{id_col}`").alias("_id"), "_file", "_at"), "prints")
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_file", "_at")).alias("first")
    firsts = stage(prints.groupBy("fp").agg(first), "distinct-prints")
    labels = linked_classes(firsts.select("fp"), radius)
    alone = firsts.join(labels, "fp", "left_anti").select("first")
    of_class = firsts.join(labels, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first")
    kept = keep_rows(rows, alone.union(of_class).select("first._file", "first._at"))
    unstage(prints, firsts, labels)  # the kept rows are staged
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep])
