"""Operator 2: nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample and every vector is routed to one leaf per
tree. A query walks all trees at once with one priority queue ordered by the
margin to the splitting planes and visits leaves until they are expected to hold a
share of the index. That share is the least at which queries held out of the sample
find ``recall`` of their nearest neighbours in the sample. Candidates are then
reranked exactly, in double precision, leaf by leaf in blocks. A row knows its leaves
in all trees and a query those it visits, so a candidate that several visited leaves
hold is scored in the first of them only: each once, never more than an exact scan.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, and neither do rows without an id. Equal
vectors are indexed once with their smallest ids. Rows repeating an id and vector
count once. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import hash_sample, prepare, stage


@dataclass(frozen=True)
class ForestParams:
    """``sample_rows`` is about what is collected to grow the trees; every vector is indexed.

    ``recall`` is what the held-out queries must reach; more rows lie closer together, so
    the whole table's recall is rather higher. ``share`` fixes the share of the index that
    visited leaves are expected to hold instead of fitting it. Data without cluster
    structure needs a large one; the README has measured figures.
    """

    trees: int = 6
    leaf_rows: int = 128
    sample_rows: int = 20_000
    recall: float = 0.95
    held_out: int = 100
    share: float | None = None
    block_rows: int = 4096
    seed: int = 5


@dataclass
class Tree:
    """Split planes and children; a negative child c is leaf -c - 1."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int


def grow(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    """Halve the sample at planes between two random centres until parts have ``leaf_rows`` or fewer."""
    normals, offsets, children, leaves = [], [], [], 0
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = _plane(sample, rows, rng) if len(rows) > leaf_rows else None
        if split is None:
            number, leaves = -leaves - 1, leaves + 1
        else:
            normal, offset, left = split
            number = len(normals)
            normals.append(normal)
            offsets.append(offset)
            children.append([0, 0])
            todo += [(rows[left], number, 0), (rows[~left], number, 1)]
        if parent >= 0:
            children[parent][side] = number
    dim = sample.shape[1]
    return Tree(np.array(normals).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def _plane(sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator):
    for _ in range(4):
        a, b = sample[rng.choice(rows, 2, replace=False)]
        some = sample[rng.choice(rows, min(len(rows), 256), replace=False)]
        for _ in range(3):
            near_a = ((some - a) ** 2).sum(1) < ((some - b) ** 2).sum(1)
            if near_a.any() and not near_a.all():
                a, b = some[near_a].mean(0), some[~near_a].mean(0)
        normal = a - b
        length = np.linalg.norm(normal)
        if length > 0:
            normal = normal / length
            at = sample[rows] @ normal
            offset = float(np.median(at))
            left = at < offset
            if left.any() and not left.all():
                return normal, offset, left
    return None


def route(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    at = np.zeros(len(vectors), np.int64) if len(tree.normals) else np.full(len(vectors), -1)
    while len(inner := np.flatnonzero(at >= 0)):
        node = at[inner]
        right = (vectors[inner] * tree.normals[node]).sum(1) >= tree.offsets[node]
        at[inner] = tree.children[node, right.astype(np.int64)]
    return -at - 1


def search(trees: list[Tree], held: list[np.ndarray], query: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of one queue over all trees, until ``wanted`` vectors are expected.

    Trees are independent partitions of the index, so visiting shares p_1..p_T of
    them reaches an expected share of 1 - prod(1 - p_t).
    """
    total = max(1, int(held[0].sum()))
    sides = [t.normals @ query - t.offsets for t in trees]
    queue = [(0.0, t, 0 if len(tree.normals) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    missed, seen, out = 1.0, [0.0] * len(trees), []
    while queue and 1 - missed < wanted:
        margin, t, node = heapq.heappop(queue)
        if node < 0:
            leaf = -node - 1
            out.append((t, leaf))
            seen[t] += held[t][leaf] / total
            missed = float(np.prod([1 - min(1.0, s) for s in seen]))
            continue
        side = float(sides[t][node])
        near, far = trees[t].children[node][:: 1 if side < 0 else -1].tolist()
        heapq.heappush(queue, (margin, t, near))
        heapq.heappush(queue, (max(margin, abs(side)), t, far))
    return out


def fitted_share(trees: list[Tree], points: np.ndarray, k: int, params: ForestParams, rng: np.random.Generator) -> float:
    """The least share (in steps of 0.05) at which held-out queries find ``params.recall`` of their k nearest sample points."""
    if len(points) <= k + 1:
        return 1.0
    asked = rng.permutation(len(points))[: params.held_out]
    leaf_of = [route(t, points) for t in trees]
    held = [np.bincount(at, minlength=t.leaves) for t, at in zip(trees, leaf_of)]
    shares = np.arange(0.05, 1.0, 0.05)
    found = np.zeros(len(shares))
    for q in asked:
        far = ((points - points[q]) ** 2).sum(1)
        far[q] = np.inf
        want = np.argpartition(far, k)[:k]
        # The queue's order does not depend on the share, so one walk tells at which share each neighbour is reached.
        reached, missed, seen = np.ones(k), 1.0, [0.0] * len(trees)
        for t, leaf in search(trees, held, points[q], 1.0):
            hit = (leaf_of[t][want] == leaf) & (reached == 1.0)
            reached[hit] = 1 - missed
            seen[t] += held[t][leaf] / len(points)
            missed = float(np.prod([1 - min(1.0, s) for s in seen]))
        found += (reached[None, :] < shares[:, None]).mean(axis=1)
    enough = np.flatnonzero(found / len(asked) >= params.recall)
    return float(shares[enough[0]]) if len(enough) else 1.0


def visited_before(visits: list[tuple[int, int]], trees: list[Tree]) -> list[bytes]:
    """For each tree, the bits of the leaves that a query visits in the trees before it, end to end."""
    marks, out = [], []
    for t, tree in enumerate(trees):
        out.append(b"".join(marks))
        mark = np.zeros(-(-tree.leaves // 8) * 8, np.uint8)
        mark[[leaf for of, leaf in visits if of == t]] = 1
        marks.append(np.packbits(mark, bitorder="little").tobytes())
    return out


def usable(column: str) -> F.Column:
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
            params: ForestParams = ForestParams()) -> DataFrame:
    """query_id, rank, ``id_col``, score: the k nearest found of every row that ``is_query`` marks."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & usable("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 0
    rows = rows.filter(F.size("v") == dim).groupBy("v", "id").agg(F.max("q").alias("q"))

    # Equal vectors: only the k + 1 smallest ids can appear among k results without the query's own.
    least = rows.withColumn("n", F.expr("row_number() over (partition by v order by id)")).filter(F.col("n") <= k + 1)
    groups = stage(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("gid", F.col("ids")[0]), "vectors")
    asked = rows.filter("q").select("v", F.col("id").alias("query_id"))
    asked = stage(groups.select("v", "gid").join(asked, "v").select("gid", "query_id"), "asked")
    queries = groups.join(asked.select("gid").distinct(), "gid").select("gid", "v")

    sample = hash_sample(groups.select("gid", "v"), "gid", params.sample_rows).collect()
    points = np.array([r["v"] for r in sample], np.float64).reshape(-1, max(dim, 1))
    rng = np.random.default_rng(params.seed)
    trees = [grow(points, params.leaf_rows, rng) for _ in range(params.trees)]

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist(), np.float64).reshape(len(batch), -1)
            at = np.stack([route(tree, x) for tree in trees], axis=1).astype(np.int32)
            for t in range(len(trees)):
                yield pd.DataFrame({"tree": t, "leaf": at[:, t], "gid": batch["gid"], "v": batch["v"],
                                    "before": [row.tobytes() for row in np.ascontiguousarray(at[:, :t])]})

    # ``before``: of a row its leaves in the earlier trees, of a query the bits of those it visits there.
    routed = f"tree int, leaf int, gid long, v {groups.schema['v'].dataType.simpleString()}, before binary"
    share = fitted_share(trees, points, k, params, rng) if params.share is None else params.share
    index = stage(groups.select("gid", "v").mapInPandas(leaves, routed), "index")
    held = [np.zeros(tree.leaves, np.int64) for tree in trees]
    for r in index.groupBy("tree", "leaf").count().collect():  # as many rows as the trees have leaves
        held[r["tree"]][r["leaf"]] = r["count"]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for gid, v in zip(batch["gid"].tolist(), batch["v"].tolist()):
                visits = search(trees, held, np.array(v, np.float64), share)
                before = visited_before(visits, trees)
                found += [(t, leaf, gid, v, before[t]) for t, leaf in visits]
            yield pd.DataFrame(found, columns=["tree", "leaf", "gid", "v", "before"])

    probes = stage(queries.mapInPandas(visit, routed), "probes")
    asking = {(r["tree"], r["leaf"]): r["count"] for r in probes.groupBy("tree", "leaf").count().collect()}

    # A leaf and its queries meet in blocks of bounded size.
    blocks = [(t, leaf, -(-int(held[t][leaf]) // params.block_rows), -(-n // params.block_rows)) for (t, leaf), n in asking.items()]
    blocks = spark.createDataFrame(blocks, "tree int, leaf int, rows_in int, asked_in int")
    sized = F.broadcast(blocks)  # at most trees * leaves rows
    own = F.expr("cast(pmod(xxhash64(gid), rows_in) as int)")
    index = index.join(sized, ["tree", "leaf"]).select("tree", "leaf", own.alias("i"), F.explode(F.expr("sequence(0, asked_in - 1)")).alias("j"), "gid", "v", "before")
    theirs = F.expr("cast(pmod(xxhash64(gid), asked_in) as int)")
    probes = probes.join(sized, ["tree", "leaf"]).select("tree", "leaf", F.explode(F.expr("sequence(0, rows_in - 1)")).alias("i"), theirs.alias("j"), "gid", "v", "before")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "gid": [], "score": []})
        left = left.sort_values("gid", ignore_index=True)
        gids, x = left["gid"].to_numpy(), np.stack(left["v"].to_numpy()).astype(np.float64)
        tree = int(left["tree"].iloc[0])
        leaf = np.frombuffer(b"".join(left["before"]), np.int32).reshape(len(left), tree)
        first = np.cumsum([0, *(-(-t.leaves // 8) * 8 for t in trees)])[:tree]
        asks, found, scores = [], [], []
        for query, v, before in zip(right["gid"].tolist(), right["v"].tolist(), right["before"].tolist()):
            new = np.ones(len(left), bool)
            if tree:  # rows of leaves that the query visits in an earlier tree are scored there
                visited = np.unpackbits(np.frombuffer(before, np.uint8), bitorder="little")
                new = ~visited[leaf + first].any(axis=1)
            at = np.flatnonzero(new)
            score = np.sqrt(((x[at] - np.asarray(v, np.float64)) ** 2).sum(1))
            best = np.argsort(score, kind="stable")[: k + 1]
            asks.append(np.full(len(best), query))
            found.append(gids[at[best]])
            scores.append(score[best])
        return pd.DataFrame({"query": np.concatenate(asks), "gid": np.concatenate(found), "score": np.concatenate(scores)})

    keys = ["tree", "leaf", "i", "j"]
    scored = index.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(rerank, "query long, gid long, score double")
    best = scored.withColumn("n", F.expr("row_number() over (partition by query order by score, gid)")).filter(F.col("n") <= k + 1)
    best = stage(best, "best")
    spread = best.join(groups.select("gid", "ids"), "gid").select("query", "score", F.explode("ids").alias("id"))
    spread = spread.withColumn("n", F.expr("row_number() over (partition by query order by score, id)")).filter(F.col("n") <= k + 1)
    lists = stage(spread.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found")), "lists")
    answers = asked.join(lists, asked.gid == lists.query)
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(others).alias("n", "x"))
    return answers.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
