"""Operator 8: mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A flow routes each pattern's words to the quotas of its sources; the r-th
repetition of a pattern is an arc of its size with cost r * r, so repeats are
spread before any pattern is repeated more often. Inside a pattern, whole
repetitions go to every document and the rest to documents in a seeded hash order.

Null texts have size 0 and are never taken. Null sources form a source of their
own, last in order. Repeated rows are documents of their own. Texts of any length
count whole. Kept columns come as struct ``_row``, so no name in them can clash. An
empty table gives no rows. Only the pattern table (at most ``MAX_PATTERNS`` rows, checked)
reaches the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import keyed, stage, unstage, word_count

MAX_PATTERNS = 100_000
HASH_BITS = 12
# Rows that one pass weighs against each other after its run; later passes look at the others.
FILL_ROWS = 64


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; what exceeds ``cap`` times a size is reshared among the others until none does."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, n in enumerate(sizes) if n > 0], float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > cap * sizes[i] * weight]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


class Flow:
    """Min-cost flow by successive shortest paths with potentials; parallel arcs model convex costs."""

    def __init__(self, nodes: int):
        self.arcs: list[list[list]] = [[] for _ in range(nodes)]  # [to, capacity, cost, index of the reverse arc]

    def add(self, a: int, b: int, capacity: int, cost: int) -> list:
        forward = [b, capacity, cost, len(self.arcs[b])]
        self.arcs[a].append(forward)
        self.arcs[b].append([a, 0, -cost, len(self.arcs[a]) - 1])
        return forward

    def run(self, source: int, sink: int) -> int:
        n, moved, potential = len(self.arcs), 0, [0] * len(self.arcs)
        while True:
            dist, via, queue = [None] * n, [None] * n, [(0, source)]
            dist[source] = 0
            while queue:
                d, a = heapq.heappop(queue)
                if d > dist[a]:
                    continue
                for arc in self.arcs[a]:
                    b, capacity, cost, _ = arc
                    if capacity > 0:
                        nd = d + cost + potential[a] - potential[b]
                        if dist[b] is None or nd < dist[b]:
                            dist[b], via[b] = nd, (a, arc)
                            heapq.heappush(queue, (nd, b))
            if dist[sink] is None:
                return moved
            farthest = max(d for d in dist if d is not None)
            potential = [p + (farthest if d is None else d) for p, d in zip(potential, dist)]
            push, at = None, sink
            while at != source:
                a, arc = via[at]
                push = arc[1] if push is None else min(push, arc[1])
                at = a
            at = sink
            while at != source:
                a, arc = via[at]
                arc[1] -= push
                self.arcs[at][arc[3]][1] += push
                at = a
            moved += push


def route(patterns: list[tuple[tuple, int]], quota: dict, repeats: int) -> list[int]:
    """Words to take from each (sources, size) pattern for the source quotas.

    Patterns that share no source, directly or through others, do not meet in the
    flow; each such part is solved on its own.
    """
    names = list(quota)
    place = {s: i for i, s in enumerate(names)}
    part = list(range(len(names)))

    def top(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for sources, _ in patterns:
        for s in sources[1:]:
            part[top(place[s])] = top(place[sources[0]])
    groups: dict[int, list[int]] = {}
    for k, (sources, size) in enumerate(patterns):
        if size and sources:
            groups.setdefault(top(place[sources[0]]), []).append(k)
    taken = [0] * len(patterns)
    for members in groups.values():
        used = sorted({place[s] for k in members for s in patterns[k][0]})
        at = {s: 2 + len(members) + j for j, s in enumerate(used)}
        flow = Flow(2 + len(members) + len(used))
        arcs = []
        for j, k in enumerate(members):
            sources, size = patterns[k]
            arcs.append([flow.add(0, 2 + j, size, r * r) for r in range(1, repeats + 1)])
            for s in sources:
                flow.add(2 + j, at[place[s]], repeats * size, 0)
        for s in used:
            flow.add(at[s], 1, round(quota[names[s]]), 0)
        flow.run(0, 1)
        for k, steps in zip(members, arcs):
            taken[k] = sum(patterns[k][1] - arc[1] for arc in steps)
    return taken


def mix(docs: DataFrame, keep: list[str], weights: list[float], sources: str = "source", text: str = "text",
        repeats: int = 3, total_share: float = 1.0, seed: int = 17) -> DataFrame:
    """Every row's ``keep`` columns as struct ``_row``, with size, epochs and taken (= epochs * size).

    ``sources`` is a string column or an array of strings (overlapping sources);
    ``weights`` are dealt to the sources in code-point order, null last, repeating.
    Also ``source_size`` and ``target`` of the row's (first) source.
    """
    spark = docs.sparkSession
    docs_by_key = keyed(docs)
    member = F.col(f"_row.`{sources}`")
    if not isinstance(docs.schema[sources].dataType, T.ArrayType):
        member = F.array(member)
    member = F.when(F.size(member) > 0, F.array_sort(F.array_distinct(member))).otherwise(F.array(F.lit(None).cast("string")))
    # Equal rows have equal places in the seeded order; which of them is taken makes no difference.
    kept, whole_text = [F.col(f"_row.`{c}`") for c in keep], F.col(f"_row.`{text}`")
    order = F.xxhash64(F.lit(seed), *kept, whole_text)
    documents = docs_by_key.select(F.struct(*[c.alias(n) for c, n in zip(kept, keep)]).alias("_row"), member.alias("_pattern"),
                                   word_count(whole_text).alias("size"), F.shiftrightunsigned(order, 1).alias("_order"),
                                   F.struct("_file", "_at").alias("_id"))
    # Narrow rows are staged and decided on; the documents are read once more and follow from the decisions.
    rows = stage(documents.drop("_row"), "mix")

    found = rows.groupBy("_pattern").agg(F.sum("size").alias("size"))
    found = found.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group rare sources first")
    found = sorted(((tuple(r["_pattern"]), r["size"]) for r in found), key=lambda p: [(s is None, s or "") for s in p[0]])
    size_of: dict = {}
    for pattern, size in found:
        for s in pattern:
            size_of[s] = size_of.get(s, 0) + size
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    share = [weights[i % len(weights)] for i in range(len(names))]
    total = total_share * sum(size for _, size in found)
    quota = dict(zip(names, targets([size_of[s] for s in names], share, total, repeats)))
    taken = route(found, quota, repeats)

    plan = [(list(p), size, size_of[p[0]], quota[p[0]], t // size if size else 0, t % size if size else 0)
            for (p, size), t in zip(found, taken)]
    schema = "_pattern array<string>, _size long, source_size long, target double, _whole int, _rest long"
    plan = stage(spark.createDataFrame(plan, schema).coalesce(1), "mix-plan")
    return _select(documents, rows, plan)


def _select(documents: DataFrame, rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Give ``_whole`` repetitions to every row and one more to rows that together have about ``_rest`` words.

    After a pass over all rows, passes over those still free that fit into what is open
    are repeated until there are none: what stays open is less than any row left out. A pass's rows
    follow from one line per pattern, so rows are joined once, after the last pass.
    """
    free = rows.select("_pattern", "size", "_order", "_id").join(plan.select("_pattern", F.col("_rest").alias("_gap")), "_pattern")
    free = stage(free.filter("0 < size and 0 < _gap"), "mix-free")  # the first pass stops at any row that is too large
    steps = []
    while not free.isEmpty():  # from the second pass on the first free row always fits, so every pass takes some
        steps.append(_pass(free))
        left = steps[-1].select("_pattern", F.col("_left").alias("_gap"), "_cut", "_fill")
        rest = free.drop("_gap").join(left, "_pattern").filter(f"size <= _gap and not ({_TAKEN})").select("_pattern", "size", "_order", "_id", "_gap")
        rest = stage(rest, "mix-free")
        unstage(free)
        free = rest
    unstage(free, rows)
    taken = None
    for step in steps:
        taken = step if taken is None else taken.unionByName(step)
    extra = F.lit(False)
    if taken is not None:
        taken = taken.groupBy("_pattern").agg(F.collect_list(F.struct("_gap", "_cut", "_fill")).alias("_steps"))
        plan = stage(plan.join(taken, "_pattern", "left"), "mix-steps")  # one row per pattern
        within = _TAKEN.replace("_cut", "s._cut").replace("_fill", "s._fill")
        extra = F.expr(f"coalesce(exists(_steps, s -> size <= s._gap and ({within})), false)")
    out = documents.join(plan, "_pattern")
    epochs = F.when(F.col("size") > 0, F.col("_whole") + extra.cast("int")).otherwise(0).cast("int")
    return out.withColumn("epochs", epochs).select("_row", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).cast("long").alias("taken"))


# Whether a pass took a row of its table of free rows: before the cut (null: all fit), or to fill the gap.
_TAKEN = "_cut is null or _order < _cut._order or (_order = _cut._order and _id < _cut._id) or coalesce(array_contains(_fill, _id), false)"


def _pass(free: DataFrame) -> DataFrame:
    """Per pattern of ``free`` rows: which rows are taken into its ``_gap``, and the words ``_left`` open.

    Taken are the longest run in hash order that fits, up to ``_cut``, and in ``_fill``
    the largest that still fit of the next rows. Hash ranges are summed first; only the
    range in which the run ends is ordered row by row, so no task ever holds a whole pattern.
    """
    free = free.withColumn("_bucket", F.shiftright("_order", 63 - HASH_BITS).cast("int"))
    sums = free.groupBy("_pattern", "_gap", "_bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("_before", F.expr("sum(n) over (partition by _pattern order by _bucket) - n"))
    sums = stage(sums, "mix-sums")
    edge = sums.filter("_before <= _gap and _gap < _before + n").select("_pattern", F.col("_bucket").alias("_edge"), "_before")
    inside = free.join(edge, "_pattern").filter("_bucket = _edge")
    upto = "sum(size) over (partition by _pattern order by _order, _id rows between unbounded preceding and current row)"
    inside = inside.withColumn("_at", F.expr(f"_before + {upto}"))
    ends = inside.groupBy("_pattern").agg(F.max(F.expr("if(_at <= _gap, _at, _before)")).alias("_used"),
                                          F.min(F.expr("if(_at > _gap, struct(_order, _id), null)")).alias("_cut"))
    totals = sums.groupBy("_pattern", "_gap").agg(F.sum("n").alias("_all"))
    runs = totals.join(ends, "_pattern", "left").select("_pattern", "_gap", "_cut", F.expr("_gap - coalesce(_used, _all)").alias("_left"))
    runs = stage(runs, "mix-runs")

    after = free.drop("_gap").join(runs.filter("_cut is not null and _left > 0"), "_pattern")
    after = after.filter("size <= _left and (_order > _cut._order or (_order = _cut._order and _id > _cut._id))")
    after = after.select("_pattern", "_left", "_order", "_id", "size")
    after = after.withColumn("_n", F.expr("row_number() over (partition by _pattern order by _order, _id)")).filter(F.col("_n") <= FILL_ROWS)
    lists = after.groupBy("_pattern", "_left").agg(F.sort_array(F.collect_list(F.struct("size", "_order", "_id")), asc=False).alias("l"))
    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<struct<_file:string,_at:bigint>>").alias("at"))
    take = lambda acc, x: F.when(x["size"] <= acc["left"], F.struct((acc["left"] - x["size"]).alias("left"),
                                 F.array_append(acc["at"], x["_id"]).alias("at"))).otherwise(acc)
    fills = lists.select("_pattern", F.aggregate("l", start, take).alias("_f"))
    done = runs.join(fills, "_pattern", "left")
    done = stage(done.select("_pattern", "_gap", "_cut", F.col("_f.at").alias("_fill"), F.coalesce("_f.left", "_left").alias("_left")), "mix-step")
    unstage(sums, runs)
    return done
