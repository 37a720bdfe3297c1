"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow network routes each
pattern's words to the quotas of its sources; the r-th use of a word costs r - 1, so costs are convex and words are
repeated only where quotas can't be met otherwise. Only arcs into patterns cost anything, hence successive shortest
paths reduce to one maximum flow a repetition level, cheapest level first. Each pattern's documents then come in a
seeded order along a line of its words; the flow says how far along that line each repetition goes.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm._common import map_arrow, materialize

MAX_REPEATS = 3
#: Patterns whose rules are broadcast to the documents; more are joined by shuffle.
BROADCAST_PATTERNS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[float], weights: Sequence[float], limit: float = MAX_REPEATS, total: float | None = None) -> list[float]:
    """Share total (sum(sizes) unless given) by weight; a share stops at limit * size, the others get its excess by weight."""
    caps = [limit * s for s in sizes]
    rest, free = float(sum(sizes) if total is None else total), sum(weights)
    out = [0.0] * len(caps)
    for i in sorted(range(len(caps)), key=lambda i: (caps[i] / weights[i], i)):
        out[i] = min(float(caps[i]), rest * weights[i] / free)
        rest, free = rest - out[i], free - weights[i]
    return out


def route(capacity: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float], repeats: int = MAX_REPEATS) -> list[dict[int, float]]:
    """flow[pattern][source] of a min-cost flow: as much of the quotas as can be met, with the least repetition cost.

    A source that one pattern holds, and that pattern no other source, has one path only; the others are searched.
    """
    flow: list[dict[int, float]] = [dict.fromkeys(m, 0.0) for m in members]
    need = list(map(float, quota))
    holders = defaultdict(list)
    for p, m in enumerate(members):
        for s in m:
            holders[s].append(p)
    capacity = list(map(float, capacity))
    for p, m in enumerate(members):
        if len(m) == 1 and len(holders[m[0]]) == 1:
            flow[p][m[0]] = min(need[m[0]], repeats * capacity[p])
            need[m[0]] = capacity[p] = 0.0
    tiny = 1e-9 * max(1.0, sum(need))
    for _ in range(repeats):
        spare = list(capacity)
        while True:
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p, c in enumerate(spare) if c > tiny}
            todo, end = deque(came), None
            while todo and end is None:
                kind, at = todo.popleft()
                nexts = [("s", s) for s in members[at]] if kind == "p" else [("p", p) for p in holders[at] if flow[p][at] > tiny]
                for step in nexts:
                    if step not in came:
                        came[step] = (kind, at)
                        todo.append(step)
                        if step[0] == "s" and need[step[1]] > tiny:
                            end = step
                            break
            if end is None:
                break
            path = [end]
            while (back := came[path[-1]]) is not None:
                path.append(back)
            path.reverse()
            backward = [flow[p][s] for (k, s), (_, p) in zip(path, path[1:]) if k == "s"]
            amount = min(spare[path[0][1]], need[end[1]], *backward)
            for (kind, a), (_, b) in zip(path, path[1:]):
                if kind == "p":
                    flow[a][b] += amount
                else:
                    flow[b][a] -= amount
            spare[path[0][1]] -= amount
            need[end[1]] -= amount
    return flow


def mix(docs: DataFrame, id_col: str, size_col: str, members_col: str, weights: Sequence[float] = (5, 2, 1), seed: int = 42, repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, members, source_size, target, copies, routed) for each row of docs.

    members_col is an array of source names (null is a source, sorted last); weights go round over the sources in code
    point order. source_size and target hold one number a member, in the order of members; routed holds the copies
    that went to each. copies is at most `repeats`. Sums over any number of rows are exact; the order is a hash of
    seed, id and size, so that reruns agree. A null size counts as 0; a row without members is never taken; repeated
    rows are rows of their own. An empty table gives an empty table.
    A row a pattern, some 300 bytes, comes to the driver and goes to the tasks, however many there are.
    """
    lined, starts, plan = _planned(docs, id_col, size_col, members_col, weights, seed, repeats)
    shared = docs.sparkSession.sparkContext.broadcast((starts, plan))
    return map_arrow(
        lined,
        lambda batches: _choose(batches, *shared.value),
        "doc_id long, size long, members array<string>, source_size array<long>, target array<double>, copies long, routed array<long>",
    )


def _planned(docs: DataFrame, id_col: str, size_col: str, members_col: str, weights: Sequence[float], seed: int, repeats: int) -> tuple[DataFrame, dict, dict[tuple, _Plan]]:
    """The rows along their patterns' lines, where each pattern starts in each part, and what is taken of each pattern."""
    order = lambda x: (x is None, x or "")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"),
        F.array_sort(F.array_distinct(F.coalesce(F.col(members_col).cast("array<string>"), F.array().cast("array<string>")))).alias("members"),
    )
    rows = materialize(rows.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size")))
    found = rows.groupBy("members").agg(F.sum("size").alias("size")).toLocalIterator()
    patterns = sorted(((tuple(r.members), r.size) for r in found), key=lambda x: [order(m) for m in x[0]])
    sources = sorted({m for p, _ in patterns for m in p}, key=order)
    number = {s: i for i, s in enumerate(sources)}
    sizes = [0] * len(sources)
    for p, size in patterns:
        for m in p:
            sizes[number[m]] += size
    share = [weights[i % len(weights)] for i in range(len(sources))]
    total = sum(size for p, size in patterns if p)
    targets = water_fill(sizes, share, repeats, total)
    flows = route([size for _, size in patterns], [[number[m] for m in p] for p, _ in patterns], targets, repeats)

    parts = rows.repartitionByRange("members", "place", "doc_id").sortWithinPartitions("members", "place", "doc_id", "size")
    lined = materialize(map_arrow(parts.withColumn("part", F.spark_partition_id()), _running, "doc_id long, size long, members array<string>, part int, before long"))
    starts: dict[tuple[int, tuple], int] = {}
    run: dict[tuple, int] = defaultdict(int)
    # one row for each part and each pattern that begins in it
    for r in sorted(lined.groupBy("part", "members").agg(F.sum("size").alias("size")).collect(), key=lambda r: r.part):
        starts[r.part, tuple(r.members)] = run[tuple(r.members)]
        run[tuple(r.members)] += r.size
    plan = {
        p: _Plan(size, [(sizes[number[m]], targets[number[m]], flow[number[m]]) for m in p], repeats)
        for (p, size), flow in zip(patterns, flows)
    }
    _top_up(lined, starts, plan)
    return lined, starts, plan


class _Plan:
    """What the flow takes of a pattern: every row `full` times, and rows worth `rest` words once more.

    Those are, for each (most, stop) of `takes`, the rows of up to `most` words that begin before `stop`, and the one
    that begins at `extra`. `stops` and `last` hold the id and size of the rows there.
    """

    def __init__(self, length: int, sources: list[tuple[int, float, float]], repeats: int):
        self.length, self.sources = length, sources
        self.ends = np.cumsum([x[2] for x in sources]).tolist()
        words = self.ends[-1] if sources else 0.0
        self.full = min(repeats, int(words / length + 1e-9)) if length else 0
        self.rest = max(0.0, words - self.full * length) if self.full < repeats else 0.0
        self.takes: list[tuple[float, float]] = []
        self.stops: list[tuple[int | None, int] | None] = []
        self.extra, self.last = -1, None
        self.gap = self.rest

    def take(self, most: float, stop: float, words: float, row: tuple[int | None, int] | None = None) -> None:
        self.takes.append((most, stop))
        self.stops.append(row)
        self.gap -= words

    def again(self, at: int, size: int) -> bool:
        return size > 0 and (at == self.extra or any(size <= most and at < stop for most, stop in self.takes))


def _top_up(lined: DataFrame, starts: dict, plan: dict[tuple, _Plan]) -> None:
    """Fill each plan's rest until what is left is less than any row not taken, then take the nearest if that is nearer.

    The line is cut first where a row does not fit. Then rows of up to half of what is left are taken along the line,
    as far as they fit: that halves what is left, or takes all of them. In the latter case one more row fits at most,
    and the first such row is taken. So there are as many rounds as halvings, however long the row at the cut is.
    A round brings one row for each pattern, and one for each part, to the driver.
    """
    spark = lined.sparkSession

    def found(judge, kind: str, *with_) -> DataFrame:
        shared = spark.sparkContext.broadcast((starts, plan, *with_))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, plan, *with_ = shared.value
            for batch in batches:
                out = []
                for doc_id, size, members, part, before in zip(*(c.to_pylist() for c in batch.columns)):
                    key = tuple(members)
                    p = plan[key]
                    at = starts[part, key] + before
                    if size and p.gap > 0 and not p.again(at, size) and (row := judge(p, key, at, size, doc_id, part, *with_)):
                        out.append((members, *row))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.list_(pa.string()), *kinds])], names=names)

        names, types = zip(*(x.split() for x in kind.split(", ")))
        kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[t] for t in types[1:]]
        return map_arrow(lined, work, kind)

    limits = {key: (math.inf, False) for key, p in plan.items() if p.rest > 0}
    while limits:
        sums: dict[tuple, list] = {key: [] for key in limits}
        for r in found(_fits, "members array<string>, part int, size long", limits).groupBy("members", "part").agg(F.sum("size").alias("size")).collect():
            sums[tuple(r.members)].append((r.part, r.size))
        ahead: dict[tuple, tuple[int, float]] = {}  # the part in which the rows cease to fit, and what is left there
        for key, parts in sums.items():
            run = 0
            for part, size in sorted(parts):
                if run + size > plan[key].gap + 1e-6:
                    ahead[key] = part, plan[key].gap - run
                    break
                run += size
        if ahead:
            rows = found(_fits_in_part, "members array<string>, room double, at long, size long, doc_id long", limits, ahead)
            run = rows.withColumn("run", F.sum("size").over(Window.partitionBy("members").orderBy("at")))
            first = run.where("run > room + 1e-6").groupBy("members").agg(F.min(F.struct("at", "doc_id", "size", "run")).alias("b")).collect()
            for r in first:
                p, (_, room) = plan[tuple(r.members)], ahead[tuple(r.members)]
                p.take(limits[tuple(r.members)][0], r.b["at"], p.gap - room + r.b["run"] - r.b["size"], (r.b["doc_id"], r.b["size"]))
        for key in limits.keys() - ahead.keys():
            plan[key].take(limits[key][0], math.inf, sum(size for _, size in sums[key]))
        limits = {key: (p.gap, True) if key not in ahead or p.gap < 2 else (p.gap / 2, False) for key, (most, last) in limits.items() if (p := plan[key]).gap >= 1 and not last and (key in ahead or most < math.inf)}
    nearest = found(_nearest, "members array<string>, miss double, at long, size long, doc_id long")
    for r in nearest.groupBy("members").agg(F.min(F.struct("miss", "at", "doc_id", "size")).alias("b")).collect():
        p = plan[tuple(r.members)]
        p.extra, p.last = r.b["at"], (r.b["doc_id"], r.b["size"])
        p.gap -= r.b["size"]


def _fits(p: _Plan, key: tuple, at: int, size: int, doc_id: int | None, part: int, limits: dict) -> tuple | None:
    return (part, size) if key in limits and size <= limits[key][0] else None


def _fits_in_part(p: _Plan, key: tuple, at: int, size: int, doc_id: int | None, part: int, limits: dict, ahead: dict) -> tuple | None:
    return (ahead[key][1], at, size, doc_id) if key in ahead and part == ahead[key][0] and size <= limits[key][0] else None


def _nearest(p: _Plan, key: tuple, at: int, size: int, doc_id: int | None, part: int) -> tuple | None:
    return (abs(p.gap - size), at, size, doc_id) if abs(p.gap - size) < p.gap else None


def mix_documents(docs: DataFrame, id_col: str, size: Column, members: Column, weights: Sequence[float] = (5, 2, 1), seed: int = 42, repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns kept.

    A pattern's rows have two numbers of copies. The larger one holds for rows up to some size before some row of its
    seeded order, for a few such pairs, and for a single row; these (some tens a pattern) decide all, so where they are
    few the documents themselves are not shuffled. Rows that agree in id and size are taken alike. Null sizes are 0;
    extra columns are kept; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), members.alias("members"))
    # the size is counted once a row: what a Generate makes is never put in place of its name
    counted = f"__size_{len(docs.columns)}"
    sized, size = docs.select("*", F.explode(F.array(size)).alias(counted)), F.coalesce(F.col(counted), F.lit(0))
    spot = lambda doc_id, n: F.struct(F.xxhash64(F.lit(seed), doc_id, n).alias("place"), doc_id.isNotNull().alias("some"), doc_id.alias("doc_id"), n.alias("size"))
    _, _, plan = _planned(rows, "doc_id", "size", "members", weights, seed, repeats)
    rules = [(list(key), p.full, [(float(most), row) for (most, _), row in zip(p.takes, p.stops)], p.last) for key, p in plan.items()]
    row = "struct<doc_id: long, size: long>"
    rule = spark.createDataFrame(rules, f"__members array<string>, __full int, takes array<struct<most: double, stop: {row}>>, last {row}")
    at = lambda r: F.when(r.isNotNull(), spot(r["doc_id"], r["size"]))
    takes = F.transform("takes", lambda t: F.struct(t["most"].alias("most"), at(t["stop"]).alias("stop")))
    rule = rule.select("__members", "__full", takes.alias("__takes"), at(F.col("last")).alias("__last"))
    if len(plan) <= BROADCAST_PATTERNS:
        rule = F.broadcast(rule)
    own = spot(F.col(id_col).cast("long"), size)
    joined = sized.alias("d").join(rule, F.array_sort(F.array_distinct(members)) == F.col("__members")).withColumn("__own", own)
    within = F.exists("__takes", lambda t: (F.col("__own.size") <= t["most"]) & (t["stop"].isNull() | (F.col("__own") < t["stop"])))
    larger = within | (F.col("__last").isNotNull() & F.col("__own").eqNullSafe(F.col("__last")))
    copies = F.when(F.col("__own.size") > 0, F.col("__full") + larger.cast("int")).otherwise(F.lit(0)).cast("int")
    return joined.select("d.*", F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")).select(*(f"`{c}`" for c in docs.columns))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the pattern's earlier rows in this part."""
    last, run = None, 0
    for batch in batches:
        before = []
        for size, members in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if members != last:
                last, run = members, 0
            before.append(run)
            run += size
        doc_id, size, members, _, part = batch.columns
        yield pa.RecordBatch.from_arrays([doc_id, size, members, part, pa.array(before, pa.int64())], names=["doc_id", "size", "members", "part", "before"])


def _choose(batches: Iterator[pa.RecordBatch], starts: dict, plan: dict[tuple, _Plan]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "size", "members", "source_size", "target", "copies", "routed"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64())]
    for batch in batches:
        out = []
        for doc_id, size, members, part, before in zip(*(c.to_pylist() for c in batch.columns)):
            key = tuple(members)
            p = plan[key]
            routed = [0] * len(p.sources)
            at = starts[part, key] + before
            copies = p.full + p.again(at, size) if size else 0
            for r in range(copies):  # the copy goes where most of it lies
                routed[min(bisect_right(p.ends, r * p.length + at + size / 2), len(routed) - 1)] += 1
            out.append((doc_id, size, members, [x[0] for x in p.sources], [x[1] for x in p.sources], copies, routed))
        columns = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
