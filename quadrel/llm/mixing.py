"""Operator 9. Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their sources), which gives a
small network: a pattern offers its words once for each pass over it, each further pass at a higher cost (convex), and
each source asks for its target. The cheapest flow (shortest augmenting paths) says how many words of a pattern go to which
source; the driver sees one row for each pattern and source. Documents are then chosen along a seeded order of each pattern:
copy e of a document is taken if its middle lies within the words that the flow routes, so a pattern's total is right to
half a document. Middles rise along the order, so all that a pattern's copies need is the last place that is taken. It is found
by sums over hash cells of a pattern (as many as its documents ask for), then by ordering the one cell in which it lies; the
documents themselves are not sorted, shuffled or joined with anything but these places.

The driver holds a number for each membership pattern and source, and solves each connected part of their network by itself. Places
are broadcast up to `BROADCAST_ROWS` patterns and joined beyond.

Null texts have size 0 and are never taken. A null source is a source of its own, last in order. Documents with equal ids are ordered by size and
text; rows equal in all three share a place and are taken together, by the middle of them all. A null doc_id is placed by its text.
An empty table gives an empty result. Of other columns those named in `keep` are carried along; where a column has the name of a result, the result replaces it.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
HASH_BITS = 60
#: Documents that a cell of the seeded order holds on average, and patterns up to which their places are broadcast.
CELL_ROWS, BROADCAST_ROWS = 2_000, 200_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets in words: `share` of all words by weight, none above `most` times its source's size; what is over goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
        left = max(left, 0.0)
    return out


def parts(patterns: Iterable[tuple]) -> list[list[tuple]]:
    """Patterns that share sources, directly or through others, together."""
    above: dict = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for p in (patterns := sorted(patterns, key=str)):
        for s in p[1:]:
            above[top(s)] = top(p[0])
    out: dict = {}
    for p in patterns:
        out.setdefault(top(p[0]) if p else (), []).append(p)
    return list(out.values())


def cheapest_flow(offers: dict[tuple, float], asks: dict[str | None, float], passes: int) -> dict[tuple, dict[str | None, float]]:
    """Words from each pattern (a tuple of sources) to each source. Pass e over a pattern costs e a word."""
    nodes = ["from", *((("p", p)) for p in sorted(offers, key=str)), *(("s", s) for s in sorted(asks, key=str)), "to"]
    at = {n: i for i, n in enumerate(nodes)}
    out: list[list[int]] = [[] for _ in nodes]
    edges: list[list] = []  # to, room, cost

    def edge(a, b, room: float, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            out[at[x]].append(len(edges))
            edges.append([at[y], r, c])

    for p in sorted(offers, key=str):
        for e in range(passes):
            edge("from", ("p", p), offers[p], e)
        for s in p:
            edge(("p", p), ("s", s), float("inf"), 0)
    for s in sorted(asks, key=str):
        edge(("s", s), "to", asks[s], 0)
    while True:
        cost, via, todo, queued = [None] * len(nodes), [None] * len(nodes), deque([0]), {0}
        cost[0] = 0
        while todo:
            x = todo.popleft()
            queued.discard(x)
            for i in out[x]:
                y, room, c = edges[i]
                if room > 1e-6 and (cost[y] is None or cost[x] + c < cost[y]):
                    cost[y], via[y] = cost[x] + c, i
                    if y not in queued:
                        todo.append(y)
                        queued.add(y)
        if cost[-1] is None:
            break
        path, y = [], len(nodes) - 1
        while y:
            path.append(via[y])
            y = edges[via[y] ^ 1][0]
        room = min(edges[i][1] for i in path)
        for i in path:
            edges[i][1] -= room
            edges[i ^ 1][1] += room
    flow: dict[tuple, dict] = {p: {} for p in offers}
    for p in offers:
        for i in out[at["p", p]]:
            y = nodes[edges[i][0]]
            if i % 2 == 0 and y != "to" and edges[i ^ 1][1] > 1e-6:
                flow[p][y[1]] = edges[i ^ 1][1]
    return flow


def with_sizes(docs: DataFrame, members: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size in words, members (the sorted distinct sources: of a column that lists them, or the document's one source), its place `at` in the seeded order, and the columns in `keep`."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    own = F.array_sort(F.array_distinct(F.col(members))) if members else F.array(F.col("source").cast("string"))
    return docs.select(*(F.col(c).alias(f"_{c}") for c in keep), F.col("doc_id").cast("long").alias("doc_id"), size, own.alias("members"), F.xxhash64("text").alias("text"))


def _place(seed: str) -> Column:
    """The seeded order, total but for equal rows."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text").cast("string")))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name)), 1, HASH_BITS // 4), 16, 10).cast("long")
    return F.struct(hashed.alias("h"), F.col("doc_id"), F.col("size"), F.col("text"))


def plan(sized: DataFrame, asks: dict[str | None, float] | None = None, seed: str = "mix", passes: int = 2) -> tuple[DataFrame, int]:
    """(m, last): for each pattern the last places that each pass takes, null where it takes none; and the number of patterns. asks: a target for each source, targets() of the sizes if None."""
    spark = sized.sparkSession
    sums = {tuple(x.members): (int(x.words), int(x.n)) for x in sized.groupBy("members").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()}
    if asks is None:
        alone: dict[str | None, int] = {}
        for p, (n, _) in sums.items():
            for s in p:
                alone[s] = alone.get(s, 0) + n
        asks = targets(alone)
    flow: dict[tuple, dict] = {}
    for part in parts(sums):
        flow |= cheapest_flow({p: float(sums[p][0]) for p in part}, {s: asks[s] for s in {s for p in part for s in p}}, passes)
    bits = max(0, math.ceil(math.log2(max([1, *(n for _, n in sums.values())]) / CELL_ROWS)))
    asked = [(list(p), e, sum(flow[p].values()) - e * sums[p][0]) for p in sums for e in range(passes)]
    wanted = spark.createDataFrame(asked, "m array<string>, pass int, upto double").filter("upto > 0")
    cell = F.shiftright(F.col("at.h"), HASH_BITS - bits) if bits else F.lit(0).cast("long")
    placed = sized.filter("size > 0").select("members", "size", _place(seed).alias("at")).withColumn("cell", cell)
    cells = placed.groupBy("members", "cell").agg(F.sum("size").alias("words"))  # 2 ** bits rows for each pattern at most
    cells = cells.withColumn("base", F.sum("words").over(Window.partitionBy("members").orderBy("cell")) - F.col("words"))
    # The last place lies in the last cell that begins within the words asked for, or is the last of the cell before it.
    last = cells.join(F.broadcast(wanted) if len(asked) <= BROADCAST_ROWS else wanted, F.col("members") == F.col("m")).filter("base <= upto").groupBy("m", "pass", "upto").agg(F.max_by(F.struct("cell", "base"), "cell").alias("c"))
    before = last.filter("c.cell > 0").select("m", "pass", "upto", (F.col("c.cell")).alias("under")).join(cells, (F.col("m") == F.col("members")) & (F.col("cell") < F.col("under"))).groupBy("m", "pass", "upto").agg(F.max_by(F.struct("cell", "base"), "cell").alias("c"))
    edge = last.unionByName(before).select("m", "pass", "upto", "c.cell", "c.base")
    edge = F.broadcast(edge) if len(asked) <= BROADCAST_ROWS else edge
    order = Window.partitionBy("m", "pass", "cell").orderBy("at")
    inside = placed.join(edge.withColumnRenamed("cell", "_cell"), (F.col("members") == F.col("m")) & (F.col("cell") == F.col("_cell"))).withColumns(
        {"upto_here": F.sum("size").over(order), "equal": F.sum("size").over(Window.partitionBy("m", "pass", "cell", "at"))}
    )
    ends = inside.filter(F.col("base") + F.col("upto_here") - F.col("equal") / 2 <= F.col("upto")).groupBy("m", "pass").agg(F.max("at").alias("at"))
    per = ends.groupBy("m").agg(F.collect_list("at").alias("last"))
    return per, len(sums)


def mix(sized: DataFrame, asks: dict[str | None, float] | None = None, seed: str = "mix", passes: int = 2) -> DataFrame:
    """sized (from with_sizes) with copies and taken: how often the mix takes the document, and its words times that."""
    last, patterns = plan(sized, asks, seed, passes)
    last = stored(last, "places")
    joined = sized.join(F.broadcast(last) if patterns <= BROADCAST_ROWS else last, F.col("members") == F.col("m"), "left")
    taken = F.when(F.col("size") > 0, F.size(F.filter(F.col("last"), lambda x: x >= _place(seed)))).otherwise(0)
    return joined.withColumn("copies", F.greatest(F.lit(0), F.coalesce(taken, F.lit(0)))).withColumn("taken", F.col("copies") * F.col("size")).drop("m", "last")


def mixed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each document with a single source: the columns in `keep`, then doc_id, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    sized = with_sizes(docs, keep=keep)
    narrow = stored(sized.select("doc_id", "members", "size", "text"), "sizes")
    sizes = {x.members[0]: int(x.n) for x in narrow.groupBy("members").agg(F.sum("size").alias("n")).collect()}
    asks = targets(sizes)
    table = spark.createDataFrame([([s], sizes[s], asks[s]) for s in sizes], "of array<string>, source_size long, target double")
    last, patterns = plan(narrow, asks)
    ends = table.join(last, F.col("of") == F.col("m"), "left").select(F.col("of").alias("m"), "source_size", "target", "last")
    ends = stored(ends, "places")
    out = (sized if keep else narrow).join(F.broadcast(ends) if patterns <= BROADCAST_ROWS else ends, F.col("members") == F.col("m"))
    taken = F.when(F.col("size") > 0, F.size(F.filter(F.col("last"), lambda x: x >= _place("mix")))).otherwise(0)
    out = out.withColumn("copies", F.greatest(F.lit(0), F.coalesce(taken, F.lit(0)))).withColumn("taken", F.col("copies") * F.col("size"))
    names = {"doc_id", "size", "source_size", "target", "copies", "taken"}
    return out.select(*(F.col(f"_{c}").alias(c) for c in keep if c.lower() not in names), "doc_id", "size", "source_size", "target", "copies", "taken")
