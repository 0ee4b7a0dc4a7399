"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). A flow network routes each pattern's words, once, twice and so on at
convex cost, to the quotas of its sources. Patterns that share no source, directly
or through others, are networks of their own and are solved in the tasks, so any
number of sources will do; only a network of patterns that all hang together is
solved in one task. Sources, patterns and targets stay tables: the driver sees sums.

Documents are then taken in seeded order until a pattern's flow is spent; running
sums go over 4096 hash buckets of a pattern first, then over 4096 parts of the one
bucket where the flow ends, and only then over the rows of one part, about a
source's 16 millionth, so no task holds a source.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
_BITS = 12  # of the draw that each of the two levels of buckets takes


def targets(sizes: DataFrame, total: int, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3) -> DataFrame:
    """source, size and target: shares of ``total`` by weight, none above ``limit`` times the source's size.

    Sources in code point order, null last, take the weights in turn. The excess of
    full sources is shared anew by weight; as a source is full if its limit for each
    unit of weight is below a common level, each round needs two sums.
    """
    placed = written(_weighted(sizes, weights).withColumn("most", F.col("size") * float(limit)), "mix_sources")
    full = F.lit(False)
    filled, open_weight = 0.0, placed.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    while True:
        share = F.lit(float(total) - filled) * F.col("weight") / F.lit(open_weight or 1.0)
        over = full | (F.col("most") < share)
        now = placed.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)).alias("filled"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if now.weight == open_weight:
            return placed.select("source", "size", F.when(full, F.col("most")).otherwise(share).alias("target"))
        full, filled, open_weight = over, now.filled, now.weight


def _weighted(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sizes`` (source, size) with ``weight``, by their place in code point order, null last."""
    order = F.col("source").isNull(), F.coalesce("source", F.lit(""))
    parts = written(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix_order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    turns = F.array(*(F.lit(float(w)) for w in weights))
    return parts.join(F.broadcast(starts), "_part").select("source", "size", turns[(place % len(weights)).cast("int")].alias("weight"))  # a row for each partition


def min_cost_flow(supply: list[list[tuple[int, int]]], edges: list[list[int]], quota: list[int]) -> list[int]:
    """Words sent by each pattern in a cheapest maximum flow.

    supply: of each pattern its (capacity, unit cost) steps, costs rising; edges:
    the sources of each pattern; quota: capacity of each source. Successive
    shortest paths with potentials.
    """
    source, sink = 0, 1 + len(supply) + len(quota)
    graph: list[list[list[int]]] = [[] for _ in range(sink + 1)]  # [to, capacity, cost, index of the reverse]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, steps in enumerate(supply):
        for capacity, cost in steps:
            arc(source, 1 + p, capacity, cost)
        for s in edges[p]:
            arc(1 + p, 1 + len(supply) + s, sum(c for c, _ in steps), 0)
    for s, q in enumerate(quota):
        arc(1 + len(supply) + s, sink, q, 0)
    potential = [0] * (sink + 1)
    while True:
        best: list[float] = [float("inf")] * (sink + 1)
        back: list[tuple[int, int] | None] = [None] * (sink + 1)
        best[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for i, (b, capacity, cost, _) in enumerate(graph[a]):
                reach = d + cost + potential[a] - potential[b]
                if capacity and reach < best[b]:
                    best[b], back[b] = reach, (a, i)
                    heapq.heappush(heap, (reach, b))
        if back[sink] is None:
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, best, strict=True)]
        path, b = [], sink
        while b != source:
            path.append(back[b])
            b = back[b][0]
        amount = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= amount
            graph[graph[a][i][0]][graph[a][i][3]][1] += amount
    return [sum(c for c, _ in steps) - sum(e[1] for e in graph[source] if e[0] == 1 + p) for p, steps in enumerate(supply)]


def mix(docs: DataFrame, sources: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), limit: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each row of ``docs`` (doc_id, text, source).

    sources: array of the sources that hold a row, by default ``array(source)``;
    equal ones count once, and a row with none (an empty or null array) is never
    taken, with source_size and target 0. size: words of the text
    (null or empty: 0). taken is size times copies, and copies is at most
    ``limit``; each source's taken words differ from its target by half a document
    at most where sources don't overlap and the target is below the limit.
    source_size and target are those of the first source in code point order. A
    null source is a source. Rows that agree in doc_id and text are taken one
    after the other. Extra columns are ignored; an empty table gives an empty
    result.
    """
    measured = _measured(docs, sources, seed)
    rows = written(measured("doc_id"), "mix_rows")
    taken = _taken(rows, rows, weights, limit)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def take(docs: DataFrame, sources: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), limit: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as ``mix`` takes them."""
    measured = _measured(docs, sources, seed)
    names = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = written(measured("doc_id", names.alias("row")), "mix_rows")  # with their texts, so that words are counted once
    taken = _taken(rows.drop("row"), rows, weights, limit)
    return taken.where("copies > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*(F.col(f"`{c}`") for c in docs.columns))


def _measured(docs: DataFrame, sources: Column | None, seed: int) -> Callable[..., DataFrame]:
    members = sources if sources is not None else F.array(F.col("source"))
    return lambda *columns: docs.select(
        *columns,
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.to_json(F.array_sort(F.array_distinct(members))), F.lit("[]")).alias("pattern"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
    )


def _flows(patterns: DataFrame, quotas: DataFrame, limit: int) -> DataFrame:
    """pattern, size and sent words of a cheapest maximum flow from ``patterns`` (pattern, size) to ``quotas`` (source, target)."""
    each = patterns.select("pattern", "size", F.explode(F.from_json("pattern", "array<string>")).alias("source"))
    arcs = written(each.join(quotas.select("source", "target"), each["source"].eqNullSafe(quotas["source"])).select("pattern", "size", each["source"], "target"), "mix_arcs")
    shared = arcs.groupBy("source").agg(F.count("*").alias("n"), F.min(F.xxhash64("pattern")).alias("first"))
    links = arcs.join(shared.where("n > 1"), arcs["source"].eqNullSafe(shared["source"])).select(F.xxhash64("pattern").alias("a"), F.col("first").alias("b"))
    label = components(links) if not links.isEmpty() else None  # sources that no two patterns share make no link
    keyed = arcs.withColumn("v", F.xxhash64("pattern"))
    net = F.col("v") if label is None else F.coalesce("label", "v")
    named = (keyed if label is None else keyed.join(label, "v", "left")).withColumn("net", net)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            cuts = [0, *((batch["net"].to_numpy()[1:] != batch["net"].to_numpy()[:-1]).nonzero()[0] + 1), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.iloc[a:b]
                if held and held[-1]["net"].iloc[0] != part["net"].iloc[0]:
                    yield _solved(pd.concat(held), limit)
                    held = []
                held.append(part)
        if held:
            yield _solved(pd.concat(held), limit)

    order = ["net", "pattern", F.col("source").isNull(), "source"]
    return named.select("net", "pattern", "size", "source", "target").repartition("net").sortWithinPartitions(*order).mapInPandas(solve, "pattern string, size long, sent long")


def _solved(arcs: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Words sent by each pattern of one network."""
    names = [None if pd.isna(s) else s for s in arcs["source"]]
    at = {s: i for i, s in enumerate(dict.fromkeys(names))}
    quota, edges, sizes = [0] * len(at), {}, {}
    for pattern, size, source, target in zip(arcs["pattern"], arcs["size"], names, arcs["target"], strict=True):
        quota[at[source]] = round(float(target))
        edges.setdefault(pattern, []).append(at[source])
        sizes[pattern] = int(size)
    sent = min_cost_flow([[(size, k * k) for k in range(limit)] for size in sizes.values()], list(edges.values()), quota)
    return pd.DataFrame({"pattern": list(sizes), "size": list(sizes.values()), "sent": sent})


def _taken(rows: DataFrame, whole_rows: DataFrame, weights: tuple[float, ...], limit: int) -> DataFrame:
    """``whole_rows`` with source_size, target and copies, as planned from ``rows``."""
    patterns = written(rows.groupBy("pattern").agg(F.sum("size").alias("size")), "mix_patterns")
    members = F.from_json("pattern", "array<string>")
    sizes = patterns.select(F.explode(members).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    total = patterns.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    quotas = written(targets(sizes, total, weights, limit), "mix_targets")
    flows = _flows(patterns, quotas, limit)
    held = flows.where("size > 0").select("pattern", F.expr("sent div size").alias("passes"), (F.col("sent") % F.col("size")).alias("rest"))
    first = patterns.select("pattern", (F.size(members) > 0).alias("some"), F.try_element_at(members, F.lit(1)).alias("source"))
    owned = first.join(quotas.withColumnRenamed("size", "source_size"), first["some"] & first["source"].eqNullSafe(quotas["source"]), "left")
    zero = lambda c, v=0: F.coalesce(c, F.lit(v))
    planned = written(
        owned.join(held, "pattern", "left").select("pattern", zero("source_size").alias("source_size"), zero("target", 0.0).alias("target"), zero("passes").alias("passes"), zero("rest").alias("rest")), "mix_plan"
    )
    coarse, fine = (F.shiftrightunsigned("draw", 64 - _BITS * level).cast("int") for level in (1, 2))
    # a row for each pattern in all that follows: Spark broadcasts them while they are small, and splits hot patterns beyond
    rests = planned.where("rest > 0").select("pattern", "rest", F.lit(0).cast("long").alias("before"))
    ends = written(_ends(rows.withColumn("bucket", coarse).join(rests, "pattern")).withColumnRenamed("end", "outer"), "mix_outer")
    inside = rows.withColumn("outer", coarse).withColumn("bucket", fine).join(ends, ["pattern", "outer"])
    ends = written(_ends(inside).drop("rest"), "mix_inner")
    known = whole_rows.withColumn("bucket", fine).join(planned, "pattern").join(ends, "pattern", "left")
    whole = known.where(~F.col("bucket").eqNullSafe(F.col("end"))).withColumn("extra", (F.col("bucket") < F.col("end")).cast("long"))
    running = Window.partitionBy("pattern").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = known.where(F.col("bucket") == F.col("end")).withColumn("extra", (F.col("before") + F.sum("size").over(running) - F.col("size") / 2 <= F.col("rest")).cast("long"))
    return whole.unionByName(last).withColumn("copies", F.col("passes") + F.coalesce("extra", F.lit(0)))


def _ends(drawn: DataFrame) -> DataFrame:
    """pattern, rest, end and before: of each pattern the bucket in which ``rest`` words end, and the words that precede it."""
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = drawn.groupBy("pattern", "rest", "before", "bucket").agg(F.sum("size").alias("words"))
    placed = sums.withColumn("before", F.col("before") + F.sum("words").over(upto) - F.col("words"))
    return placed.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("pattern", "rest", F.col("bucket").alias("end"), "before")
