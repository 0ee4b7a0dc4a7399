"""A prefix trie of conversations, rolled up by centroid decomposition.

1. Turns get their places in ranges of (conversation, turn), and running sums of
   two 64-bit hashes of (place, role, text) name each prefix, so a conversation of
   any length is spread over tasks. Equal prefixes are one node; its smallest member
   and its depth are the node's id.
2. A node weighs its members, so the weight of its whole subtree is known from its
   members' lengths alone. The centroid of a component is the deepest node that
   holds more than half of its weight; the nodes that do are the path from there to
   the component's top. What lies at or below the centroid is added up and goes to
   every node of that path; then the centroid leaves, its children become tops, and
   what is left above loses the centroid's weight. Each part has half the weight at
   most, so there are as many rounds as the weight has binary digits.
3. Components above ``LARGEST`` are split by joins: whether a node lies below a
   centroid is read off the path of the node's smallest member. Smaller ones are
   dealt out and split on inside tasks, many side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import releasing
from .skew import look_up
from .storage import discard, written

LARGEST, _NODES, _IDS = 1 << 13, 1 << 18, 1 << 14


def running(rows: DataFrame, group: str, order: Sequence[str | Column], sums: Sequence[str], name: str) -> DataFrame:
    """``rows`` of longs with ``name``, their place in their ``group`` from 1, and running sums (modulo 2**64) of ``sums`` in place of those.

    Rows are sorted in ranges, so a group of any size is spread over tasks; groups
    that cross a border carry on from a table of one row for each range.
    """
    columns = rows.columns
    types = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", {name} long, _part long"

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(len(sums) + 1, np.uint64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = batch.column(group).to_numpy()
            new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            out, ends = {}, []
            for k, c in enumerate([None, *sums]):
                own = np.ones(len(key), np.uint64) if c is None else batch.column(c).to_numpy().view(np.uint64)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)))
                value = total[1:] - total[begin]
                value[np.cumsum(new) == 0] += held[k]  # rows that go on with the batch before's group
                out[c], _ = value.view(np.int64), ends.append(value[-1])
            last, held = key[-1], np.array(ends, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(out[c]) if c in sums else batch.column(c) for c in columns), pa.array(out[None]), batch.column("_part")], [*columns, name, "_part"]
            )

    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id().cast("long"))
    local = written(sorted_.mapInArrow(releasing(carry), types), "trie_runs")
    ends = local.groupBy(group, "_part").agg(F.max_by(F.struct(name, *sums), name).alias("e"))
    several = ends.groupBy(group).agg(F.count("*").alias("n"), F.collect_list(F.struct("_part", "e")).alias("parts")).where("n > 1")  # at most one group more a border
    offsets: list[tuple] = []
    for r in several.collect():
        total = np.zeros(len(sums) + 1, np.uint64)
        for p in sorted(r.parts, key=lambda p: p["_part"]):
            offsets.append((r[group], p["_part"], *total.view(np.int64).tolist()))
            total = total + np.array(list(p["e"]), np.int64).view(np.uint64)
    if not offsets:
        return local.drop("_part")
    names = [f"_{c}" for c in (name, *sums)]
    table = local.sparkSession.createDataFrame(offsets, f"{group} long, _part long, " + ", ".join(f"{c} long" for c in names))
    met = local.join(F.broadcast(table), [group, "_part"], "left")  # two rows a border at most
    plus = lambda c: wrapping_add(F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
    return met.select(*(plus(c) if c in sums else F.col(c) for c in columns), plus(name))


def wrapping_add(a: Column, b: Column) -> Column:
    """The sum modulo 2**64, from halves, as plain addition may raise an overflow."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def wrapping_minus(a: Column, b: Column) -> Column:
    return wrapping_add(wrapping_add(a, F.bitwise_not(b)), F.lit(1).cast("long"))


def rebuilt(conversations: DataFrame, near: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Rows (c, pos, k1, k2, q1, q2, size) of the rebuilt conversations: the hashes of the prefix and of the one before, UTF-8 bytes of the text; and (c, length)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    c = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(
        c.alias("c"), F.col("turn"), text("role").alias("role"), F.xxhash64(text("role"), text("text")).alias("g1"), F.xxhash64(F.lit(1), F.octet_length(text("text")), text("text"), text("role")).alias("g2"),
        F.octet_length(text("text")).cast("long").alias("size"),
    )
    order = ["c", F.col("turn").asc_nulls_first(), "role", "g1", "g2"]
    own = running(turns, "c", order, [], "i").select("c", "i", "g1", "g2", "size")
    own = written(own, "trie_turns")
    lengths = own.groupBy("c").agg(F.max("i").alias("n"))
    crc = F.crc32(F.col("c").cast("string")) % heads
    convs = lengths.select("c", "n", crc.alias("h"), (F.col("c") - F.col("c") % near).alias("b"))
    first = own.where(F.col("i") < heads).groupBy(F.col("c").alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "g1", "g2", "size"))).alias("first"))  # heads - 1 turns at most
    met = convs.join(first, "b", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), 1, F.col("h").cast("int")))
    met = written(met.select("c", "h", F.size("first").cast("long").alias("m"), "first", (F.size("first") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie_convs")
    taken = met.select("c", F.explode("first").alias("t")).select("c", F.col("t.i").alias("pos"), "t.g1", "t.g2", "t.size")
    later = look_up(own, met.select("c", "h", "m"), "c").where("i > h").select("c", (F.col("m") + F.col("i") - F.col("h")).alias("pos"), "g1", "g2", "size")
    placed = taken.unionByName(later).select("c", "pos", F.xxhash64("pos", "g1", "g2").alias("e1"), F.xxhash64("g2", "pos", "g1").alias("e2"), "size")
    hashed = placed.select("*", F.col("e1").alias("k1"), F.col("e2").alias("k2"))
    chained = running(hashed, "c", ["c", "pos"], ["k1", "k2"], "_place")
    rows = written(chained.select("c", "pos", "k1", "k2", wrapping_minus(F.col("k1"), F.col("e1")).alias("q1"), wrapping_minus(F.col("k2"), F.col("e2")).alias("q2"), "size"), "trie_rows")
    return rows, met.select("c", "length")


def split_inside(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a row a node) over each node's subtree, by centroid decomposition of a forest.

    parent: place of each node's parent, or -1; weight: of each node's subtree, its
    own part of it positive.
    """
    n = len(parent)
    up, weight = parent.copy(), weight.copy()
    total, there = np.zeros_like(values), np.ones(n, bool)
    places = np.arange(n)
    while there.any():
        top = np.where(up >= 0, up, places)
        while (further := top[top]) is not top and (further != top).any():
            top = further
        live = np.flatnonzero(there)
        path = live[2 * weight[live] > weight[top[live]]]
        order = path[np.lexsort((weight[path], top[path]))]
        centroid = order[np.concatenate(([True], top[order[1:]] != top[order[:-1]]))]  # the lightest of each path
        of = np.full(n, -1)
        of[top[centroid]] = centroid  # by top
        cut = np.zeros(n, bool)
        cut[centroid] = True
        below = live[(up[live] >= 0) & cut[np.maximum(up[live], 0)]]  # the centroids' children: tops from now on
        holder = up[below]
        up[below] = -1
        inner = np.where(up >= 0, up, places)
        while (inner[inner] != inner).any():
            inner = inner[inner]
        owner = np.full(n, -1)
        owner[below] = holder
        member = live[owner[inner[live]] >= 0]
        parts = values[centroid].copy()
        slot = np.full(n, -1)
        slot[centroid] = np.arange(len(centroid))
        np.add.at(parts, slot[owner[inner[member]]], values[member])  # totals of the components below
        mine = slot[of[top[path]]]
        total[path] += parts[mine]
        above = path[path != centroid[mine]]
        weight[above] -= weight[of[top[above]]]
        there[centroid] = False
        up[centroid] = -1
    return total


def _roll_up(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nodes (r, d, pr, tr, td, cw, leaf, saved, leaves, total, …) of small components with leaves and total increased by what lies below them."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        c = {x: pc.fill_null(rows[x], -1).to_numpy() for x in ("r", "d", "pr", "tr", "td", "cw", "leaf", "saved", "leaves", "total")}  # the root has no parent
        order = np.lexsort((c["r"], c["d"]))
        r, d = c["r"][order], c["d"][order]
        key = np.empty(len(r), [("d", np.int64), ("r", np.int64)])
        key["d"], key["r"] = d, r
        want = np.empty(len(r), key.dtype)
        want["d"], want["r"] = c["d"] - 1, c["pr"]
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        inside = ((c["d"] != c["td"]) | (c["r"] != c["tr"])) & (key[at] == want)
        parent = np.where(inside, order[at], -1)
        sums = split_inside(parent, c["cw"], np.stack([c["leaf"], c["saved"]], axis=1))
        for k, x in enumerate(("leaves", "total")):
            rows = rows.set_column(rows.schema.get_field_index(x), x, pa.array(c[x] + sums[:, k]))
        return rows.select(columns).combine_chunks().to_batches()[0]

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < _NODES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            tr, td = rows["tr"].to_numpy(), rows["td"].to_numpy()
            cuts = np.flatnonzero((tr[1:] != tr[:-1]) | (td[1:] != td[:-1])) + 1  # whole components
            if len(cuts):
                yield solved(rows.slice(0, cuts[-1]))
                rows = rows.slice(cuts[-1])
            held = rows.to_batches()
        if held:
            yield solved(pa.Table.from_batches(held).combine_chunks())

    kinds = ", ".join(f"{x} {t}" for x, t in parts.select(*columns).dtypes)
    return parts.repartition("tr", "td").sortWithinPartitions("tr", "td").mapInArrow(releasing(roll), kinds)


def roll_up(nodes: DataFrame, steps: DataFrame, largest: int = LARGEST) -> DataFrame:
    """``nodes`` (r, d, pr, cw, leaf, saved, …) with leaves and total: sums of leaf and saved over each subtree.

    r and d are a node's id, pr and d - 1 its parent's, cw its subtree's weight.
    steps: (r, d, here, next): for each node's smallest member r and each depth d on
    its way, the smallest member there and one deeper. ``largest``: weight of a
    component that a task may take whole.
    """
    plain = nodes.columns
    columns = [*plain, "leaves", "total"]
    zero = F.lit(0).cast("long")
    done: list[DataFrame] = []
    state = nodes.withColumns({"tr": F.lit(None).cast("long"), "td": zero, "leaves": zero, "total": zero})
    roots = nodes.where("pr IS NULL").select("r", "d").first()  # one: every conversation starts there
    if roots is None:
        return state.select(*columns)
    state = written(state.withColumns({"tr": F.lit(roots.r), "td": F.lit(roots.d)}), "trie_state")
    at = ["tr", "td"]
    while True:
        sizes = written(state.groupBy(*at).agg(F.max("cw").alias("whole")), "trie_sizes")
        big = sizes.where(F.col("whole") > largest)
        if big.isEmpty():
            done.append(_roll_up(state, columns))
            break
        split = written(look_up(state, big, at, "left"), "trie_split")
        done.append(_roll_up(split.where("whole IS NULL").drop("whole"), columns))
        parted = split.where("whole IS NOT NULL")
        heavy = 2 * F.col("cw") > F.col("whole")
        centroids = written(parted.where(heavy).groupBy(*at).agg(F.min(F.struct("cw", "r", "d")).alias("x")).select(*at, F.col("x.cw").alias("xw"), F.col("x.r").alias("xr"), F.col("x.d").alias("xd")), "trie_centroids")
        marked = written(look_up(parted, centroids, at), "trie_marked")
        way = steps.select("r", F.col("d").alias("xd"), "here", "next")
        seen = look_up(marked, way, ["r", "xd"], "left").withColumn("below", F.coalesce((F.col("d") > F.col("xd")) & (F.col("here") == F.col("xr")), F.lit(False)))
        seen = written(seen, "trie_seen")
        itself = (F.col("r") == F.col("xr")) & (F.col("d") == F.col("xd"))
        parts = written(seen.where(F.col("below") | itself).groupBy(*at).agg(F.sum("leaf").alias("pl"), F.sum("saved").alias("ps")), "trie_parts")
        raised = look_up(seen, parts, at).withColumns({
            "leaves": F.when(heavy, F.col("leaves") + F.col("pl")).otherwise(F.col("leaves")), "total": F.when(heavy, F.col("total") + F.col("ps")).otherwise(F.col("total")),
            "cw": F.when(heavy & ~itself, F.col("cw") - F.col("xw")).otherwise(F.col("cw")), "itself": itself,
            "tr": F.when(F.col("below"), F.col("next")).otherwise(F.col("tr")), "td": F.when(F.col("below"), F.col("xd") + 1).otherwise(F.col("td")),
        })
        raised = written(raised.select(*plain, *at, "leaves", "total", "itself"), "trie_raised")
        done.append(raised.where("itself").select(*columns))
        discard(centroids, marked, seen, parts, sizes)
        state = raised.where("NOT itself").drop("itself")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def joined_hashes(ends: DataFrame) -> DataFrame:
    """r, d and the SHA-256 of the comma-joined ids (c) of each node's rows (r, d, c), ascending.

    A hash has to be fed in order; so that no task gets a row for each id, runs of
    ids are joined where they lie in ranges, and the runs alone are dealt out by node.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            r, d, c = (batch.column(x).to_numpy() for x in ("r", "d", "c"))
            cuts = [0, *(np.flatnonzero((r[1:] != r[:-1]) | (d[1:] != d[:-1])) + 1).tolist(), len(r)]
            cuts = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in range(a, b, _IDS)] + [len(r)]
            text = [",".join(map(str, c[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[cuts[:-1]]) for x in (r, d, c)), pa.array(text)], ["r", "d", "c", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for r, d, ids in zip(batch.column("r").to_pylist(), batch.column("d").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if (r, d) == held:
                    state.update(b",")
                else:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = (r, d), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["r", "d", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([state.hexdigest()])], ["r", "d", "ends_sha256"])

    runs = ends.select("r", "d", "c").repartitionByRange("r", "d", "c").sortWithinPartitions("r", "d", "c").mapInArrow(chunks, "r long, d long, c long, ids string")
    return runs.repartition("r", "d").sortWithinPartitions("r", "d", "c").mapInArrow(digest, "r long, d long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, near: int = 5, heads: int = 9, largest: int = LARGEST) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations`` (conv_id, turn, role, text).

    A conversation's turns are ordered by turn, null first, then role and a hash of
    the text; null roles and texts are empty. Conversation c becomes the first h
    turns of conversation c - c % ``near`` (c % near has c's sign; fewer or none if it
    has not as many), then its own turns after its first h; h: crc32 of c in decimal,
    modulo ``heads``. A node is a distinct sequence of the first d turns, the root
    that of none. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves and saved_tokens (over the subtree: nodes without children;
    members but one times UTF-8 bytes of the last text), ends_sha256 (SHA-256 of the
    comma-joined ids of the members that end there).

    Rows with a null conv_id are left out, repeated rows are turns of their own.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows, lengths = rebuilt(conversations, near, heads)
    lengths = written(lengths, "trie_lengths")
    weighed = look_up(rows, lengths, "c")
    keys = ["pos", "k1", "k2"]
    grouped = weighed.groupBy(*keys).agg(F.min("c").alias("r"), F.count("*").alias("n_convs"), F.sum("length").alias("lengths"), F.first("size").alias("size"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    long = lambda x: x.cast("long")
    everyone = lengths.agg(F.min("c").alias("r"), F.count("*").alias("n_convs"), F.sum("length").alias("lengths")).where("r IS NOT NULL")
    root = everyone.select(*(long(F.lit(0)).alias(k) for k in keys), "r", "n_convs", "lengths", long(F.lit(0)).alias("size"), long(F.lit(None)).alias("q1"), long(F.lit(None)).alias("q2"))
    smallest = next((x.r for x in everyone.collect()), None)  # one row
    found = written(grouped.select(long(F.col("pos")).alias("pos"), "k1", "k2", "r", "n_convs", "lengths", "size", "q1", "q2").unionByName(root), "trie_nodes")
    names = written(found.select(*keys, "r"), "trie_names")
    above = names.select((F.col("pos") + 1).alias("pos"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("r").alias("pr"))
    hung = written(look_up(found, above, ["pos", "q1", "q2"], "left"), "trie_hung")
    children = hung.where("pr IS NOT NULL").groupBy(F.col("pr").alias("r"), (F.col("pos") - 1).alias("pos")).agg(F.count("*").alias("n_children"))
    nodes = hung.join(children, ["r", "pos"], "left").select(
        "r", F.col("pos").alias("d"), "pr", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.col("lengths") - F.col("n_convs") * (F.col("pos") - 1)).alias("cw"),
        F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    nodes = written(nodes, "trie_tree")
    # the smallest members on each conversation's way
    way = written(look_up(rows.select("c", *keys), names, keys).select("c", "pos", "r").unionByName(lengths.select("c", long(F.lit(0)).alias("pos"), long(F.lit(smallest)).alias("r"))), "trie_way")
    deeper = way.select("c", (F.col("pos") - 1).alias("pos"), F.col("r").alias("next"))
    steps = written(way.join(deeper, ["c", "pos"]).select(F.col("c").alias("r"), F.col("pos").alias("d"), F.col("r").alias("here"), "next"), "trie_steps")
    rolled = roll_up(nodes, steps, largest)
    ends = look_up(way, lengths, "c").where("pos = length").select("r", F.col("pos").alias("d"), "c")
    hashes = joined_hashes(ends)
    none = hashlib.sha256(b"").hexdigest()
    return rolled.join(hashes, ["r", "d"], "left").select(
        F.col("r").alias("conv_id"), F.col("d").alias("depth"), F.col("pr").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("total").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
