"""Exact Jaccard join of word shingles with set-relation skipping.

1. Texts of equal sets are one class. Shingles are ordered by their count in a
   sketch of fixed size, rare ones first, the same for all sets; two linked sets
   share one of the first n - ceil(0.8 n) + 1 shingles of either, so only these are
   posted, each with its place. The sketch orders, no more: an error in it costs
   time, never a result.
2. Postings are dealt out by shingle; lists of one class end there.
3. In each list all sets first meet one pivot. Sets linked with it are one
   component, and need no comparison among themselves. Those outside of it are then
   compared with all others of another component.
4. Skipping by place: of two sets that first meet in this list at places p and q, no
   more than n - p and m - q shingles can be shared. A list's entries stand in
   blocks by what they have left; blocks with too little are skipped whole.
5. Skipping by parity: each set has a bit for each of some cells, whether it has an odd
   number of shingles there. Two sets differ in at least as many shingles as their
   parities differ in cells; pairs that differ in too many are passed over.
6. Skipping by answers: sets of one component are near each other. A set's shared
   sizes with a leader of the component bound those with the component's others by
   the differences of these from the leader; where the bound isn't enough, the size
   follows from the differences alone, without comparing the sets.

Links are decided on full sets of 64-bit hashes of whole shingles; none is lost, and
no list, block or number of partners is capped. Blocks are bounded in shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import releasing
from .near_dedup import _sets, by_group, digests, shared_sizes, shingle_sets
from .skew import look_up
from .storage import discard, written
from .words import mix

CELLS, MASS, BLOCK, MOST_CELLS = 1 << 21, 1 << 20, 512, 1 << 14
_CHUNKS, _SEEN, _SALTS, _SKIP = 64, 1 << 20, 64, 64


def least_shared(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that linked sets of ``n`` and ``m`` share at least."""
    return -((-percent * (n + m)) // (100 + percent))


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> np.uint64(43)).astype(np.int64)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of shingles in ``CELLS`` hash cells over all texts; 8 MB at any size."""
    wide = CELLS // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column("text"), width):
                np.add.at(total, _cell(s), 1)
        if total.any():
            parts = np.minimum(total, (1 << 32) - 1).astype(np.uint32).reshape(_CHUNKS, wide)
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts])], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        packed = [np.minimum(s, (1 << 24) - 1).astype(np.uint32).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])

    kind = "chunk int, counts binary"
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism  # each sends one sketch
    parts = docs.select("text").coalesce(tasks).mapInArrow(releasing(count), kind).repartition(_CHUNKS, "chunk").mapInArrow(add, kind).collect()  # 64 rows of 128 kB
    out = np.zeros(CELLS, np.uint32)
    for r in parts:
        out[r.chunk * wide : (r.chunk + 1) * wide] = np.frombuffer(r.counts, np.uint32)
    return out


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set in the order of all sets, as many as may be the first that it shares with a linked one."""
    most = len(shingles) - -((-percent * len(shingles)) // 100) + 1
    order = (counts[_cell(shingles)].astype(np.uint64) << np.uint64(40)) | (shingles >> np.uint64(24))
    return shingles[np.argsort(order, kind="stable")[:most]]


def postings(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key, one, n and at of all shingles in the prefixes of sets; one: a hash of the set, n its size, at the place.

    Only keys that two sets share come, and hot ones (of cells with more than a
    thousandth of all shingles), which are salted.
    """
    counts = sketch(docs, width)
    hot = counts > max(1000, int(counts.sum(dtype=np.int64)) // 1000)  # fewer than 1000 cells
    shared = docs.sparkSession.sparkContext.broadcast((counts, hot))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hot = shared.value
        seen: set[int] = set()  # sets that this task has posted
        for batch in batches:
            held: list[tuple[np.ndarray, int, int]] = []

            def out() -> pa.RecordBatch:
                sizes = [len(k) for k, _, _ in held]
                keys = np.concatenate([k for k, _, _ in held])
                one, n = (np.repeat(np.array([h[x] for h in held], np.int64), sizes) for x in (1, 2))
                at = np.concatenate([np.arange(s) for s in sizes])
                salt = np.where(hot[_cell(keys)], mix(one) % np.uint64(_SALTS), -1 & 0xFF).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(salt), pa.array(one), pa.array(n << 32 | at)], ["key", "salt", "one", "place"])

            total = 0
            for s in shingle_sets(batch.column("text"), width):
                if len(s) == 0:
                    continue
                one = int(digests([s])[1][0])
                if one in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(one)
                held.append((prefix(s, counts, percent), one, len(s)))
                total += len(held[-1][0])
                if total > 1 << 16:
                    yield out()
                    held, total = [], 0
            if held:
                yield out()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, not yet out
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            if last is not None:
                rows = pa.concat_tables([last, rows])
            key, one, salt = (rows[c].to_numpy() for c in ("key", "one", "salt"))
            again = np.concatenate(([False], (key[1:] == key[:-1]) & (one[1:] == one[:-1])))
            rows, key, salt = rows.filter(pa.array(~again)), key[~again], salt[~again]
            before = np.concatenate(([last is not None and self_met], key[1:] == key[:-1])) if len(key) else np.zeros(0, bool)
            after = np.concatenate((key[1:] == key[:-1], [False]))
            keep = before | after | (salt < _SALTS)
            self_met = bool(before[-1])
            last = rows.slice(len(key) - 1)
            out = rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
            if out.num_rows:
                yield out.combine_chunks().to_batches()[0]
        if last is not None and (self_met or last["salt"][0].as_py() < _SALTS):
            yield last.combine_chunks().to_batches()[0]

    kind = "key long, salt long, one long, place long"
    dealt = docs.select("text").mapInArrow(releasing(post), kind).repartition("key", "salt").sortWithinPartitions("key", "salt", "one")
    return dealt.mapInArrow(releasing(several), kind).select("key", "one", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("at"))


def _could(n: Column, at: Column, m: Column, of: Column, percent: int) -> Column:
    """Whether sets of sizes n and m that first meet at these places may be linked."""
    return F.least(n - at, m - of) * (100 + percent) >= percent * (n + m)


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each of about as many cells as the set has shingles: whether it has an odd number there."""
    cells = int(np.clip(1 << int(len(shingles)).bit_length(), 64, MOST_CELLS))
    return np.packbits((np.bincount((mix(shingles ^ np.uint64(0xA5A5)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(bool)).tobytes()


class Parities:
    """The parities of some sets, for bounds on how many shingles pairs of them differ in."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        self.bits = [np.frombuffer(b.as_buffer(), np.uint8) for b in column]
        self.size = np.array([len(b) for b in self.bits])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _folded(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All parities of at least ``size`` bytes brought down to it, which halving by exclusive or does exactly, and their rows."""
        if size not in self.at:
            use = np.flatnonzero(self.size >= size)
            row = np.zeros(len(self.size), np.int64)
            row[use] = np.arange(len(use))
            self.at[size] = np.stack([np.bitwise_xor.reduce(_low(self.bits[k], size), axis=0) for k in use]).view(np.uint64), row
        return self.at[size]

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """At least so many shingles are in one set of each pair only."""
        out = np.zeros(len(x), np.int64)
        least = np.minimum(self.size[x], self.size[y])
        for size in np.unique(least).tolist():
            table, row = self._folded(size)
            for some in np.array_split(np.flatnonzero(least == size), max(1, int((least == size).sum()) * size >> 22)):
                out[some] = np.bitwise_count(table[row[x[some]]] ^ table[row[y[some]]]).sum(axis=1, dtype=np.int64)
        return out


def _low(bits: np.ndarray, size: int) -> np.ndarray:
    """A parity cut into parts of ``size`` bytes that fold onto one another: cells that agree in their low bits."""
    return bits.reshape(-1, size)


def _differ_too_much(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    return n + m - differ < 2 * least_shared(n, m, percent)


def linked(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of labels (a, b) linked within blocks (gid, side, vid, label): a row of side 0 with one of side 1."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "gid"):
            side, label = rows["side"].to_numpy(), rows["label"].to_numpy()
            sets_ = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows["shingles"]]
            pairs = answers([(label[k], sets_[k]) for k in np.flatnonzero(side == 0)], [(label[k], sets_[k]) for k in np.flatnonzero(side == 1)], percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    rows = blocks.distinct().join(sets, "vid").repartition("gid").sortWithinPartitions("gid")
    return rows.select("gid", "side", "label", "shingles").mapInArrow(releasing(compare), "a long, b long").distinct()


def answers(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> set[tuple[int, int]]:
    """Pairs of different labels of which a set on the left and one on the right are linked.

    Of each label on the right the first set, its leader, is compared with all sets on
    the left; the sizes that the label's other sets share with those are bounded, and
    then derived, from their differences from the leader.
    """
    found: set[tuple[int, int]] = set()
    if not left or not right:
        return found
    names, sizes = np.array([a for a, _ in left]), np.array([len(s) for _, s in left])
    groups: dict[int, list[np.ndarray]] = {}
    for b, s in right:
        groups.setdefault(int(b), []).append(s)
    table = shared_sizes([members[0] for members in groups.values()], [s for _, s in left])
    for (b, members), shared in zip(groups.items(), table, strict=True):
        leader = members[0]
        met = shared >= least_shared(sizes, len(leader), percent)
        for s in members[1:]:
            open_ = np.flatnonzero((names != b) & ~np.isin(names, names[met]))
            if len(open_) == 0:
                break
            new, gone = np.setdiff1d(s, leader, assume_unique=True), np.setdiff1d(leader, s, assume_unique=True)
            need = least_shared(sizes[open_], len(s), percent)
            for k, least in zip(open_[shared[open_] + len(new) >= need], need[shared[open_] + len(new) >= need], strict=True):
                other = left[k][1]
                inside = lambda d: int((other[np.minimum(np.searchsorted(other, d), len(other) - 1)] == d).sum())  # noqa: B023, E731
                met[k] |= shared[k] + inside(new) - inside(gone) >= least
        found |= {(min(int(a), b), max(int(a), b)) for a in set(names[met].tolist()) if a != b}
    return found


def link_sets(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """v and label of all classes (vid, rep, one, two, n, parity) that are linked with others."""
    posted = written(postings(docs, width, percent), "join_postings")
    own = written(posted.select("key", "one", "at").join(classes.select("one", "vid", "n"), "one").select("key", "vid", "n", "at"), "join_places")
    lists = written(own.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("vid", "n", "at")).alias("pivot")).where("size > 1"), "join_lists")
    held = written(look_up(own, lists, "key").select("key", "vid", "n", "at", F.col("pivot.vid").alias("p"), F.col("pivot.n").alias("pn"), F.col("pivot.at").alias("pat")), "join_held")
    discard(posted, own, lists)
    stars = written(held.where((F.col("vid") != F.col("p")) & _could(F.col("n"), F.col("at"), F.col("pn"), F.col("pat"), percent)).groupBy("p", F.col("vid").alias("v")).agg(F.first("n").alias("n")), "join_stars")
    bits = classes.select("vid", "n", "parity")
    offered = written(stars.join(bits.select(F.col("vid").alias("v"), F.col("parity").alias("vb")), "v"), "join_offers")
    near = look_up(offered, bits.select(F.col("vid").alias("p"), F.col("n").alias("pn"), F.col("parity").alias("pb")), "p")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            both = Parities(pa.chunked_array([batch.column("pb"), batch.column("vb")]))
            far = _differ_too_much(batch.column("n").to_numpy(), batch.column("pn").to_numpy(), both.differ(np.arange(k), np.arange(k, 2 * k)), percent)
            yield batch.select(["p", "v", "n"]).filter(pa.array(~far))

    discard(stars)
    stars = written(near.select("p", "v", "n", "pn", "pb", "vb").mapInArrow(releasing(close), "p long, v long, n long"), "join_close")
    discard(offered)
    masses = written(stars.groupBy("p").agg(F.sum("n").alias("mass")), "join_masses")
    near = look_up(stars, masses, "p").withColumn("gid", F.xxhash64("p", F.pmod(F.xxhash64("v"), F.ceil(F.col("mass") / MASS))))
    near = written(near.select("gid", "p", "v"), "join_near")
    row = lambda side, vid: near.select("gid", F.lit(side).alias("side"), F.col(vid).alias("vid"), F.col(vid).alias("label"))
    blocks = row(0, "p").unionByName(row(1, "v"))
    first = written(linked(blocks, _sets(docs, blocks, classes, width), percent), "join_links")
    discard(stars, masses, near)
    labels = components(first)

    named = written(held.join(labels.select(F.col("v").alias("vid"), "label"), "vid", "left").withColumn("label", F.coalesce("label", "vid")), "join_named")
    pivots = labels.select(F.col("v").alias("p"), F.col("label").alias("plabel"))
    named = written(look_up(named, pivots, "p", "left").withColumn("plabel", F.coalesce("plabel", "p")).select("key", "vid", "n", "at", "label", "plabel"), "join_named")
    discard(held)
    outside = F.col("label") != F.col("plabel")
    sums = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    open_ = named.groupBy("key").agg(sums(F.lit(1), outside).alias("others"), sums(F.col("n"), outside).alias("omass"), F.sum("n").alias("mass"), F.count("*").alias("size")).where("others > 0")
    open_ = written(open_.withColumn("rows", F.ceil(F.greatest(F.col("others") / BLOCK, F.col("omass") / MASS))).withColumn("cols", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("mass") / MASS))), "join_open")
    part = written(look_up(named.select("key", "vid", "n", "at", "label", "plabel"), open_.select("key", "rows", "cols"), "key"), "join_part")
    discard(named)
    at = lambda n: F.pmod(F.xxhash64("vid"), n).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = part.where(outside).select("key", at(F.col("rows")).alias("i"), every(F.col("cols")).alias("j"), F.lit(0).alias("side"), "vid", "n", "at", "label")
    right = part.select("key", every(F.col("rows")).alias("i"), at(F.col("cols")).alias("j"), F.lit(1).alias("side"), "vid", "n", "at", "label")

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each block that have a partner which may be linked."""
        for rows in by_group(batches, "gid"):
            side, n, place, label = (rows[c].to_numpy() for c in ("side", "n", "at", "label"))
            rest, parities = n - place, Parities(rows["parity"])
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            two = two[np.argsort(-rest[two], kind="stable")]
            heads = rest[two][::_SKIP]  # the most that each block of entries has left
            marked = np.zeros(len(side), bool)
            for a in one:
                least = -((-percent * n[a]) // 100)
                if rest[a] < least:
                    continue
                some = two[: _SKIP * int(np.searchsorted(-heads, -least, "right"))]
                ok = (np.minimum(rest[some], rest[a]) >= least_shared(n[some], n[a], percent)) & (label[some] != label[a])
                some = some[ok]
                some = some[~_differ_too_much(n[some], n[a], parities.differ(some, np.full(len(some), a)), percent)]
                if len(some):
                    marked[a] = True
                    marked[some] = True
            if marked.any():
                yield rows.select(["gid", "side", "vid", "label"]).filter(pa.array(marked)).combine_chunks().to_batches()[0]

    cells = left.unionByName(right).withColumn("gid", F.xxhash64("key", "i", "j")).select("gid", "side", "vid", "n", "at", "label").join(classes.select("vid", "parity"), "vid").repartition("gid").sortWithinPartitions("gid")
    flagged = written(cells.mapInArrow(releasing(skip), "gid long, side int, vid long, label long"), "join_flagged")
    discard(part, open_)
    if flagged.isEmpty():
        return labels
    second = written(linked(flagged, _sets(docs, flagged, classes, width), percent), "join_links")
    return labels if second.isEmpty() else components(first.unionByName(second))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    Shingles: distinct runs of ``width`` words of the lower-cased (A-Z) text; a text
    of fewer words is one shingle, and a null, empty or blank text none and linked
    with nothing. Texts are linked if 100 * intersection >= ``percent`` * union.
    component_id: the smallest doc_id reachable by links, itself included. doc_id may
    be of any type that can be ordered. Rows with a null doc_id are linked with
    nothing: component_id null. Repeated rows of one id all come, with the same
    result where their texts agree. Extra columns are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*digests([s]), parity(s)) for s in shingle_sets(batch.column("text"), width)]
            columns = [pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array([f[3] for f in found], pa.binary())], ["doc_id", "n", "one", "two", "parity"])

    rows = written(docs.mapInArrow(releasing(measure), f"doc_id {kind}, n long, one long, two long, parity binary"), "join_rows")
    linkable = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    found = linkable.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    # vid rises with rep, so a component's smallest vid belongs to its smallest doc_id
    classes = written(found.repartitionByRange("rep", "one", "two").sortWithinPartitions("rep", "one", "two").withColumn("vid", F.monotonically_increasing_id()), "join_classes")
    labels = link_sets(docs.where(F.col("doc_id").isNotNull()), classes, width, percent)
    named = written(classes.select("vid", "rep", "one", "two").join(labels.withColumnRenamed("v", "vid"), "vid", "left").withColumn("label", F.coalesce("label", "vid")), "join_named")
    smallest = classes.select(F.col("vid").alias("label"), F.col("rep").alias("component_id"))
    classed = written(look_up(named, smallest, "label").select("one", "two", "component_id"), "join_classed")
    discard(labels, named)
    joined = look_up(linkable, classed, ["one", "two"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where((F.col("n") == 0) | F.col("doc_id").isNull())
    return joined.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id")))
