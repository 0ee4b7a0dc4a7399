"""MinHash near-duplicates by a signature-coordinate inverted join.

1. A document's set of word shingles gives a signature of 32 coordinates. Texts
   of equal sets are one class, compared once.
2. Each class is posted under (coordinate, value) pairs. Two classes that agree
   in 14 coordinates or more share one of their 32 - 14 + 1 rarest pairs, so only
   this prefix is posted; rarity comes from a count sketch of fixed size, and any
   error in it costs time, never a result. The longer posting lists are skipped:
   collisions there are counted from the two signatures themselves.
3. In each posting list all classes are first compared with one pivot; links are
   confirmed on full sets and joined to components. Lists that then hold more than
   one component are compared exactly, those outside the pivot's component with
   all others, in blocks of bounded size. So a large group of copies costs its
   size, not its square.

Posting lists, pivots and classes that hold a large part of all rows are spread
over all tasks (``skew.look_up``). Sets are of 64-bit hashes of whole shingles.

A pair of similarity 0.8 agrees in fewer than 14 of 32 coordinates with a
probability below 7e-6; no other pair is lost, for no list, block or number of
partners is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .memory import releasing
from .skew import look_up
from .storage import discard, written
from .words import buffers, find_words, hash_spans, mix, runs, slices

COORDINATES, MATCHES = 32, 14
PREFIX = COORDINATES - MATCHES + 1
BLOCK, MASS = 512, 1 << 18  # rows and shingles of a block
_CELLS, _CHUNKS = 1 << 20, 32
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_SALTS = mix(np.arange(101, 101 + COORDINATES, dtype=np.uint64))
_SPAN = 1 << 14


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles, of lower-cased words."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        text, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = find_words(text, at)
        shingles, begin = runs(hash_spans(text, words.starts, words.ends, lower=True), words.first, width)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            yield np.unique(shingles[a:b])


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and two hashes of each whole set; all 0 for an empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat, begin = np.concatenate([sets[k] for k in some]), np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        one[some] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), begin)
        two[some] = np.add.reduceat(mix(flat + np.uint64(0x14057B7EF767814F)), begin)
    return sizes, one.view(np.int64), two.view(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest of each coordinate's hashes over each set; 0 for empty sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        flat, begin = np.concatenate([sets[k] for k in some]), np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        for k in range(COORDINATES):
            out[some, k] = np.minimum.reduceat(((flat ^ _SALTS[k]) * _FACTORS[k]) >> np.uint64(32), begin)
    return out


def _signed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The signatures of a binary column."""
    data, _ = buffers(column)
    return data.view(np.uint32).reshape(-1, COORDINATES) if len(data) else np.zeros((0, COORDINATES), np.uint32)


def _keys(signature: np.ndarray) -> np.ndarray:
    """A hash of each (coordinate, value)."""
    return mix(signature.astype(np.uint64) ^ _SALTS[None, :])


def _order(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each (coordinate, value) by which rare ones come first, the same wherever it occurs."""
    cell = (keys >> np.uint64(44)).astype(np.int64)
    return (counts[cell].astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key of batches sorted by it."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = rows[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield rows.slice(a, b - a)
        held = rows.slice(cuts[-1] if len(cuts) else 0)
    if held is not None:
        yield held


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``left`` with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    if len(left) == 1:
        own, flat = left[0], np.concatenate(right)
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        out[0] = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum([len(s) for s in right])[:-1])))
        return out
    flats = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    common = np.intersect1d(*map(np.unique, flats), assume_unique=True)
    columns = []
    for flat in flats:
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        columns.append(np.where(common[at] == flat, at, -1) if len(common) else np.full(len(flat), -1))
    for start in range(0, len(common), _SPAN):
        dense = []
        for side, row, column in zip((left, right), rows, columns, strict=True):
            inside = (column >= start) & (column < start + _SPAN)
            matrix = np.zeros((len(side), min(_SPAN, len(common) - start)), np.float32)
            matrix[row[inside], column[inside] - start] = 1
            dense.append(matrix)
        out += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    return out


def _confirmed(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of labels (a, b) linked within blocks (gid, side, vid, label): a row of side 0 with one of side 1."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "gid"):
            side, label = rows["side"].to_numpy(), rows["label"].to_numpy()
            shingles = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows["shingles"]]
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(one) == 0 or len(two) == 0:
                continue
            shared = shared_sizes([shingles[k] for k in one], [shingles[k] for k in two])
            sizes = np.array([len(s) for s in shingles], np.int64)
            union = sizes[one][:, None] + sizes[two][None, :] - shared
            x, y = np.nonzero((100 * shared >= percent * union) & (label[one][:, None] != label[two][None, :]))
            if len(x):
                pairs = np.unique(np.sort(np.stack([label[one[x]], label[two[y]]], axis=1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = blocks.distinct().join(sets, "vid").repartition("gid").sortWithinPartitions("gid")
    return rows.select("gid", "side", "label", "shingles").mapInArrow(releasing(confirm), "a long, b long").distinct()


def _sketch(classes: DataFrame) -> np.ndarray:
    """Counts of (coordinate, value) pairs in 2**20 hash cells, over all classes; 8 MB at any size."""
    width = _CELLS // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CELLS, np.int64)
        for batch in batches:
            total += np.bincount((_keys(_signed(batch.column("signature"))) >> np.uint64(44)).astype(np.int64).ravel(), minlength=_CELLS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([total[k * width : (k + 1) * width].tobytes() for k in range(_CHUNKS)])], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(counts.as_buffer(), np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "counts"])

    kind = "chunk int, counts binary"
    parts = classes.select("signature").mapInArrow(releasing(count), kind).repartition(_CHUNKS, "chunk").mapInArrow(add, kind).collect()  # 32 rows of 256 kB
    out = np.zeros(_CELLS, np.int64)
    for r in parts:
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.uint32)


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (p, v, chunk, ps, vs) whose signatures agree in enough coordinates."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_signed(batch.column("ps")) == _signed(batch.column("vs"))).sum(axis=1) >= MATCHES
            yield batch.select(["p", "v", "chunk"]).filter(pa.array(near))

    return pairs.select("p", "v", "chunk", "ps", "vs").mapInArrow(agree, "p long, v long, chunk long")


def link_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """v and label of all classes (vid, rep, one, two, n, signature) that are linked with others."""
    counts = spark.sparkContext.broadcast(_sketch(classes))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(_signed(batch.column("signature")))
            rare = np.argsort(_order(keys, counts.value), axis=1, kind="stable")[:, :PREFIX]
            chosen = np.take_along_axis(keys, rare, axis=1)
            repeated = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), PREFIX))
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel().view(np.int64)), repeated("vid"), repeated("n")], ["key", "vid", "n"])

    postings = written(classes.select("vid", "n", "signature").mapInArrow(releasing(post), "key long, vid long, n long"), "dedup_postings")
    lists = written(postings.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("mass"), F.min(F.struct("vid", "n")).alias("pivot")).where("size > 1"), "dedup_lists")
    held = written(look_up(postings, lists, "key").select("key", "vid", "n", "size", "mass", F.col("pivot.vid").alias("p"), F.col("pivot.n").alias("pn")), "dedup_held")
    discard(postings, lists)
    blocks = lambda rows, mass: F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(mass) / MASS))
    fit = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)  # noqa: E731  sizes too far apart cannot be similar
    stars = (
        held.where((F.col("vid") != F.col("p")) & fit("n", "pn"))
        .groupBy("p", F.col("vid").alias("v"))
        .agg(F.max("size").alias("size"), F.max("mass").alias("mass"))
        .select("p", "v", F.pmod(F.xxhash64("v"), blocks("size", "mass")).cast("long").alias("chunk"))
    )
    signed = classes.select("vid", "signature")
    offered = written(stars.join(signed.select(F.col("vid").alias("v"), F.col("signature").alias("vs")), "v"), "dedup_offers")
    near = written(_agreeing(look_up(offered, signed.select(F.col("vid").alias("p"), F.col("signature").alias("ps")), "p")), "dedup_stars")
    discard(offered)
    gid = F.xxhash64("p", "chunk")
    star_blocks = near.select(gid.alias("gid"), F.lit(0).alias("side"), F.col("p").alias("vid")).unionByName(near.select(gid.alias("gid"), F.lit(1).alias("side"), F.col("v").alias("vid")))
    star_blocks = star_blocks.withColumn("label", F.col("vid"))
    first = written(_confirmed(star_blocks, _sets(docs, star_blocks, classes, width), percent), "dedup_links")
    discard(near)
    labels = components(first)

    own = labels.select(F.col("v").alias("vid"), "label")
    labelled = written(held.join(own, "vid", "left").withColumn("label", F.coalesce("label", "vid")), "dedup_labelled")
    pivots = labels.select(F.col("v").alias("p"), F.col("label").alias("plabel"))
    named = written(look_up(labelled, pivots, "p", "left").withColumn("plabel", F.coalesce("plabel", "p")), "dedup_named")
    discard(held, labelled)
    others = written(named.where("label <> plabel").groupBy("key").agg(F.count("*").alias("others"), F.sum("n").alias("others_mass")), "dedup_open")
    open_ = look_up(named.select("key", "vid", "n", "label", "plabel", "size", "mass"), others, "key")
    rows, all_rows = blocks("others", "others_mass"), blocks("size", "mass")
    at = lambda n: F.pmod(F.xxhash64("vid"), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = open_.where("label <> plabel").select("key", at(rows).cast("long").alias("i"), spread(all_rows).alias("j"), F.lit(0).alias("side"), "vid", "n", "label")
    right = open_.select("key", spread(rows).alias("i"), at(all_rows).cast("long").alias("j"), F.lit(1).alias("side"), "vid", "n", "label")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "gid"):
            side, n, label = (rows[c].to_numpy() for c in ("side", "n", "label"))
            sig = _signed(rows["signature"])
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(one) == 0 or len(two) == 0:
                continue
            keys, marked = _keys(sig[one]), np.zeros(len(side), bool)
            order = _order(keys, counts.value)
            own = rows["key"].to_numpy().view(np.uint64)
            for x, a in enumerate(one):
                same = sig[two] == sig[a]
                ok = (same.sum(axis=1) >= MATCHES) & (label[two] != label[a]) & (100 * np.minimum(n[two], n[a]) >= percent * np.maximum(n[two], n[a])) & (own[two] == own[a])
                if not ok.any():
                    continue
                hits = np.flatnonzero(ok)
                rarest = np.where(same[hits], order[x][None, :], np.iinfo(np.uint64).max).argmin(axis=1)  # the pair belongs to its rarest common list
                hits = hits[keys[x][rarest] == own[a]]
                if len(hits):
                    marked[a] = True
                    marked[two[hits]] = True
            if marked.any():
                yield rows.select(["gid", "side", "vid", "label"]).filter(pa.array(marked)).combine_chunks().to_batches()[0]

    cells = left.unionByName(right).withColumn("gid", F.xxhash64("key", "i", "j")).join(signed, "vid")
    sorted_ = cells.select("gid", "key", "side", "vid", "n", "label", "signature").repartition("gid").sortWithinPartitions("gid")
    flagged = written(sorted_.mapInArrow(releasing(flag), "gid long, side int, vid long, label long"), "dedup_flagged")
    discard(named, others)
    second = written(_confirmed(flagged, _sets(docs, flagged, classes, width), percent), "dedup_links")
    if second.isEmpty():
        return labels
    return components(first.unionByName(second))


def _sets(docs: DataFrame, blocks: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Full shingle sets (vid, shingles) of the classes named in ``blocks``, from whole texts."""
    wanted = blocks.select("vid").distinct().join(classes.select("vid", "rep", "one", "two"), "vid")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            _, one, two = digests(sets)
            right = (one == batch.column("one").to_numpy()) & (two == batch.column("two").to_numpy())  # an id may stand for several texts
            yield pa.RecordBatch.from_arrays([batch.column("vid").filter(pa.array(right)), pa.array([s.tobytes() for s, r in zip(sets, right, strict=True) if r], pa.binary())], ["vid", "shingles"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep")
    return texts.select("vid", "one", "two", "text").mapInArrow(releasing(gather), "vid long, shingles binary").groupBy("vid").agg(F.first("shingles").alias("shingles"))


def _placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, component_id, and text1 and text2 (two hashes of the text) of each row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    carried = ["doc_id", "text1", "text2"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            sets: list[np.ndarray] = []
            done = 0

            def out() -> pa.RecordBatch:
                sizes, one, two = digests(sets)
                packed = [s.tobytes() for s in signatures(sets)]
                return pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(done, len(sets)) for c in carried), pa.array(sizes), pa.array(one), pa.array(two), pa.array(packed, pa.binary())], [*carried, "n", "one", "two", "signature"]
                )

            held = 0
            for s in shingle_sets(text, width):
                sets.append(s)
                held += len(s)
                if held > 1 << 18:
                    yield out()
                    done, sets, held = done + len(sets), [], 0
            if sets:
                yield out()

    texts = docs.select("doc_id", "text", *_text_hashes())
    rows = written(texts.mapInArrow(releasing(sign), f"doc_id {kind}, text1 long, text2 long, n long, one long, two long, signature binary"), "dedup_rows")
    linkable = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    found = linkable.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    # vid rises with rep, so a component's smallest vid belongs to its smallest doc_id
    classes = written(found.repartitionByRange("rep", "one", "two").sortWithinPartitions("rep", "one", "two").withColumn("vid", F.monotonically_increasing_id()), "dedup_classes")
    labels = link_classes(spark, docs, classes, width, percent)
    named = written(classes.select("vid", "rep", "one", "two").join(labels.withColumnRenamed("v", "vid"), "vid", "left").withColumn("label", F.coalesce("label", "vid")), "dedup_named")
    smallest = classes.select(F.col("vid").alias("label"), F.col("rep").alias("component_id"))
    classed = written(look_up(named, smallest, "label").select("one", "two", "component_id"), "dedup_classed")
    discard(labels, named)
    linked = look_up(linkable, classed, ["one", "two"]).select(*carried, "n", "component_id")
    alone = rows.where((F.col("n") == 0) | F.col("doc_id").isNull()).select(*carried, "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("text1"), F.xxhash64(F.lit(1), "text", F.octet_length("text")).alias("text2")]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Shingles: distinct runs of ``width`` words of the lower-cased (A-Z) text; a
    text of fewer words is one shingle, and a null, empty or blank text none and
    linked with nothing. Texts are linked if their sets' intersection is at least
    ``percent`` per cent of their union. component_id: the smallest doc_id
    reachable by links; kept: doc_id is that one. doc_id may be of any type that
    can be ordered, text too. Rows with a null doc_id are linked with nothing:
    component_id null, kept true. Repeated rows of one id all come, with the same
    result where their texts agree. Extra columns are ignored; an empty table gives
    an empty result.
    """
    placed = _placed(docs, width, percent)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns of ``docs``, and the rows linked with nothing.

    The row that stays has its component's smallest doc_id; if that id has several
    texts in the component, the one of the smallest text hash. Rows are told apart
    by id and text, so another text under a kept id stays only if its own component
    keeps it. Of rows with equal id and text one stays; rows with a null id all do.
    """
    named = _placed(docs, width, percent).where(F.col("doc_id").isNotNull())
    first = named.where((F.col("n") > 0) & (F.col("doc_id") == F.col("component_id"))).groupBy("component_id").agg(F.min(F.struct("text1", "text2")).alias("t"))
    kept = first.select(F.col("component_id").alias("doc_id"), "t.text1", "t.text2").unionByName(named.where("n = 0").select("doc_id", "text1", "text2").distinct())
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*names).alias("row"), "doc_id", *_text_hashes())
    keys = ["doc_id", "text1", "text2"]
    one = rows.join(kept, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")  # dealt out as the join is
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
