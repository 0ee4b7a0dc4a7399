"""Alignment of two tokenizers, with pair counts behind a minimal perfect hash.

1. Both tokenizers break a text before a space that follows a printable ASCII
   character, so a text is a row of segments and no token, group or link spans two.
   A task encodes and aligns each distinct segment once: the byte ends of both token
   lists, merged, cut a segment into the overlaps of one token of each side.
2. The corpus's distinct id pairs get a minimal perfect hash (levels of bit arrays;
   a key settles at the first level where it is alone in its bit; its slot is the
   rank of that bit), built shard by shard in tasks.
3. Each task adds its links up in one dense vector of slots; vectors are summed by
   ranges of slots. The keys stand beside the slots, so a pair that was never seen
   is told from one that was.
4. A second pass aligns the documents again and looks their pairs up.

The hash holds ``HEAD`` pairs at most (75 MB with keys and counts); of more, those
that most tasks have met. The others' counts are summed and joined by key, exactly.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import releasing
from .near_dedup import by_group
from .selection import largest
from .storage import written
from .token_counts import SPLIT, byte_alphabet, load
from .words import buffers, hash_spans, mix, slices

HEAD, SHARD, LEVELS, CHUNK = 1 << 22, 1 << 16, 64, 1 << 14
_KEPT_SEGMENTS, _KEPT_BYTES = 1_000_000, 96 << 20
_JOINED = 1000
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True


class _Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.zeros(self.size + len(values), self.held.dtype)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.size]


def _spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


class Aligner:
    """Both tokenizers and the segments that they have aligned, as arrays over all segments, their pairs and their groups' text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = load(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in byte_alphabet().items()}
        named = {i: bytes(back[c] for c in name) for name, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in back for c in name)}
        self.bytes_a = [named.get(i, b"") for i in range(max(named) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.tables = [(np.frombuffer(b"".join(t), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in t])))) for t in (self.bytes_a, self.bytes_b)]
        self.space = self.b.piece_to_id("▁")
        names = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits = np.array([len(x) for x in names])
        self.names = np.frombuffer(b"".join(x.ljust(12) for x in names), np.uint8).reshape(-1, 12)
        self.fast = self._by_ranks(path_a)
        self._empty()

    def _by_ranks(self, path: str):
        """A faster encoder of the same ids for vocabularies whose ids rise with their merges' ranks; None for others."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if any(b <= a for a, b in pairwise(made)):
            return None
        return tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={text: i for i, text in enumerate(self.bytes_a) if text}, special_tokens={})

    def _ids_a(self, plain: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, and how many each has. Segments that end in a printable sign are encoded many in one text."""
        if self.fast is None:
            lists = [e.ids for e in self.a.encode_batch_fast(plain, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(plain))
        joined, held = [], []
        for text in plain:
            held.append(text)
            if not "!" <= text[-1] <= "~" or len(held) == _JOINED:
                joined.append("".join(held))
                held = []
        joined.append("".join(held))
        ids = np.fromiter(chain.from_iterable(map(self.fast.encode_ordinary, joined)), np.int64)
        begin = self.tables[0][1]
        ends = np.cumsum(begin[ids + 1] - begin[ids])  # every byte is in a token
        return ids, np.diff(np.concatenate(([0], np.searchsorted(ends, np.cumsum(size), "right"))))

    def _empty(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of known segments, sorted, and their places
        self.n_a, self.n_b, self.n_groups, self.n_pairs, self.n_text = (_Grown(np.int32) for _ in range(5))
        self.whole, self.pairs, self.text = _Grown(bool), _Grown(np.int64), _Grown(np.uint8)
        self.pairs_at, self.text_at = _Grown(np.int64), _Grown(np.int64)

    def _joined(self, side: int, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of each segment's tokens are the segment's."""
        flat, begin = self.tables[side]
        sizes = begin[ids + 1] - begin[ids]
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        own = np.diff(np.concatenate(([0], ends)))
        good = np.diff(cuts) == own
        spans = lambda begins, which: _spans(begins[which], own[which])
        some = np.flatnonzero(good)
        same = flat[_spans(begin[ids], sizes)][spans(cuts[:-1], some)] == data[spans(ends - own, some)]
        wrong = np.repeat(some, own[some])[~same]
        good[wrong] = False
        return good

    def align(self, texts: list[bytes]) -> None:
        """Aligns distinct segments that begin with a space, valid UTF-8 each, and keeps them."""
        plain = [t.decode() for t in texts]
        data, size = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        lists = [x or [self.space] for x in self.b.encode([t[1:] for t in plain], num_threads=1)]  # a lone space: the library takes nothing for nothing
        (ids_a, counts_a), ids_b = self._ids_a(plain, size), np.fromiter(chain.from_iterable(lists), np.int64)
        ids, counts = (ids_a, ids_b), (counts_a, np.fromiter(map(len, lists), np.int64, len(lists)))
        whole = self._joined(0, ids[0], counts[0], data, np.cumsum(size)) & self._joined(1, ids[1], counts[1], data, np.cumsum(size))
        a, b = (x[np.repeat(whole, n)] for x, n in zip(ids, counts, strict=True))
        ends_a, ends_b = (np.cumsum(t[1][x + 1] - t[1][x]) for t, x in zip(self.tables, (a, b), strict=True))
        cuts = np.cumsum(size[whole])  # ends of the whole segments, laid end to end; both sides have all of them
        merged = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        again = np.concatenate((merged[1:] == merged[:-1], [False]))[: len(merged)]
        ends, both = merged[~again], merged[again]
        per = lambda x: np.diff(np.concatenate(([0], np.searchsorted(x, cuts, "right"))))
        pairs = a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]  # the tokens that an overlap ending there belongs to
        of_a, of_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)  # groups
        last_a, last_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        place_a = np.arange(len(a)) + np.concatenate(([0], last_b + 1))[of_a]
        place_b = np.arange(len(b)) + (last_a + 1)[of_b]
        row, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        row[place_a], row[place_b] = a, b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        shown = self.names[row]
        shown[np.arange(len(row)), self.digits[row]] = mark
        inside = np.arange(12)[None, :] <= self.digits[row][:, None]
        written_ = np.concatenate(([0], np.cumsum(self.digits[row] + 1)))[np.concatenate(([0], np.cumsum(per(ends_a) + per(ends_b))))]

        def spread(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(texts), np.int64)
            out[whole] = values
            return out

        n_pairs, n_text = spread(per(ends)), spread(np.diff(written_))
        for column, values in ((self.n_a, spread(per(ends_a))), (self.n_b, spread(per(ends_b))), (self.n_groups, spread(per(both))), (self.n_pairs, n_pairs), (self.n_text, n_text), (self.whole, whole)):
            column.add(values)
        self.pairs_at.add(self.pairs.size + np.cumsum(n_pairs) - n_pairs)
        self.text_at.add(self.text.size + np.cumsum(n_text) - n_text)
        self.pairs.add(pairs)
        self.text.add(shown[inside])

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each span of ``data`` among the segments."""
        if self.whole.size > _KEPT_SEGMENTS or self.text.size + 8 * self.pairs.size > _KEPT_BYTES:
            self._empty()
        values, first, which = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, values)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == values if len(self.hashes) else np.zeros(len(values), bool)
        new = np.flatnonzero(~known)
        if len(new):
            before = self.whole.size
            raw = data.tobytes()
            self.align([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.hashes = np.insert(self.hashes, at[new], values[new])
            self.at = np.insert(self.at, at[new], np.arange(before, before + len(new)))
            at = np.searchsorted(self.hashes, values)
        return self.at[at][which]

    def documents(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of rows i to j: the places of all segments, and each row's first; rows that have no tokens have none."""
        raw, offsets = buffers(column)
        for i, j in slices(offsets):
            sizes = np.diff(offsets[i : j + 1])
            some = sizes > 0
            # each text after a space
            at = np.concatenate(([0], np.cumsum(sizes + 1)))
            data = np.full(at[-1], 0x20, np.uint8)
            inside = np.ones(at[-1], bool)
            inside[at[:-1]] = False
            data[inside] = raw[offsets[i] : offsets[j]]
            cut = np.zeros(len(data), bool)
            cut[1:] = (data[1:] == 0x20) & _PRINTED[data[:-1]]
            cut[at[:-1]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(data))
            row = np.searchsorted(at, starts, "right") - 1
            use = some[row]
            starts, ends, row = starts[use], ends[use], row[use]
            places = self.numbers(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
            broken = np.unique(row[~self.whole.all[places]])
            if len(broken):
                use = ~np.isin(row, broken)
                places, row = places[use], row[use]
            yield i, j, places, np.searchsorted(row, np.arange(j - i + 1))

    def links(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct segments among ``places`` and how often each occurs; all their pairs, and where each one's begin."""
        which, times = np.unique(places, return_counts=True)
        sizes = self.n_pairs.all[which].astype(np.int64)
        return which, times, self.pairs.all[_spans(self.pairs_at.all[which], sizes)], np.concatenate(([0], np.cumsum(sizes)))

    def texts(self, places: np.ndarray) -> bytes:
        """The groups of all segments at ``places``, a semicolon after each group."""
        return self.text.all[_spans(self.text_at.all[places], self.n_text.all[places].astype(np.int64))].tobytes()


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, which serves many tasks."""
    if (path_a, path_b) not in _aligners:
        _aligners.clear()
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _at(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) ^ mix(np.array([level + 1], np.uint64)))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_at(keys, LEVELS) % np.uint64(shards)).astype(np.int64)


def hash_levels(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels for distinct keys, and the keys in the order of their slots."""
    bits, slots = [], []
    while len(keys):
        size = 2 * len(keys)
        at = (_at(keys, len(bits)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        bits.append(alone)
        slots.append(keys[settled][np.argsort(at[settled])])
        keys = keys[~settled]
    return bits, np.concatenate(slots) if slots else np.zeros(0, np.int64)


class PairHash:
    """Slots of distinct keys, without gaps; -1 for any other key."""

    def __init__(self, shards: list[tuple[list[int], np.ndarray, np.ndarray]]):
        """Of each shard the sizes of its levels, their bits, and its keys by slot."""
        self.sizes = np.zeros((len(shards), LEVELS), np.uint64)
        self.begin = np.zeros((len(shards), LEVELS), np.int64)
        at = 0
        for s, (sizes, _, _) in enumerate(shards):
            for k, size in enumerate(sizes):
                self.sizes[s, k], self.begin[s, k] = size, at
                at += size
        self.bits = np.concatenate([b for _, b, _ in shards]) if shards else np.zeros(0, bool)
        self.keys = np.concatenate([k for _, _, k in shards]) if shards else np.zeros(0, np.int64)
        self._index()

    def _index(self) -> None:
        packed = np.packbits(self.bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def __getstate__(self):
        return {k: np.packbits(v) if k == "bits" else v for k, v in self.__dict__.items() if k not in ("words", "before")} | {"n_bits": len(self.bits)}

    def __setstate__(self, state):
        n = state.pop("n_bits")
        self.__dict__ |= state
        self.bits = np.unpackbits(self.bits, count=n).astype(bool)
        self._index()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys) == 0 or len(keys) == 0:
            return out
        shard, left = _shard_of(keys, len(self.sizes)), np.arange(len(keys))
        for level in range(LEVELS):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if len(left) == 0:
                break
            at = self.begin[shard[left], level] + (_at(keys[left], level) % size).astype(np.int64)
            hit = self.bits[at]
            word, inside = at[hit] >> 6, (at[hit] & 63).astype(np.uint64)
            rank = self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << inside) - np.uint64(1)))
            out[left[hit]] = rank
            left = left[~hit]
        wrong = self.keys[np.maximum(out, 0)] != keys
        out[wrong] = -1
        return out


def pair_hash(pairs: DataFrame, n: int) -> PairHash:
    """The hash of the ``n`` distinct ``key``s of ``pairs``, built in tasks, a shard at a time."""
    shards = max(1, -(-n // SHARD))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(keys.to_numpy(), shards)), keys], ["shard", "key"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "shard"):
            bits, keys = hash_levels(rows["key"].to_numpy())
            sizes = np.array([len(b) for b in bits], np.int64)
            packed = np.packbits(np.concatenate(bits)).tobytes()
            yield pa.RecordBatch.from_arrays([rows["shard"].chunk(0).slice(0, 1), pa.array([sizes.tobytes()]), pa.array([packed]), pa.array([keys.tobytes()])], ["shard", "sizes", "bits", "keys"])

    dealt = pairs.select("key").mapInArrow(number, "shard long, key long").repartition("shard").sortWithinPartitions("shard")
    found = {r.shard: r for r in dealt.mapInArrow(releasing(build), "shard long, sizes binary, bits binary, keys binary").collect()}  # HEAD keys at most
    parts = []
    for s in range(shards):
        sizes = np.frombuffer(found[s].sizes, np.int64).tolist() if s in found else []
        parts.append((sizes, np.unpackbits(np.frombuffer(found[s].bits, np.uint8), count=sum(sizes)).astype(bool) if s in found else np.zeros(0, bool), np.frombuffer(found[s].keys, np.int64) if s in found else np.zeros(0, np.int64)))
    return PairHash(parts)


def align_documents(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs`` (doc_id, text).

    path_a: a byte-level tokenizer file, path_b: a sentencepiece model with byte
    fallback that puts a space before a text; every executor can open both there. A
    encodes a space and the text, B the text, special strings as plain text. Places
    where tokens of both end cut them into groups; a link is an A and a B token that
    overlap; a pair's count is how many links of all rows hold it. n_best: links
    whose pair has its B id's highest count, ties included; count_sum: counts of all
    links. Texts that are null, empty, or not given back by both tokenizers byte by
    byte have zeros and '' for the hash. Rows with null or repeated ids count and
    come like others. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, seen = aligner_of(path_a, path_b), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, places, _ in aligner.documents(batch.column("text")):
                seen = np.unique(np.concatenate([seen, np.unique(aligner.links(places)[2])]), sorted=True)
                if len(seen) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(seen)], ["key"])
                    seen = seen[:0]
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen)], ["key"])

    pairs = written(texts.select("text").mapInArrow(releasing(distinct), "key long").groupBy("key").agg(F.count("*").alias("seen")), "align_pairs")
    n = pairs.count()
    chosen = pairs if n <= head else largest(pairs, "seen", head)
    if n > head:
        chosen = written(chosen, "align_head")
        index = pair_hash(chosen, chosen.count())
    else:
        index = pair_hash(chosen, n)
    shared = context.broadcast(index)  # HEAD keys at most
    slots = len(index.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, total = aligner_of(path_a, path_b), np.zeros(slots, np.int64)
        for batch in batches:
            for _, _, places, _ in aligner.documents(batch.column("text")):
                _, times, keys, begin = aligner.links(places)
                at = shared.value.slots(keys)
                np.add.at(total, at[at >= 0], np.repeat(times, np.diff(begin))[at >= 0])
        parts = [(k, total[k * CHUNK : (k + 1) * CHUNK]) for k in range(-(-slots // CHUNK))]
        parts = [(k, p) for k, p in parts if p.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(counts.as_buffer(), np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "counts"])

    vector = "chunk int, counts binary"
    tasks = 2 * context.defaultParallelism  # each sends one vector
    dense = texts.select("text").coalesce(tasks).mapInArrow(releasing(count), vector)
    counts = np.zeros(slots, np.int64)
    for r in dense.repartition(max(1, -(-slots // CHUNK)), "chunk").mapInArrow(add, vector).collect():  # HEAD counts at most
        counts[r.chunk * CHUNK : r.chunk * CHUNK + len(r.counts) // 8] = np.frombuffer(r.counts, np.int64)
    best = np.zeros(1 + int((index.keys & 0xFFFFFFFF).max(initial=0)), np.int64)
    np.maximum.at(best, index.keys & 0xFFFFFFFF, counts)

    partial = n > head
    if partial:

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = aligner_of(path_a, path_b)
            for batch in batches:
                for _, _, places, _ in aligner.documents(batch.column("text")):
                    _, times, keys, begin = aligner.links(places)
                    out = shared.value.slots(keys) < 0
                    yield pa.RecordBatch.from_arrays([pa.array(keys[out]), pa.array(np.repeat(times, np.diff(begin))[out])], ["key", "n"])

        tail = written(texts.select("text").mapInArrow(releasing(rest), "key long, n long").groupBy("key").agg(F.sum("n").alias("count")), "align_tail")
        for r in tail.groupBy(F.col("key").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("top")).collect():  # B's vocabulary at most
            best = np.pad(best, (0, max(0, r.b + 1 - len(best))))
            best[r.b] = max(best[r.b], r.top)
    known = context.broadcast((counts, best))  # HEAD counts, and B's vocabulary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, index = aligner_of(path_a, path_b), shared.value
        counts, best = known.value
        for batch in batches:
            for i, j, places, first in aligner.documents(batch.column("text")):
                which, _, keys, begin = aligner.links(places)
                at = index.slots(keys)
                value = np.where(at >= 0, counts[np.maximum(at, 0)] if len(counts) else 0, 0)
                top = (at >= 0) & (value == best[keys & 0xFFFFFFFF])
                per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[begin])  # noqa: E731  of each distinct segment
                back = np.searchsorted(which, places)
                summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[back])))[first])  # noqa: E731  of each row
                fields = [summed(x.all[which]) for x in (aligner.n_a, aligner.n_b, aligner.n_groups)]
                hashes = ["" if a == b else hashlib.sha256(aligner.texts(places[a:b])[:-1]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                columns = [batch.column("doc_id").slice(i, j - i), *map(pa.array, (*fields, summed(np.diff(begin)), summed(per(top.astype(np.int64))), summed(per(value)), hashes))]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                if partial:
                    lists: list[np.ndarray] = [keys[begin[k] : begin[k + 1]][at[begin[k] : begin[k + 1]] < 0] for k in range(len(which))]
                    each = [np.unique(np.concatenate([lists[k] for k in back[a:b]]) if b > a else np.zeros(0, np.int64), return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                    columns += [pa.array([list(k) for k, _ in each], pa.list_(pa.int64())), pa.array([list(m) for _, m in each], pa.list_(pa.int64()))]
                    names += ["rest", "times"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    if not partial:
        return texts.mapInArrow(releasing(score), schema)
    rows = written(texts.mapInArrow(releasing(score), schema + ", rest array<long>, times array<long>").withColumn("_row", F.monotonically_increasing_id()), "align_rows")
    tops = spark.createDataFrame([(b, int(v)) for b, v in enumerate(best.tolist())], "b long, top long")
    each = rows.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("_row", F.col("x.rest").alias("key"), F.col("x.times").alias("times"))
    met = each.join(tail, "key").withColumn("b", F.col("key").bitwiseAND(0xFFFFFFFF)).join(F.broadcast(tops), "b")  # B's vocabulary
    sums = met.groupBy("_row").agg(F.sum(F.col("times") * F.col("count")).alias("_sum"), F.sum(F.when(F.col("count") == F.col("top"), F.col("times")).otherwise(0)).alias("_best"))
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return rows.join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "_best"), more("count_sum", "_sum"), "groups_sha256")
