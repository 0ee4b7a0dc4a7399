"""A hidden Markov language model, trained by Baum-Welch over partitions.

States emit word classes, and classes emit words. The end token is a class, each
of the 1000 most frequent words is one of its own, and so is each that occurs 1000
times or more; all other words, unknown ones too, fall into classes by their first
and last letters and their length, and within such a class a word has its smoothed
share of the class's tokens (one more share is kept for unknown words). So the
model is a proper one over an open vocabulary, whose states get more parameters as
the corpus grows; words of their own are among the 131,072 that go to every
executor.

Word counts are summed over all training documents; the counts of the 131,072
most frequent words go to every executor, those of all others are joined; the end
token is counted apart from the words. Each Baum-Welch pass runs over every training document, adds up expected counts in the
partitions and then state by state. Start values are the classes' shares of all
training tokens with seeded noise. Passes end when they gain little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import releasing
from .selection import largest
from .storage import written
from .words import buffers, find_words, hash_spans, mix, slices

FOLDS, SMOOTH = 10, 0.1
STATES, TOP_WORDS, OWN_COUNT, SHAPES, FREQUENT = 8, 1000, 1000, 1024, 1 << 17
END = np.int64(0x7E57)  # stands for the end token's hash
_KEPT_WORDS, _TOKENS = 1 << 20, 1 << 19
_RESCALE, _BLOCK = 8, 1 << 15  # steps between rescalings, rows of one bulk operation
_LONG, _SEGMENT, _TOGETHER = 1 << 17, 1 << 12, 1 << 10  # longer chains are cut; tokens that follow one another, and matrices side by side, in one recursion


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of rows i to j: hashes and shapes of their words, an end token after each row, and each row's first token."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        text, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = find_words(text, at)
        h = hash_spans(text, words.starts, words.ends, lower=True).view(np.int64)
        low = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64)
        size = words.ends - words.starts
        if len(h):
            ends = low(text[words.starts]), low(text[words.ends - 1]), np.where(size > 1, low(text[np.maximum(words.ends - 2, 0)]), 0).astype(np.uint64)
            shape = (mix(ends[0] | ends[1] << np.uint64(8) | ends[2] << np.uint64(16) | np.minimum(size, 10).astype(np.uint64) << np.uint64(24)) % np.uint64(SHAPES)).astype(np.int16)
        else:
            shape = np.zeros(0, np.int16)
        places = words.first[1:] + np.arange(j - i)  # of the end tokens
        hashes, shapes = np.full(len(h) + j - i, END), np.full(len(h) + j - i, -1, np.int16)
        inside = np.ones(len(hashes), bool)
        inside[places] = False
        hashes[inside], shapes[inside] = h, shape
        yield i, j, hashes, shapes, np.concatenate(([0], places + 1))


def _summed(hashes: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, shapes, counts = hashes[order], shapes[order], counts[order]
    begin = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, int)
    return hashes[begin], shapes[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, shape and count of every word, and of the end token, of the texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            h, s, c = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), pa.array(c)], ["hash", "shape", "count"])

        for batch in batches:
            for _, _, hashes, shapes, _ in _words(batch.column("text")):
                held.append(_summed(hashes, shapes, np.ones(len(hashes), np.int64)))
                if sum(len(x[0]) for x in held) > _KEPT_WORDS:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > _KEPT_WORDS // 2:
                        yield out()
                        held = []
        if held:
            yield out()

    partial = docs.select("text").mapInArrow(releasing(count), "hash long, shape short, count long")
    return partial.groupBy("hash").agg(F.min("shape").alias("shape"), F.sum("count").alias("count"))


class Lexicon:
    """The frequent words' counts, and the totals of all classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, end_total: int = 0):
        """hashes and counts of words by falling count; total and distinct are of all training tokens, the end token among them."""
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        top = np.arange(min(len(hashes), max(TOP_WORDS, int((counts >= OWN_COUNT).sum()))))
        self.classes = np.full(len(hashes), -1, np.int32)  # class of its own; -1: by shape
        self.classes[rank[top]] = np.arange(1, len(top) + 1)
        self.total, self.distinct = total, distinct
        self.edge = (int(counts[top[-1]]), int(hashes[top[-1]])) if len(top) else (0, 0)
        self.own = max(TOP_WORDS, len(top))
        self.end_total, self.own_total = end_total, counts[top]
        self.shape_total, self.shape_words = np.zeros(SHAPES), np.zeros(SHAPES)

    def totals(self) -> np.ndarray:
        """Training tokens of each class: the end token, words of their own, shapes."""
        return np.concatenate(([self.end_total], self.own_total, np.zeros(self.own - len(self.own_total)), self.shape_total))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def inner(self, counts: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.shape_total[shapes] + SMOOTH * (self.shape_words[shapes] + 1)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each frequent word, and whether it is one."""
        if len(self.hashes) == 0:
            return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


CLASSES = 1 + TOP_WORDS + SHAPES  # at least


def _by_length(first: np.ndarray, limit: int = _TOKENS) -> Iterator[np.ndarray]:
    """Sequences of like length, longest first, in groups of about ``limit`` tokens."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    i = 0
    while i < len(order):
        j = i + max(1, int(np.searchsorted(np.cumsum(sizes[order[i:]]), limit, "right")))
        yield order[i:j]
        i = j


def log_likelihood(tokens: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Exact log10 probability of each sequence of classes by the scaled forward recursion."""
    by_class = np.ascontiguousarray(emit.T)
    parts = _Segments(tokens, first, start, move, by_class)
    out = np.zeros(len(parts.first) - 1)
    for chosen in _by_length(parts.first, _TOKENS // 4):
        steps = _Steps(parts.first, chosen)
        forward, scale = _forward(steps, by_class.take(tokens[steps.token], axis=0), parts.begin[chosen], move)
        out[chosen] = np.log10(forward[steps.last].sum(axis=1)) + np.bincount(steps.row, weights=np.log10(scale), minlength=len(chosen))
    return np.bincount(parts.of, weights=out, minlength=len(first) - 1)


class _Segments:
    """Very long sequences cut into segments, each with what comes before and after it, so that those of one sequence run side by side.

    A segment's steps are one matrix, states at its begin by states at its end. The
    matrices of all segments are formed together; vectors then pass from segment to
    segment: forward the chances of the states at its first token, given all tokens
    before, and backward the chance of all tokens after it, up to a factor.
    """

    def __init__(self, tokens: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, by_class: np.ndarray):
        sizes = np.diff(first)
        count = np.where(sizes > _LONG, -(-sizes // _SEGMENT), 1)
        self.of = np.repeat(np.arange(len(sizes)), count)
        head = np.cumsum(count) - count
        cuts = first[:-1][self.of] + _SEGMENT * (np.arange(len(self.of)) - head[self.of])
        self.first = np.append(cuts, first[-1])
        self.lead = np.zeros(len(self.of), bool)  # the first of their sequence
        self.lead[head] = True
        self.begin, self.after = np.tile(start, (len(self.of), 1)), np.ones((len(self.of), len(start)), by_class.dtype)
        some = np.flatnonzero(count[self.of] > 1)
        if len(some):
            self._pass(some, self._matrices(some, tokens, move, by_class), move.astype(float))

    def _matrices(self, some: np.ndarray, tokens: np.ndarray, move: np.ndarray, by_class: np.ndarray) -> np.ndarray:
        """From the states of each segment's first token to those of its last, up to a factor."""
        out = np.empty((len(some), len(move), len(move)))
        sizes = np.diff(self.first)[some]
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), _TOGETHER):
            rows = order[a : a + _TOGETHER]
            begin, left = self.first[:-1][some[rows]], sizes[rows]
            now = np.eye(len(move)) * by_class[tokens[begin]][:, None, :]
            for t in range(1, int(left[0])):
                live = int(np.searchsorted(-left, -t, "left"))
                now[:live] = (now[:live] @ move) * by_class[tokens[begin[:live] + t]][:, None, :]
                if t % _RESCALE == 0:
                    now[:live] /= now[:live].sum(axis=(1, 2))[:, None, None]
            out[rows] = now
        return out

    def _pass(self, some: np.ndarray, matrices: np.ndarray, move: np.ndarray) -> None:
        whole = lambda x: x / x.sum()
        state = None
        for k, matrix in zip(some.tolist(), matrices, strict=True):
            if not self.lead[k]:
                self.begin[k] = whole(state @ move)
            state = whole(self.begin[k] @ matrix)
        for k, matrix in zip(some[::-1].tolist(), matrices[::-1], strict=True):
            if not self.lead[k]:
                self.after[k - 1] = whole(move @ (matrix @ self.after[k].astype(float)))


class _Steps:
    """Sequences, longest first, laid out step by step: rows ``at[t]`` to ``at[t + 1]`` hold place t of all that have one."""

    def __init__(self, first: np.ndarray, chosen: np.ndarray):
        sizes = np.diff(first)[chosen]
        self.active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left").tolist()
        at = np.concatenate(([0], np.cumsum(self.active)))
        step = np.repeat(np.arange(len(self.active)), self.active)
        self.row = np.arange(at[-1]) - at[step]  # the sequence of each row
        self.token = first[:-1][chosen][self.row] + step
        self.before = at[np.maximum(step - 1, 0)] + self.row
        self.last = at[sizes - 1] + np.arange(len(chosen))
        self.at = at.tolist()


def _forward(steps: _Steps, local: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward probabilities, rescaled to sum 1 every few steps, and the factor each row was divided by."""
    at, active, ones = steps.at, steps.active, np.ones(len(move), local.dtype)  # a product with ones sums short rows faster than ``sum`` does
    out, scale = np.empty_like(local), np.ones(len(local), local.dtype)
    np.multiply(local[: active[0]], start, out=out[: active[0]])
    for t in range(1, len(active)):
        rows = out[at[t] : at[t + 1]]
        np.matmul(out[at[t - 1] : at[t - 1] + active[t]], move, out=rows)
        rows *= local[at[t] : at[t + 1]]
        if t % _RESCALE == 0:
            total = rows @ ones
            scale[at[t] : at[t + 1]] = total
            rows /= total[:, None]
    return out, scale


def _backward(steps: _Steps, local: np.ndarray, after: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Backward probabilities up to a factor of each row; ``after``: those at the end of each sequence."""
    at, active, back, ones = steps.at, steps.active, np.ascontiguousarray(move.T), np.ones(len(move), local.dtype)
    out = np.ones_like(local)
    out[steps.last] = after
    for t in range(len(active) - 1, 0, -1):
        rows = out[at[t - 1] : at[t - 1] + active[t]]
        np.matmul(local[at[t] : at[t + 1]] * out[at[t] : at[t + 1]], back, out=rows)
        if t % _RESCALE == 0:
            rows /= (rows @ ones)[:, None]
    return out


def expected_counts(tokens: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, kind: type = float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of all sequences by the scaled forward-backward recursion, and their log10 probability.

    Emissions are taken relative to the likeliest state's, so that a few steps never
    leave the range of ``kind``.
    """
    states = len(start)
    starts, moves, emissions, chance = np.zeros(states), np.zeros_like(move), np.zeros_like(emit), np.zeros(1)
    best = emit.max(axis=0)
    by_class, log_best = np.ascontiguousarray((emit / best).T, kind), np.log10(best)
    move_, ones = np.ascontiguousarray(move, kind), np.ones(states, kind)
    parts = _Segments(tokens, first, start, move, by_class)
    inner = np.flatnonzero(~parts.lead)  # segments with one before
    ends, begins = np.zeros((len(parts.of), states)) if len(inner) else None, np.zeros((len(parts.of), states)) if len(inner) else None
    for chosen in _by_length(parts.first):
        steps = _Steps(parts.first, chosen)
        word = tokens[steps.token].astype(np.intp)
        local = by_class.take(word, axis=0)
        forward, scale = _forward(steps, local, parts.begin[chosen].astype(kind), move_)
        backward = _backward(steps, local, parts.after[chosen], move_)
        chance += np.log10(forward[steps.last].sum(axis=1)).sum(dtype=float) + np.log10(scale[scale != 1]).sum(dtype=float) + log_best[word].sum()
        fresh = steps.active[0]
        if len(inner):
            ends[chosen], begins[chosen] = forward[steps.last], local[:fresh] * backward[:fresh]
        lead = parts.lead[chosen]
        for a in range(0, len(word), _BLOCK):
            rows = slice(a, a + _BLOCK)
            both = forward[rows] * backward[rows]
            whole = both @ ones
            both /= whole[:, None]
            by_state = np.ascontiguousarray(both.T, float)
            if a < fresh:
                starts += both[: fresh - a][lead[a : a + _BLOCK]].sum(axis=0)
            for s in range(states):
                emissions[s] += np.bincount(word[rows], weights=by_state[s], minlength=emit.shape[1])
            later = slice(max(a, fresh), a + _BLOCK)  # rows with one before
            onward = local[later] * backward[later] / (whole[len(whole) - len(local[later]) :] * scale[later])[:, None]
            moves += forward.take(steps.before[later], axis=0).T @ onward * move
    if len(inner):
        left, right = ends[inner - 1], begins[inner]
        moves += (left / ((left @ move) * right).sum(axis=1)[:, None]).T @ right * move
    return starts, moves, emissions, chance


def reestimated(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, move and emission probabilities of expected counts, each class also counting ``prior``."""
    whole = lambda x: x / x.sum(axis=-1, keepdims=True)
    return whole(starts + 0.5), whole(moves + 0.5), whole(emissions + prior)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    return data.view(np.int32), offsets // 4


def baum_welch(encoded: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], prior: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """One pass over all rows of ``encoded`` (classes): counts are added up within partitions, then for each state.

    The model after the pass, and the log10 probability of all rows before it.
    """
    states = len(model[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            found = expected_counts(*_unpacked(batch.column("classes")), *model, np.float32)
            sums = found if sums is None else tuple(a + b for a, b in zip(sums, found, strict=True))
        if sums is not None:
            packed = [np.concatenate([sums[0][s : s + 1], sums[1][s], sums[2][s]]).astype(np.float32).tobytes() for s in range(states)]
            yield pa.RecordBatch.from_arrays([pa.array(range(states), pa.int32()), pa.array(packed), pa.array(np.full(states, sums[3][0] / states))], ["state", "counts", "chance"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        chances: dict[int, float] = {}
        for batch in batches:
            for state, counts, chance in zip(batch.column("state").to_pylist(), batch.column("counts"), batch.column("chance").to_pylist(), strict=True):
                sums[state] = sums.get(state, 0) + np.frombuffer(counts.as_buffer(), np.float32).astype(float)
                chances[state] = chances.get(state, 0) + chance
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()), pa.array(list(chances.values()), pa.float64())], ["state", "counts", "chance"])

    kind = "state int, counts binary, chance double"
    tasks = 2 * encoded.sparkSession.sparkContext.defaultParallelism  # each sends one set of counts, however many files there are
    rows = encoded.select("classes").coalesce(tasks).mapInArrow(releasing(count), kind).repartition(states, "state").mapInArrow(add, kind).collect()  # a row for each state
    if not rows:
        return model, 0.0
    table = np.stack([np.frombuffer(r.counts) for r in sorted(rows)])
    return reestimated(table[:, 0], table[:, 1 : 1 + states], table[:, 1 + states :], prior), sum(r.chance for r in rows)


def _started(totals: np.ndarray, states: int, prior: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start values: the classes' shares of all training tokens, with seeded noise."""
    rng = np.random.default_rng(seed)
    whole = lambda x: x / x.sum(axis=-1, keepdims=True)
    return whole(np.ones(states)), whole(np.eye(states) * states + 1), whole((totals + prior) * rng.gamma(2.0, size=(states, len(totals))))


def score_documents(docs: DataFrame, states: int = STATES, passes: int = 2, rounds: int = 15, seed: int = 7, least_gain: float = 1e-3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    Learnt from the rows whose crc32 of the id as text does not divide by 10 (null
    ids are learnt from). Tokens: lower-cased (A-Z) words and one end token, the
    only token of null, empty and blank texts. base_score: log10 probability by
    smoothed word counts; score: by the hidden Markov model. All Baum-Welch passes
    cover all training rows: ``rounds`` from the start values and ``passes`` more,
    ending earlier when one gains less than ``least_gain`` a token in log10
    probability of the training rows' classes after the first third of them, as gains
    are small before the states have parted. Repeated rows count and are scored
    each. Extra columns are ignored; an empty table gives an empty result, and
    without training rows all words are unknown. Passes compute in single precision,
    scores in double.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"))
    counts = written(word_counts(rows.where(~F.col("held_out"))), "lm_counts")
    ends = F.sum(F.when(F.col("shape") < 0, F.col("count")))  # the end token's only row
    total, distinct, end_total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.coalesce(ends, F.lit(0))).first()
    word_rows = counts.where("shape >= 0")
    frequent = largest(word_rows, "count", FREQUENT).select("hash", "count").toPandas().sort_values(["count", "hash"], ascending=[False, True])  # FREQUENT rows at most
    lexicon = Lexicon(frequent["hash"].to_numpy(np.int64), frequent["count"].to_numpy(np.int64), total, distinct, end_total)
    edge = lexicon.edge
    rest = word_rows.where((F.col("count") < edge[0]) | ((F.col("count") == edge[0]) & (F.col("hash") > edge[1]))) if edge[0] else word_rows
    for r in rest.groupBy("shape").agg(F.sum("count").alias("tokens"), F.count("*").alias("words")).collect():  # SHAPES rows at most
        lexicon.shape_total[r["shape"]], lexicon.shape_words[r["shape"]] = r["tokens"], r["words"]
    shared = spark.sparkContext.broadcast(lexicon)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        for batch in batches:
            for i, j, hashes, shapes, first in _words(batch.column("text")):
                at, known = lex.find(hashes)
                end = shapes < 0
                known &= ~end
                doc = np.repeat(np.arange(j - i), np.diff(first))
                classes = np.where(end, 0, np.where(known, lex.classes[at] if len(lex.classes) else -1, -1)).astype(np.int32)
                shaped = classes < 0
                classes[shaped] = 1 + lex.own + shapes[shaped].astype(np.int32)  # beyond 16 bits from 31,744 words of their own
                c = np.where(known, lex.counts[at] if len(lex.counts) else 0, 0)
                sums = lambda where, what: np.bincount(doc[where], weights=what, minlength=j - i).astype(float)  # noqa: E731  whole numbers if empty
                rare = np.flatnonzero(~known & ~end)
                base = sums(known, lex.base(c[known])) + lex.base(np.array(lex.end_total))  # each row has one end token
                n_known = sums(known, np.ones(int(known.sum()))).astype(np.int64) + (lex.end_total > 0)
                inner_at = known & shaped
                inner = sums(inner_at, lex.inner(c[inner_at], shapes[inner_at]))
                order = rare[np.lexsort((hashes[rare], doc[rare]))]
                new = np.flatnonzero(np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])))) if len(order) else np.zeros(0, int)
                times = np.diff(np.append(new, len(order))).astype(np.int32)
                lists = np.searchsorted(doc[order[new]], np.arange(j - i + 1)).astype(np.int32)
                column = lambda values, t: pa.ListArray.from_arrays(pa.array(lists), pa.array(values, t))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(np.diff(first)), pa.array(n_known),
                        pa.array(base), pa.array(inner), pa.array([classes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                        column(hashes[order[new]], pa.int64()), column(times, pa.int32()), column(shapes[order[new]], pa.int16()),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "classes", "rare", "times", "shapes"],
                )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, inner double, classes binary, rare array<long>, times array<int>, shapes array<short>"
    encoded = written(rows.select("doc_id", "held_out", "text").mapInArrow(releasing(encode), schema).withColumn("row", F.monotonically_increasing_id()), "lm_rows")

    totals = lexicon.totals()
    prior = np.where(np.arange(len(totals)) == 0, 0.1, 0.01)
    training = encoded.where(~F.col("held_out"))
    model, before = _started(totals, states, prior, seed), -np.inf
    for k in range(rounds + passes):
        model, chance = baum_welch(training, model, prior)
        if 3 * k > rounds + passes and chance - before < least_gain * total:
            break
        before = chance

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chain = log_likelihood(*_unpacked(batch.column("classes")), *model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner")), pa.array(chain)], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "chain"])

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "classes").mapInArrow(
        releasing(score), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, inner double, chain double"
    )
    shape_sums = spark.createDataFrame([(k, float(np.log10(lexicon.shape_total[k] + SMOOTH * (lexicon.shape_words[k] + 1)))) for k in range(SHAPES)], "shape int, shape_log double")
    each = encoded.select("row", F.explode(F.arrays_zip("rare", "times", "shapes")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"), F.col("x.shapes").cast("int").alias("shape"))
    found = each.join(counts.select("hash", "count"), "hash", "left").join(F.broadcast(shape_sums), "shape")  # SHAPES rows
    logc = F.log10(F.coalesce("count", F.lit(0)) + SMOOTH)
    base_log = float(np.log10(total + SMOOTH * (distinct + 1)))
    rare = found.groupBy("row").agg(
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * (logc - base_log)).alias("rare_base"),
        F.sum(F.col("times") * (logc - F.col("shape_log"))).alias("rare_inner"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("chain") + F.col("inner") + zero("rare_inner")).alias("score"),
    )
