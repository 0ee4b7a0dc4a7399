"""Quality classifier: a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own and its neighbours' features and
from the label beside it; the marginals of forward-backward, weighted by line
length, make the document's score. The field is fitted on a bounded sample of
labelled documents whose lines all carry their document's label.

A line's features are numbers of its own; its log potential adds three products
with them, one for itself and one for each neighbour, so long texts go block by
block and keep 8 bytes a line. Chains of many lines are cut into segments whose
2 x 2 transfer matrices are built side by side; forward-backward then runs over
the segments and, from their ends, inside all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_sample
from .memory import release
from .words import SLICE_BYTES, buffers, find_lines, find_words, hash_spans, mix, slices

_CLASSES = ("#*$%&<>", "|", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789")
_TABLES = [np.isin(np.arange(256), [ord(c) for c in chars]) for chars in _CLASSES]
OWN = 18
WIDTH = 3 * OWN + 3  # weights of the own, the previous and the next line's features, of first and last lines, and a constant
LONG_CHAIN = 4096
_SEGMENTS, _ROWS = 512, 1 << 16


def own_features(text: np.ndarray, at: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, bytes of each line, the first line of each document, and hashes of the lines.

    ``seen``: sorted hashes of the lines of the document that come before ``text``.
    """
    lines, words = find_lines(text, at), find_words(text, at)
    hashes = hash_spans(text, words.starts, words.ends, lower=True)
    size = lines.ends - lines.starts
    symbols, pipes, bangs, upper, letters, digits = (
        (lambda sums: (sums[lines.ends] - sums[lines.starts]).astype(float))(np.concatenate(([0], np.cumsum(table[text], dtype=np.int32)))) for table in _TABLES
    )
    lo, hi = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    n = (hi - lo).astype(float)
    equal = np.zeros(len(hashes) + 1, np.int64)
    equal[1:-1] = np.cumsum(hashes[1:] == hashes[:-1]) if len(hashes) else 0
    if len(hashes):
        equal[-1] = equal[-2]
    same = np.where(n > 1, equal[np.maximum(hi - 1, 0)] - equal[np.minimum(lo, len(hashes))], 0).astype(float)
    some = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(lines.first))
    line_hashes = hash_spans(text, lines.starts, lines.ends)
    keys = mix(line_hashes ^ mix(doc.astype(np.uint64)))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    if seen is not None and len(seen):
        again |= seen[np.minimum(np.searchsorted(seen, line_hashes), len(seen) - 1)] == line_hashes
    last = np.where(size > 0, text[np.maximum(lines.ends - 1, 0)] if len(text) else 0, 0)
    shout = upper / np.maximum(letters, 1)
    columns = (
        np.minimum(symbols / some, 2), np.minimum(pipes / some, 1), np.minimum(bangs / some, 2), shout, digits / np.maximum(size, 1), same / some,
        np.log1p(n) / 5, np.minimum(size / some / 10, 3), again & (n > 0), n == 0, np.isin(last, [46, 33, 63]), symbols > 0,
        pipes > 0, bangs > 0, shout > 0.5, same / some > 0.3, symbols / some > 0.3, n < 3,
    )
    own = np.empty((len(size), OWN), np.float32)
    for k, column in enumerate(columns):
        own[:, k] = column
    return own, size, lines.first, line_hashes


def _ends(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is the first, and the last, of its document."""
    top, bottom = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    top[first[:-1]], bottom[first[1:] - 1] = True, True
    return top, bottom


def _products(own: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Products of all lines' features with the weights for the line itself, the one after it and the one before it."""
    table = weights[: 3 * OWN].reshape(3, OWN).T
    return np.concatenate([own[a : a + _ROWS].astype(float) @ table for a in range(0, max(len(own), 1), _ROWS)])


def line_odds(own: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log potential of label 1 against label 0 of each line."""
    top, bottom = _ends(first)
    products = _products(own, weights)
    odds = products[:, 0] + weights[3 * OWN] * top + weights[3 * OWN + 1] * bottom + weights[3 * OWN + 2]
    odds[1:] += np.where(top[1:], 0, products[:-1, 1])
    odds[:-1] += np.where(bottom[:-1], 0, products[1:, 2])
    return odds


def _blocks(text: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole lines of about ``SLICE_BYTES``, or of one longer line, without the newline that ends them."""
    a, n = 0, len(text)
    while a <= n:
        b = n
        if a + SLICE_BYTES < n:
            breaks = np.flatnonzero(text[a : a + SLICE_BYTES] == 10)
            b = a + int(breaks[-1]) if len(breaks) else -1
            at = a + SLICE_BYTES
            while b < 0:
                breaks = np.flatnonzero(text[at : at + SLICE_BYTES] == 10)
                at += SLICE_BYTES
                b = at - SLICE_BYTES + int(breaks[0]) if len(breaks) else n if at >= n else -1
        yield a, b
        a = b + 1


def long_text_odds(text: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``line_odds`` and line sizes of one text, block by block."""
    n = int((text == 10).sum()) + 1
    odds, sizes = np.empty(n, np.float32), np.empty(n, np.int32)
    at, seen, before = 0, np.zeros(0, np.uint64), 0.0
    for a, b in _blocks(text):
        own, size, _, hashes = own_features(text[a:b], np.array([0, b - a]), seen)
        seen = np.union1d(seen, hashes)
        products = _products(own, weights)
        rows = products[:, 0] + weights[3 * OWN + 2]
        rows[1:] += products[:-1, 1]
        rows[:-1] += products[1:, 2]
        rows[0] += before
        if at:
            odds[at - 1] += products[0, 2]
        odds[at : at + len(rows)], sizes[at : at + len(rows)] = rows, size
        at, before = at + len(rows), products[-1, 1]
    odds[0] += weights[3 * OWN]
    odds[-1] += weights[3 * OWN + 1]
    return odds, sizes


def _local(odds: np.ndarray) -> np.ndarray:
    half = np.clip(odds.astype(float), -40, 40) / 2
    return np.exp(np.stack([-half, half], axis=1))


def long_chain_mean(odds: np.ndarray, weight: np.ndarray, step: np.ndarray) -> float:
    """Mean of one chain's marginals of label 1 by ``weight``, as ``chains`` gives them, with the root of its length in steps."""
    n, move = len(odds), np.exp(step)
    length = int(np.ceil(np.sqrt(n)))
    segments = -(-n // length)  # the last may be shorter: it has no row t where odds[t::length] ends earlier
    whole = np.tile(np.eye(2), (segments, 1, 1))
    for t in range(length):
        local = _local(odds[t::length])
        k = len(local)
        moved = (whole[:k].reshape(-1, 2) @ move).reshape(-1, 2, 2)
        if t == 0:
            moved[0] = np.eye(2)  # no label before the first line
        whole[:k] = moved * local[:, None, :]
        if t % 8 == 7:
            whole /= whole.sum(axis=(1, 2), keepdims=True)
    before, after = np.ones((segments, 2)), np.ones((segments, 2))
    for j in range(1, segments):
        row = before[j - 1] @ whole[j - 1]
        before[j] = row / row.sum()
        k = segments - j
        row = whole[k] @ after[k]
        after[k - 1] = row / row.sum()
    total = 0.0
    for a in range(0, segments, _SEGMENTS):
        b = min(a + _SEGMENTS, segments)
        forward, state = np.zeros((length, b - a, 2)), before[a:b].copy()
        for t in range(length):
            local = _local(odds[t::length][a:b])
            k = len(local)
            moved = state[:k] @ move
            if a == 0 and t == 0:
                moved[0] = 1
            moved *= local
            state[:k] = moved / moved.sum(axis=1, keepdims=True)
            forward[t, :k] = state[:k]
        state = after[a:b].copy()
        for t in range(length - 1, -1, -1):
            local = _local(odds[t::length][a:b])
            k = len(local)
            both = forward[t, :k] * state[:k]
            total += float((both[:, 1] / both.sum(axis=1)) @ weight[t::length][a:b])
            moved = (local * state[:k]) @ move.T
            state[:k] = moved / moved.sum(axis=1, keepdims=True)
    return total / float(weight.sum(dtype=float))


def chains(odds: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 at each line, log partition function of each chain, and expected label pairs of each chain.

    odds: log potential of label 1 against label 0 of each line; step: log
    potentials of (label, next label). All chains advance together, line by line,
    the longest ones longest.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    starts, sizes = first[:-1][order], counts[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # chains with more lines than t
    clipped = np.clip(odds, -40, 40) / 2
    local = np.exp(np.stack([-clipped, clipped], axis=1))
    move = np.exp(step)
    forward, scale = np.empty_like(local), np.empty(len(odds))
    for t, k in enumerate(active):
        rows = starts[:k] + t
        a = local[rows] if t == 0 else (forward[rows - 1] @ move) * local[rows]
        s = a.sum(axis=1)
        forward[rows], scale[rows] = a / s[:, None], s
    marginal, pairs = np.empty(len(odds)), np.zeros((len(counts), 2, 2))
    backward = np.ones((len(counts), 2))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        rows = starts[:k] + t
        both = forward[rows] * backward[:k]
        marginal[rows] = both[:, 1] / both.sum(axis=1)
        if t:
            onward = local[rows] * backward[:k] / scale[rows][:, None]
            pairs[order[:k]] += forward[rows - 1][:, :, None] * move * onward[:, None, :]
            backward[:k] = onward @ move.T
    logz = np.add.reduceat(np.log(scale), first[:-1]) if len(counts) else np.zeros(0)
    return marginal, logz, pairs


def maximise(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """A maximum of a smooth concave function by limited-memory quasi-Newton steps with halving."""
    value, slope = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        size = 1.0 if past else 1 / max(1e-9, np.linalg.norm(slope))
        while size > 1e-8:
            new = x + size * q
            new_value, new_slope = value_and_slope(new)
            if new_value >= value + 1e-4 * size * (q @ slope):
                break
            size /= 2
        else:
            break
        s, y = new - x, slope - new_slope
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        done = new_value - value < 1e-7 * abs(value)
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def fit(own: np.ndarray, first: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the features, then the four label-pair potentials, by penalised likelihood; each document weighs the same."""
    counts = np.diff(first)
    weight = np.sqrt(1 / counts)
    y, w = np.repeat(label, counts), np.repeat(weight, counts)
    top, bottom = _ends(first)
    seen = np.zeros((len(counts), 2, 2))
    seen[np.arange(len(counts)), label.astype(int), label.astype(int)] = counts - 1

    def slope_of(x: np.ndarray) -> tuple[float, np.ndarray]:
        odds = line_odds(own, first, x[:WIDTH])
        clipped = np.clip(odds, -40, 40)
        marginal, logz, pairs = chains(odds, first, x[WIDTH:].reshape(2, 2))
        right = np.add.reduceat(np.where(y == 1, clipped, -clipped) / 2, first[:-1]) + (seen * x[WIDTH:].reshape(2, 2)).sum(axis=(1, 2))
        n = len(counts)
        value = (weight * (right - logz)).sum() / n - ridge * (x @ x)
        left = w * (y - marginal)  # of each line; a line's features also act on the lines after and before it
        acts = np.stack([left, np.where(bottom, 0, np.append(left[1:], 0)), np.where(top, 0, np.append(0, left[:-1]))])
        by_feature = sum(acts[:, a : a + _ROWS] @ own[a : a + _ROWS].astype(float) for a in range(0, len(own), _ROWS))
        slope = np.concatenate([by_feature.ravel(), [left[top].sum(), left[bottom].sum(), left.sum()], ((seen - pairs) * weight[:, None, None]).sum(axis=0).ravel()]) / n - 2 * ridge * x
        return float(value), slope

    return maximise(slope_of, np.zeros(WIDTH + 4))


def score_texts(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of each text; an empty text is one empty line."""
    data, offsets = buffers(column)
    step = weights[WIDTH:].reshape(2, 2)
    out = np.empty(len(offsets) - 1)
    for i, j in slices(offsets):
        text, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(text) > SLICE_BYTES:  # one long row
            odds, size = long_text_odds(text, weights)
            out[i] = long_chain_mean(odds, size + 1, step) if len(odds) > LONG_CHAIN else _means(odds, size, np.array([0, len(odds)]), step)[0]
            continue
        own, size, first, _ = own_features(text, at)
        odds, counts = line_odds(own, first, weights), np.diff(first)
        few = np.repeat(counts <= LONG_CHAIN, counts)
        out[i:j][counts <= LONG_CHAIN] = _means(odds[few], size[few], np.concatenate(([0], np.cumsum(counts[counts <= LONG_CHAIN]))), step)
        for k in np.flatnonzero(counts > LONG_CHAIN):
            rows = slice(first[k], first[k + 1])
            out[i + k] = long_chain_mean(odds[rows], size[rows] + 1, step)
    return np.clip(out, 0, 1)


def _means(odds: np.ndarray, size: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    if len(first) < 2:
        return np.zeros(0)
    marginal = chains(odds, first, step)[0]
    return np.add.reduceat(marginal * (size + 1), first[:-1]) / np.add.reduceat(size + 1, first[:-1])


def scorer(weights: np.ndarray) -> Callable:
    """A column function from texts to scores."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array(score_texts(text, weights))
        release()

    return score


def _window(text: np.ndarray, draw: int, most_lines: int) -> np.ndarray:
    """The text, or of one with more lines a run of ``most_lines`` that begins at a place drawn from all."""
    breaks = np.flatnonzero(text == 10)
    if len(breaks) < most_lines:
        return text
    k = draw % (len(breaks) + 2 - most_lines)
    return text[breaks[k - 1] + 1 if k else 0 : breaks[k + most_lines - 1] if k + most_lines <= len(breaks) else len(text)]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_lines: int = 400) -> np.ndarray:
    """Weights fitted on at most ``per_class`` labelled ids of each class, whatever their length.

    Of a text of more than ``most_lines`` lines that many consecutive ones are taken,
    from a place drawn by its id, so the driver gets at most 2 * per_class *
    most_lines rows of 72 bytes: 86 MB by default.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            packed = []
            for k, draw in enumerate(batch.column("draw").to_pylist()):
                text = _window(data[offsets[k] : offsets[k + 1]], draw, most_lines)
                packed.append(own_features(text, np.array([0, len(text)]))[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = training_sample(docs, labels, "quality", per_class).withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    rows = drawn.mapInArrow(measured, f"doc_id {kind}, label int, x binary").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("row")).orderBy("doc_id").select("row.*").collect()
    if len({r.label for r in rows}) < 2:
        return np.zeros(WIDTH + 4)
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, OWN) for r in rows]
    first, label = np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.array([r.label for r in rows], float)
    own = np.concatenate(parts)
    del rows, parts
    return fit(own, first, label)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500, most_lines: int = 400) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text).

    Learnt from ``labels`` (doc_id, quality) alone, never from ids that are held
    out. score: 0 to 1, higher for better texts; null and empty texts are one
    empty line and score like it. Without labels of both classes every score is
    0.5. Repeated rows and null ids are scored like others. Extra columns are
    ignored; an empty table gives an empty result.
    """
    score = scorer(learn(docs, labels, per_class, most_lines))(F.col("text"))
    scored = docs.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500, most_lines: int = 400) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify`` predicts as 1."""
    return docs.where(scorer(learn(docs, labels, per_class, most_lines))(F.col("text")) >= threshold)
