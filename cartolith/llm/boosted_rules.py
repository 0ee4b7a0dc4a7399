"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted by histograms of a bounded labelled sample, with monotonic
constraints on chosen features, and flattened into numpy node arrays that score
whole batches of documents at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_sample
from .memory import release
from .words import _SPACE, buffers, find_lines, find_words, hash_spans, mix, runs, slices

WINDOW, LONG = 8, 1 << 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each feature and the sign of its effect on quality: -1 never raises it, 0 free.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_a_word": -1, "dup_lines_a_line": -1, "repeated_words": -1, "equal_neighbours": -1,
    "upper_a_letter": -1, "digits_a_char": 0, "bangs_a_word": -1, "pipes_a_word": -1, "words_a_line": 0, "wide_a_char": 0, "stops_a_word": 0,
}


def _of(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_LEAD = ((np.arange(256) & 0xC0) != 0x80).astype(float)
_UPPER, _LETTER = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_KINDS = np.stack([_of("#*$%&|<>"), _LEAD, _LEAD * ~_SPACE, _UPPER, _LETTER, _of("0123456789"), _of("!"), _of("|"), (np.arange(256) >= 0xC0).astype(float), _of(".")], axis=1)


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base statistics (rows by ``BASE``, integers) and features (rows by ``FEATURES``) of whole texts."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    base, features = np.zeros((n, len(BASE)), np.int64), np.zeros((n, len(FEATURES)))
    for i, j in slices(offsets):
        text, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1 and len(text) > LONG:
            base[i], features[i] = long_statistics(text)
            continue
        docs = np.arange(j - i)
        words = find_words(text, at)
        hashes = hash_spans(text, words.starts, words.ends)
        counts = np.diff(words.first)
        bytes_ = np.stack([np.bincount(text[a:b], minlength=256) for a, b in zip(at[:-1], at[1:], strict=True)]) @ _KINDS
        symbols, _, word_chars, *_ = bytes_.T

        windows, begin = runs(hashes, words.first, WINDOW)
        owner = np.repeat(docs, np.diff(begin))
        twice = np.flatnonzero(_again(mix(windows ^ mix(owner.astype(np.uint64)))))
        place = words.first[owner[twice]] + twice - begin[owner[twice]]
        cover = np.zeros(len(hashes) + 1, np.int64)
        cover[place] += 1
        cover[place + WINDOW] -= 1  # a run that occurs twice is WINDOW words long, as shorter texts have one run
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        repeated = np.diff(covered[words.first])

        lines = find_lines(text, at)
        worded = np.searchsorted(words.starts, lines.starts) < np.searchsorted(words.starts, lines.ends)
        line_doc = np.repeat(docs, np.diff(lines.first))[worded]
        line_keys = mix(hash_spans(text, lines.starts[worded], lines.ends[worded]) ^ mix(line_doc.astype(np.uint64)))
        first_seen = np.unique(line_keys, return_index=True)[1]
        worded_lines = np.bincount(line_doc, minlength=j - i)
        dup_lines = worded_lines - np.bincount(line_doc[first_seen], minlength=j - i)

        word_doc = np.repeat(docs, counts)
        equal = np.bincount(word_doc[1:][(hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])], minlength=j - i)
        base[i:j] = np.stack([counts, word_chars, symbols, dup_lines, repeated], axis=1)
        features[i:j] = _features(counts, repeated, dup_lines, worded_lines, equal, bytes_)
    return base, features


def _features(counts: np.ndarray, repeated: np.ndarray, dup_lines: np.ndarray, worded_lines: np.ndarray, equal: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    symbols, chars, word_chars, upper, letters, digits, bangs, pipes, wide, stops = bytes_.T
    some, some_lines = np.maximum(counts, 1), np.maximum(worded_lines, 1)
    return np.stack(
        [np.log1p(counts), word_chars / some, symbols / some, dup_lines / some_lines, repeated / some, equal / some,
         upper / np.maximum(letters, 1), digits / np.maximum(chars, 1), bangs / some, pipes / some, counts / some_lines, wide / np.maximum(chars, 1), stops / some],
        axis=1,
    )


def _blocks(text: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes that end after white space, or longer ones where a word is."""
    a = 0
    while a < len(text):
        b = min(a + size, len(text))
        while b < len(text) and not _SPACE[text[b - 1]]:
            gap = np.flatnonzero(_SPACE[text[b : b + size]])
            b = b + int(gap[0]) + 1 if len(gap) else min(b + size, len(text))
        yield a, b
        a = b


def long_statistics(text: np.ndarray, size: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """``statistics`` of one text, block by block: of the whole text only a hash of each window and of each worded line is held."""
    n_bytes, windows, lines = np.zeros(256, np.int64), [], []
    n_words, equal, last = 0, 0, np.zeros(0, np.uint64)
    begin, worded = 0, False  # of the line that is open
    for a, b in _blocks(text, size):
        part = text[a:b]
        n_bytes += np.bincount(part, minlength=256)
        words = find_words(part, np.array([0, b - a]))
        hashes = hash_spans(text, words.starts + a, words.ends + a)
        n_words += len(hashes)
        held = np.concatenate([last, hashes])
        equal += int((held[1:] == held[:-1])[max(len(last) - 1, 0) :].sum())
        if len(held) >= WINDOW:
            windows.append(runs(held, np.array([0, len(held)]), WINDOW)[0])
        last = held[-(WINDOW - 1) :]
        ends = np.flatnonzero(part == 10) + a
        if b == len(text):
            ends = np.append(ends, b)
        starts = np.concatenate(([begin], ends[:-1] + 1)) if len(ends) else ends
        has = np.searchsorted(words.starts + a, starts) < np.searchsorted(words.starts + a, ends)
        if len(ends):
            has[0] |= worded
            lines.append(hash_spans(text, starts[has], ends[has]))
            begin, worded = int(ends[-1]) + 1, bool(len(words.starts) and words.starts[-1] + a > ends[-1])
        else:
            worded |= len(words.starts) > 0
    found = np.concatenate(lines) if lines else np.zeros(0, np.uint64)
    found.sort()
    n_lines, n_dup = len(found), int((found[1:] == found[:-1]).sum())
    several = np.concatenate(windows) if windows else np.zeros(0, np.uint64)
    del found, lines
    several.sort()
    several = several[1:][several[1:] == several[:-1]]  # windows found twice or more
    several = several[np.concatenate((several[1:] != several[:-1], [True]))[: len(several)]]
    repeated, carried = 0, 0  # words covered; how many words more the last such window covers
    for part in windows:
        at = np.minimum(np.searchsorted(several, part), max(len(several) - 1, 0))
        twice = several[at] == part if len(several) else np.zeros(len(part), bool)
        reach = np.where(twice, np.arange(len(part)) + WINDOW, carried)
        reach = np.maximum.accumulate(np.maximum(reach, carried)) if len(part) else reach
        repeated += int((reach > np.arange(len(part))).sum())
        carried = max(0, int(reach[-1]) - len(part)) if len(part) else carried
    repeated += min(carried, WINDOW - 1) if windows else 0  # the words after the last window's first
    kinds = (n_bytes @ _KINDS)[None, :]
    row = lambda x: np.array([x])
    features = _features(row(n_words), row(repeated), row(n_dup), row(n_lines), row(equal), kinds)
    return np.array([n_words, kinds[0, 2], kinds[0, 0], n_dup, repeated]), features[0]


class Trees(NamedTuple):
    """Nodes of all trees in flat arrays; a leaf's feature is 0, its threshold infinite and its children itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss; splits that would break a feature's sign are not taken.

    Below a split on a signed feature both sides keep to their side of the mean of
    the two leaf values, so the whole tree is monotonic in it.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    p = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        for column, item in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, v)):
            column.append(item)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        best_of = lambda gs, hs: np.clip(-gs / (hs + ridge), low, high)
        gain_of = lambda gs, hs, v: -(gs * v + 0.5 * (hs + ridge) * v * v)
        gs, hs = g[rows].sum(), h[rows].sum()
        here = float(best_of(gs, hs))
        node = leaf(here * rate)
        if level == 0 or len(rows) < 2 * least:
            return node
        best = (1e-6, None)
        for f, cut in enumerate(cuts):
            if len(cut) == 0:
                continue
            b = binned[rows, f]
            gl, hl = (np.cumsum(np.bincount(b, weights=v[rows], minlength=len(cut) + 1))[:-1] for v in (g, h))
            nl = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
            vl, vr = best_of(gl, hl), best_of(gs - gl, hs - hl)
            gain = gain_of(gl, hl, vl) + gain_of(gs - gl, hs - hl, vr) - gain_of(gs, hs, here)
            gain[(nl < least) | (len(rows) - nl < least) | (signs[f] * (vr - vl) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return node
        f, k, vl, vr = best[1]
        middle = (vl + vr) / 2
        to_left = binned[rows, f] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs[f], ((low, high), (low, high)))
        feature[node], threshold[node] = f, cuts[f][k]
        left[node] = grow(rows[to_left], g, h, level - 1, *bounds[0])
        right[node] = grow(rows[~to_left], g, h, level - 1, *bounds[1])
        return node

    total = np.full(len(y), start)
    everything = np.arange(len(y))
    for _ in range(trees if len(y) else 0):
        q = 1 / (1 + np.exp(-total))
        roots.append(grow(everything, q - y, np.maximum(q * (1 - q), 1e-6), depth, -8.0, 8.0))
        node = np.full(len(y), roots[-1])
        for _ in range(depth):
            at = np.array(feature)[node]
            node = np.where(x[everything, at] <= np.array(threshold)[node], np.array(left)[node], np.array(right)[node])
        total += np.array(value)[node]
    return Trees(np.array(roots, int), np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int), np.array(value, float), depth, start)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Trees:
    """Trees fitted on at most ``per_class`` labelled ids of ``docs`` of each class; the constant 1 without labels of both classes.

    After another stage that rejects poor documents, the bad ids are only those it
    let through, however few.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = training_sample(docs, labels, "quality", per_class).mapInArrow(measured, f"doc_id {kind}, label int, x array<double>")
    rows = sample.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("row")).orderBy("doc_id").select("row.*").collect()  # 2 * per_class rows at most
    x, y = np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], float)
    if len(set(y.tolist())) < 2:
        x, y = x[:0], y[:0]
        return fit(x, y, list(FEATURES.values()))._replace(start=20.0)
    return fit(x, y, list(FEATURES.values()))


def judger(trees: Trees, least_words: int, most_repeated: int, threshold: float) -> Callable:
    """A column function from texts to their statistics and verdict."""

    @F.arrow_udf(", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            base, x = statistics(text)
            score = trees.score(x)
            failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeated * base[:, 0])
            columns = [*(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            yield pa.StructArray.from_arrays(columns, [*BASE, "base_failed", "score", "kept"])
        release()

    return judged


def judge(docs: DataFrame, labels: DataFrame, least_words: int = 20, most_repeated: int = 30, threshold: float = 0.3, per_class: int = 2000, training: DataFrame | None = None) -> DataFrame:
    """doc_id, the statistics of ``BASE``, base_failed, score and kept of each row of ``docs`` (doc_id, text).

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated``
    per cent of them in repeated 8-word windows. kept: not base_failed and the
    trees' score is at least ``threshold``. Null and empty texts have 0 words and
    so fail. Repeated rows and null ids are judged like others; without labels of
    both classes the base rules alone decide. The trees are fitted on the labelled
    rows of ``training``, or of ``docs`` if that is None. Extra columns are ignored;
    an empty table gives an empty result.
    """
    judged = judger(learn(docs if training is None else training, labels, per_class), least_words, most_repeated, threshold)
    return docs.select("doc_id", judged(F.col("text")).alias("judged")).select("doc_id", "judged.*")


def reject_rule_breakers(
    docs: DataFrame, labels: DataFrame, least_words: int = 20, most_repeated: int = 30, threshold: float = 0.3, per_class: int = 2000, training: DataFrame | None = None
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps."""
    return docs.where(judger(learn(docs if training is None else training, labels, per_class), least_words, most_repeated, threshold)(F.col("text"))["kept"])
