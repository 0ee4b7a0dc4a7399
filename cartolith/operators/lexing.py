"""Lexical state and token patterns of source text, by finite automata run data-parallel.

A run of an automaton over n symbols is a product of n functions on its states. The
symbols are cut into blocks; the blocks' products are formed side by side, carried
from block to block, and the states inside all blocks follow side by side again. So
neither a byte nor a token costs a Python step.

* ``lexed_words`` tells of each word whether it stands in code, in a comment or in a
  string.
* ``matched_references`` finds names by rows of token patterns with context on both
  sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..functions import config

CODE, NESTED = "code", 4
_SLICE = 1 << 18
_IDENTIFIER = np.zeros(256, bool)
_IDENTIFIER[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)]] = True
_LETTER = _IDENTIFIER.copy()
_LETTER[0x30:0x3A] = False
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points


class Region(NamedTuple):
    """A stretch of text that is no code: from ``open`` to ``close``, or to the line's end if that is empty or it isn't ``multiline``."""

    kind: str
    open: str
    close: str = ""
    escape: str = ""
    multiline: bool = False
    nested: bool = False  # counted up to NESTED levels


_STRINGS = (Region("string", '"', '"', "\\"), Region("string", "'", "'", "\\"))
_COMMENTS = (Region("comment", "//"), Region("comment", "/*", "*/", multiline=True))
#: Regions of each language; of Rust a quote may begin a lifetime, so single quotes are code there.
REGIONS: dict[str, tuple[Region, ...]] = {
    "python": (Region("comment", "#"), Region("string", '"""', '"""', "\\", True), Region("string", "'''", "'''", "\\", True), *_STRINGS),
    "java": (*_COMMENTS, Region("string", '"""', '"""', "\\", True), *_STRINGS),
    "scala": (*_COMMENTS, Region("string", '"""', '"""', "", True), *_STRINGS),
    "rust": (_COMMENTS[0], Region("comment", "/*", "*/", multiline=True, nested=True), Region("string", '"', '"', "\\", True)),
}


def states_before(symbols: np.ndarray, table: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The state before each symbol of an automaton with ``table[symbol, state]``; it starts in state 0, and anew where ``fresh``."""
    n, states = len(symbols), table.shape[1]
    if n == 0:
        return np.zeros(0, np.int64)
    kinds = len(table)
    flat = np.concatenate([table, np.repeat(table[:, :1], states, axis=1)]).astype(np.int32).ravel()  # after a fresh start all states go where 0 does
    wide = max(16, int(n**0.5))
    blocks = -(-n // wide)
    padded = np.zeros(blocks * wide, np.int64)
    padded[:n] = (symbols + kinds * fresh.astype(np.int64)) * states
    steps = np.ascontiguousarray(padded.reshape(blocks, wide).T)
    product = np.tile(np.arange(states, dtype=np.int32), (blocks, 1))
    for step in steps:
        product = flat[step[:, None] + product]
    start = np.zeros(blocks, np.int64)
    for k in range(1, blocks):
        start[k] = product[k - 1, start[k - 1]]
    out = np.empty((wide, blocks), np.int32)
    for k, step in enumerate(steps):
        out[k] = start
        start = flat[step + start]
    found = out.T.ravel()[:n].astype(np.int64)
    found[fresh] = 0
    return found


class Lexer:
    """The automaton of a language's regions over the delimiters that begin at each byte."""

    def __init__(self, regions: Sequence[Region]):
        self.kinds = [CODE, *dict.fromkeys(r.kind for r in regions)]
        self.marks = list(dict.fromkeys([b"\n", *(x.encode() for r in regions for x in (r.open, r.close, r.escape) if x)]))
        self.bit = {m: 1 << k for k, m in enumerate(self.marks)}
        self.longest = max(map(len, self.marks))
        by_length = sorted(range(len(regions)), key=lambda k: -len(regions[k].open))
        bit = lambda x: self.bit[x.encode()] if x else 0
        numbers: dict[tuple, int] = {("code",): 0}
        todo, rows = [("code",)], []

        def enter(k: int, level: int) -> tuple:
            more = len(regions[k].open.encode()) - 1
            return ("in", k, level, more) if more else ("body", k, level)

        def leave(k: int, level: int) -> tuple:
            more = len(regions[k].close.encode()) - 1
            return ("out", k, level, more) if more else above(k, level)

        def above(k: int, level: int) -> tuple:
            return ("body", k, level - 1) if level > 1 else ("code",)

        def go(state: tuple, mask: int) -> tuple[tuple, str]:
            """The next state, and the kind of the byte between."""
            if state[0] == "code":
                k = next((k for k in by_length if mask & bit(regions[k].open)), None)
                return (state, CODE) if k is None else (enter(k, 1), regions[k].kind)
            _, k, level, *more = state
            r = regions[k]
            if state[0] == "body":
                if mask & bit(r.escape):
                    return ("skip", k, level), r.kind
                if mask & bit(r.close):
                    return leave(k, level), r.kind
                if r.nested and level < NESTED and mask & bit(r.open):
                    return enter(k, level + 1), r.kind
                if mask & self.bit[b"\n"] and not r.multiline:
                    return ("code",), CODE
                return state, r.kind
            if state[0] == "skip":
                return ("body", k, level), r.kind
            after = ("body", k, level) if state[0] == "in" else above(k, level)
            return (after if more[0] == 1 else (state[0], k, level, more[0] - 1)), r.kind

        self.masks = range(1 << len(self.marks))
        while todo:
            row = []
            for mask in self.masks:
                to, kind = go(todo[0], mask)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row.append((numbers[to], self.kinds.index(kind)))
            rows.append(row)
            todo.pop(0)
        both = np.array(rows)  # by state and mask
        self.table, self.kind = both[:, :, 0].T, both[:, :, 1].T

    def kinds_at(self, data: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Index of the kind of the bytes at ascending ``places`` of texts that lie end to end in ``data``."""
        n = len(data)
        mask = np.zeros(n, np.int64)
        for mark in self.marks:
            hit = np.ones(n, bool)
            for k, byte in enumerate(mark):
                hit[: n - k] &= data[k:] == byte
                hit[n - k :] = False
            mask[hit] |= self.bit[mark]
            for k in range(1, len(mark)):  # none goes over a text's end
                over = offsets[1:][offsets[1:] >= k] - k
                wrong = over[hit[over]] if n else over
                mask[wrong] &= ~self.bit[mark]
        near = mask > 0
        used = near.copy()
        for k in range(1, self.longest + 1):  # whatever a delimiter or an escape began has ended some bytes on
            used[k:] |= near[: n - k]
        fresh = np.zeros(n + 1, bool)
        fresh[offsets[:-1]] = True
        used |= fresh[:n]
        at = np.flatnonzero(used)
        before = states_before(mask[at], self.table, fresh[at])
        after = self.table[mask[at], before]
        last = np.searchsorted(at, places, "right") - 1
        here = at[last] == places if len(at) else np.zeros(len(places), bool)
        state = np.where(here, before[last], after[last]) if len(at) else np.zeros(len(places), np.int64)
        return self.kind[mask[places], state]


class Texts:
    """The bytes of a column of texts, and where their lines and code points are."""

    def __init__(self, column: pa.Array):
        content = column.fill_null("").cast(pa.large_string())
        _, offsets, data = content.buffers()
        offsets = np.frombuffer(offsets, np.int64)[content.offset : content.offset + len(content) + 1]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.edge = np.zeros(len(self.data) + 1, bool)
        self.edge[self.offsets] = True
        next_ = np.concatenate((self.data[1:], np.zeros(min(1, len(self.data)), np.uint8)))
        self.breaks = np.flatnonzero((self.data == 10) | ((self.data == 13) & ~((next_ == 10) & ~self.edge[1:])))
        self.points = np.concatenate(([0], np.cumsum(_LEAD[self.data])))

    def located(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, line and column (in code points) of bytes."""
        text = np.searchsorted(self.offsets, at, "right") - 1
        first = np.searchsorted(self.breaks, self.offsets[:-1])
        line = np.searchsorted(self.breaks, at) - first[text]
        begin = np.where(line > 0, self.breaks[np.maximum(first[text] + line - 1, 0)] + 1 if len(self.breaks) else 0, self.offsets[:-1][text])
        return text, line, self.points[at] - self.points[begin]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each run of letters, digits and underscores, and of each other sign that is no space."""
        data, n = self.data, len(self.data)
        name = _IDENTIFIER[data]
        sign = ~name & ~_SPACE[data] & _LEAD[data]
        begin = (name & (self.edge[:n] | ~np.concatenate(([False], name[:-1])))) if n else name
        last = (name & (self.edge[1:] | ~np.concatenate((name[1:], [False])))) if n else name
        starts = np.flatnonzero(begin | sign)
        width = np.ones(len(starts), np.int64)
        width[begin[starts]] = np.flatnonzero(last) + 1 - starts[begin[starts]]
        wide = ~begin[starts] & (data[starts] >= 0xC0)
        width[wide] = np.where(data[starts[wide]] >= 0xF0, 4, np.where(data[starts[wide]] >= 0xE0, 3, 2))
        return starts, starts + width

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The spans as strings; none overlaps another."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        data = np.ascontiguousarray(self.data[np.cumsum(inside[:-1]) > 0])
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def sliced(batches: Iterator[pa.RecordBatch], language: str = "language") -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of one language, about ``_SLICE`` bytes of them at a time, or one longer text."""
    for batch in batches:
        names = batch.column(language)
        for name in pc.unique(names).to_pylist():
            if name is None:
                continue
            rows = batch.filter(pc.equal(names, name))
            sizes = np.array([s or 0 for s in pc.binary_length(rows.column("content")).to_pylist()], np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE, prepend=0))
            for a, b in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
                if b > a:
                    yield name, rows.slice(a, b - a)


def lexed_words(files: DataFrame, regions: Mapping[str, Sequence[Region]] = REGIONS, keep: Sequence[str] = ()) -> DataFrame:
    """R1 with lexical state: path, ``keep``, language, line, col, end_col, text and kind (code, comment, string) of every word.

    Words are of letters and underscores, as those of ``extract_leaves``; files of a
    language without regions are left out.
    """
    names = ["path", *keep, "language"]
    lexers = {language: Lexer(r) for language, r in regions.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, rows in sliced(batches):
            if language not in lexers:
                continue
            lexer, texts = lexers[language], Texts(rows.column("content"))
            letter = _LETTER[texts.data]
            n = len(letter)
            starts = np.flatnonzero(letter & (texts.edge[:n] | ~np.concatenate(([False], letter[:-1]))) if n else letter)
            ends = np.flatnonzero(letter & (texts.edge[1:] | ~np.concatenate((letter[1:], [False]))) if n else letter) + 1
            kind = lexer.kinds_at(texts.data, texts.offsets, starts)
            row, line, col = texts.located(starts)
            int32 = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c).take(pa.array(row)) for c in names), int32(line), int32(col), int32(col + ends - starts), texts.strings(starts, ends), pa.array(lexer.kinds).take(pa.array(kind))],
                [*names, "line", "col", "end_col", "text", "kind"],
            )

    return files.select(*names, "content").mapInArrow(find, ", ".join(f"{c} string" for c in names) + ", line int, col int, end_col int, text string, kind string")


class Pattern(NamedTuple):
    """What stands right before and right after a name, and what that makes of it.

    Items are tokens; ``%word`` is any name that is no stop-word, ``%any`` any token,
    and ``%{`` … ``%}*`` any number of repetitions. role: ``reference``, or ``skip``
    for names that no reference row may take.
    """

    language: str
    role: str
    name: str
    left: tuple[str, ...] = ()
    right: tuple[str, ...] = ()


_DEFINED = tuple(Pattern(language, "skip", "definition", (word,)) for language, words in config.DEFINING_WORDS.items() for word in words if word != "impl")
_LIST, _DOTTED = ("%{", "%word", ",", "%}*"), ("%{", "%word", ".", "%}*")
PATTERNS = (
    *_DEFINED,
    Pattern("java", "skip", "declaration", ("%word",), ("(",)), Pattern("java", "skip", "declaration", (">",), ("(",)), Pattern("java", "skip", "declaration", ("]",), ("(",)),
    Pattern("java", "reference", "new", ("new", *_DOTTED)), Pattern("java", "reference", "extends", ("extends", *_DOTTED)), Pattern("java", "reference", "implements", ("implements", *_LIST)), Pattern("java", "reference", "call", (), ("(",)),
    Pattern("scala", "reference", "new", ("new", *_DOTTED)), Pattern("scala", "reference", "extends", ("extends", *_DOTTED)), Pattern("scala", "reference", "extends", ("with",)), Pattern("scala", "reference", "call", (), ("(",)),
    Pattern("rust", "reference", "macro", (), ("!", "(")), Pattern("rust", "reference", "macro", (), ("!", "[")), Pattern("rust", "reference", "macro", (), ("!", "{")),
    Pattern("rust", "reference", "impl", ("impl",), ("for",)), Pattern("rust", "reference", "impl", ("impl",), ("{",)), Pattern("rust", "reference", "call", (), ("(",)),
    Pattern("python", "skip", "parameter", ("def", "%word", "(", *_LIST), (",",)), Pattern("python", "skip", "parameter", ("def", "%word", "(", *_LIST), (")",)), Pattern("python", "reference", "name"),
)


def pattern_table(spark: SparkSession, patterns: Sequence[Pattern] = PATTERNS, stops: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The registry as rows (language, role, name, left, right); of role ``stop`` and ``define`` the name is the word."""
    from .references import DEFAULT_HOOKS

    words = {language: roles["stop"] for language, roles in DEFAULT_HOOKS.items()} if stops is None else stops
    rows = [(p.language, p.role, p.name, list(p.left), list(p.right)) for p in patterns] + [(language, "stop", w, [], []) for language, found in words.items() for w in found]
    return spark.createDataFrame(rows, "language string, role string, name string, left array<string>, right array<string>")


class Matcher:
    """The automata of one language's rows: one reads what is left of a name, one, from the end, what is right."""

    OTHER_WORD, STOP, OTHER = 0, 1, 2

    def __init__(self, patterns: Sequence[Pattern], stops: Sequence[str]):
        # skip rows first, else in the given order
        self.patterns = sorted(patterns, key=lambda p: p.role != "skip")
        literals = dict.fromkeys(x for p in self.patterns for x in (*p.left, *p.right) if not x.startswith("%"))
        self.symbol = {x: k + 3 for k, x in enumerate(literals)}
        self.stops = set(stops)
        self.words = [self.OTHER_WORD, *(k for x, k in self.symbol.items() if x not in self.stops and _LETTER[x.encode()[0]])]
        self.left = self._automaton([p.left for p in self.patterns])
        self.right = self._automaton([_reversed(p.right) for p in self.patterns])

    def _automaton(self, sides: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Transitions by symbol and state, and by state which sides have just been read."""
        steps, ends = [], []
        spots: list[list[tuple[str | None, int]]] = []  # moves from each place: an item, or None for free ones

        def spot() -> int:
            spots.append([])
            return len(spots) - 1

        for items in sides:
            at, begin, opened = spot(), None, []
            steps.append(at)
            for x in items:
                if x == "%{":
                    opened.append(at)
                elif x == "%}*":
                    begin = opened.pop()
                    spots[at].append((None, begin))
                    at = begin
                else:
                    spots.append([])
                    spots[at].append((x, len(spots) - 1))
                    at = len(spots) - 1
            ends.append(at)

        def closed(found: set[int]) -> frozenset[int]:
            todo = list(found)
            while todo:
                for x, to in spots[todo.pop()]:
                    if x is None and to not in found:
                        found.add(to)
                        todo.append(to)
            return frozenset(found)

        first = closed(set(steps))
        numbers, todo, rows = {first: 0}, [first], []
        fits = lambda x, s: x == "%any" or (s in self.words if x == "%word" else self.symbol[x] == s)
        while todo:
            here, row = todo.pop(0), []
            for s in range(len(self.symbol) + 3):
                to = closed({t for p in here for x, t in spots[p] if x is not None and fits(x, s)} | set(steps))
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row.append(numbers[to])
            rows.append(row)
        return np.array(rows).T, np.array([[e in state for e in ends] for state in numbers])

    def find(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of each token the place of the first row that takes it as a name, or -1; ``begins``: tokens with none before them."""
        found = texts.strings(starts, ends).dictionary_encode()
        kinds = np.array([self._kind(x) for x in found.dictionary.to_pylist()], np.int64)
        free = np.array([bool(x) and x not in self.stops and _LETTER[x.encode()[0]] for x in found.dictionary.to_pylist()], bool)
        which = found.indices.to_numpy()
        if len(which) == 0 or not self.patterns:
            return np.full(len(which), -1)
        symbols, name = kinds[which], free[which]
        last = np.append(begins[1:], True)
        left = self.left[1][states_before(symbols, self.left[0], begins)]
        right = self.right[1][states_before(symbols[::-1], self.right[0], last[::-1])[::-1]]
        both = left & right & name[:, None]
        row = np.where(both.any(axis=1), both.argmax(axis=1), -1)
        skip = np.array([p.role == "skip" for p in self.patterns])
        return np.where((row >= 0) & ~skip[row], row, -1)

    def _kind(self, text: str) -> int:
        if text in self.symbol:
            return self.symbol[text]
        if not text or not _LETTER[text.encode()[0]]:
            return self.OTHER
        return self.STOP if text in self.stops else self.OTHER_WORD


def _reversed(items: Sequence[str]) -> list[str]:
    return [{"%{": "%}*", "%}*": "%{"}.get(x, x) for x in reversed(items)]


def matched_references(files: DataFrame, patterns: DataFrame, regions: Mapping[str, Sequence[Region]] = REGIONS, keep: Sequence[str] = (), within: str = "file") -> DataFrame:
    """R2 by token patterns: path, ``keep``, language, line, col, end_col, text, symbol and pattern of every name that a row takes.

    Only tokens of code count, so names in comments and strings are none, nor do those
    stand between a name and its context. ``within``: ``file`` or ``line``, how far
    context reaches. ``patterns`` is ``pattern_table``'s: rows (language, role, name,
    left, right), a registry that the driver reads; it has at most some hundred rows.
    """
    rows_ = patterns.select("language", "role", "name", "left", "right").collect()  # the registry
    of = lambda language, role: [r for r in rows_ if r.language == language and (r.role == "stop") == (role == "stop")]
    spoken = {r.language for r in rows_ if r.role != "stop"}
    matchers = {x: Matcher([Pattern(x, r.role, r.name, tuple(r.left), tuple(r.right)) for r in of(x, "pattern")], [r.name for r in of(x, "stop")]) for x in spoken}
    lexers = {x: Lexer(regions.get(x, ())) for x in spoken}
    names = ["path", *keep, "language"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, rows in sliced(batches):
            if language not in matchers:
                continue
            texts, matcher = Texts(rows.column("content")), matchers[language]
            starts, ends = texts.tokens()
            code = lexers[language].kinds_at(texts.data, texts.offsets, starts) == 0
            starts, ends = starts[code], ends[code]
            file, line, col = texts.located(starts)
            new = np.concatenate(([True], (file[1:] != file[:-1]) | ((line[1:] != line[:-1]) & (within == "line"))))[: len(starts)]
            row = matcher.find(texts, starts, ends, new)
            at = np.flatnonzero(row >= 0)
            words = texts.strings(starts[at], ends[at])
            int32 = lambda x: pa.array(x.astype(np.int32))
            kinds = pa.array([p.name for p in matcher.patterns], pa.string()).take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c).take(pa.array(file[at])) for c in names), int32(line[at]), int32(col[at]), int32(col[at] + ends[at] - starts[at]), words, words, kinds],
                [*names, "line", "col", "end_col", "text", "symbol", "pattern"],
            )

    return files.select(*names, "content").mapInArrow(find, ", ".join(f"{c} string" for c in names) + ", line int, col int, end_col int, text string, symbol string, pattern string")
