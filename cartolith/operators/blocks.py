"""Nested blocks of source text, and names resolved in the innermost enclosing one.

Blocks come from matching brackets, or from indentation. Both are found for all files
of a batch at once: brackets of one depth match in turn, and what encloses a bracket,
a line or a word is the nearest thing to its left that lies less deep.

Blocks: path, block (pre-order number in its file, from 1), last (the largest number
inside of it, so that pre- and post-order are in one), parent (0: the file), depth, and
a span with the end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .lexing import _LETTER, REGIONS, Lexer, Region, Texts, sliced
from .references import nearest_resolved

#: How each language shows its blocks: by indentation, or by these brackets.
STYLES: dict[str, str | tuple[str, str]] = {"python": "indent", "java": ("{", "}"), "scala": ("{", "}"), "rust": ("{", "}")}
_TAB = 8


def nearest_smaller(values: np.ndarray, equal: bool = False) -> np.ndarray:
    """The place of the nearest value to the left that is smaller (or ``equal``), or -1; found over minima of windows of doubling width."""
    n = len(values)
    at = np.arange(n) - 1
    minima = [values]
    while (1 << len(minima)) <= n:
        half, wide = 1 << (len(minima) - 1), minima[-1].copy()
        wide[half:] = np.minimum(wide[half:], minima[-1][:-half])
        minima.append(wide)
    for k in reversed(range(len(minima))):  # over windows that hold none
        least = minima[k][np.maximum(at, 0)]
        at = np.where((at >= (1 << k) - 1) & ((least > values) if equal else (least >= values)), at - (1 << k), at)
    return at


def next_at_most(values: np.ndarray) -> np.ndarray:
    """The place of the nearest value to the right that is no larger, or the number of values."""
    return len(values) - 1 - nearest_smaller(values[::-1], equal=True)[::-1]


def _fenced(values: np.ndarray, file: np.ndarray, fence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``values`` with a fence before each file's; the place of each value, and which value stands at each place (-1: a fence)."""
    new = np.concatenate(([True], file[1:] != file[:-1]))[: len(file)]
    place = np.arange(len(values)) + np.cumsum(new)
    out, back = np.full(len(values) + int(new.sum()), fence, np.int64), np.full(len(values) + int(new.sum()), -1)
    out[place], back[place] = values, np.arange(len(values))
    return out, place, back


def _levels(parent: np.ndarray) -> np.ndarray:
    """Depths from 1 of a forest, each step doubling the way up."""
    depth, up = np.where(parent >= 0, 1, 0), parent.copy()
    while (up >= 0).any():
        depth = depth + np.where(up >= 0, depth[up], 0)
        up = np.where(up >= 0, up[up], -1)
    return depth + 1


class Blocks:
    """The blocks of some texts in order of file and begin: file, begin, end (bytes), parent (a block, or -1), depth from 1, last (the last block inside)."""

    def __init__(self, texts: Texts, style: str | tuple[str, str], lexer: Lexer):
        self.file, self.begin, self.end, self.parent = _indented(texts, lexer) if style == "indent" else _bracketed(texts, style, lexer)
        self.depth = _levels(self.parent)
        fenced, place, back = _fenced(self.depth, self.file, 0)
        before = np.concatenate(([0], np.cumsum(back >= 0)))
        self.last = before[next_at_most(fenced)[place]] - 1
        self.first = np.searchsorted(self.file, self.file)  # of each block's file

    def holding(self, texts: Texts, at: np.ndarray) -> np.ndarray:
        """The innermost block around each of some ascending bytes, or -1."""
        file = np.searchsorted(texts.offsets, at, "right") - 1
        return innermost(self.file, self.begin, self.end, file, at)

    def around(self, texts: Texts, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number in its file of the innermost block around each of some ascending bytes, and that block's last; 0 and the file's last where there is none."""
        block = self.holding(texts, at)
        here = np.maximum(block, 0)
        number, last = (np.where(block >= 0, x[here] - self.first[here] + 1, 0) if len(self.file) else np.zeros(len(block), np.int64) for x in (np.arange(len(self.file)), self.last))
        held = np.bincount(self.file, minlength=len(texts.offsets) - 1)  # blocks of each file
        return number, np.where(block >= 0, last, held[np.searchsorted(texts.offsets, at, "right") - 1])


def innermost(group: np.ndarray, begin: np.ndarray, end: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of nested or disjoint spans (by group and begin) the innermost that holds each point, or -1; begin is in the span, end isn't."""
    n, m = len(begin), len(at)
    if n == 0 or m == 0:
        return np.full(m, -1)
    groups = np.concatenate([group, of, group])
    order = np.lexsort((np.repeat([1, 2, 0], [n, m, n]), np.concatenate([begin, at, end]), groups))  # ends come first, then begins
    kind = np.repeat([1, 2, 0], [n, m, n])[order]
    open_ = np.cumsum(np.where(kind == 1, 1, np.where(kind == 0, -1, 0)))  # spans end in their group, so it is none between groups
    use = np.flatnonzero(kind > 0)
    depth = np.where(kind[use] == 1, open_[use], open_[use] + 1)
    # spans that begin together lie inside each other in their order
    fenced, place, back = _fenced(depth, groups[order][use], 0)
    above = back[np.maximum(nearest_smaller(fenced)[place], 0)]
    points = np.flatnonzero(kind[use] == 2)
    holder = above[points]
    out = np.full(m, -1)
    which = order[use[points]] - n
    out[which] = np.where(holder >= 0, order[use[np.maximum(holder, 0)]], -1)
    return out


def _bracketed(texts: Texts, style: tuple[str, str], lexer: Lexer) -> tuple[np.ndarray, ...]:
    opening, closing = (ord(x) for x in style)
    at = np.flatnonzero((texts.data == opening) | (texts.data == closing))
    at = at[lexer.kinds_at(texts.data, texts.offsets, at) == 0]
    file = np.searchsorted(texts.offsets, at, "right") - 1
    if len(at) == 0:
        return (np.zeros(0, np.int64),) * 4
    change = np.where(texts.data[at] == opening, 1, -1)
    # depth after each bracket; a closing one without its opening one changes nothing
    total = np.cumsum(change)
    own = total - (total - change)[np.searchsorted(file, file)]
    fall = len(change) + 1  # a file's minimum never comes from one before it
    depth = own - np.minimum(np.minimum.accumulate(own - file * fall) + file * fall, 0)
    before = np.concatenate(([0], depth[:-1]))
    before[np.concatenate(([True], file[1:] != file[:-1]))] = 0
    opens = np.flatnonzero(change > 0)
    both = np.concatenate([opens, np.flatnonzero((change < 0) & (before > depth))])
    level = np.where(change[both] > 0, depth[both], before[both])
    order = np.lexsort((both, level, file[both]))
    both, level = both[order], level[order]
    pair = np.flatnonzero((change[both[:-1]] > 0) & (change[both[1:]] < 0) & (level[1:] == level[:-1]) & (file[both[1:]] == file[both[:-1]]))
    end = np.zeros(len(at), np.int64)
    end[opens] = texts.offsets[1:][file[opens]]  # one that stays open ends with its file
    end[both[pair]] = at[both[pair + 1]] + 1
    fenced, place, back = _fenced(depth[opens], file[opens], 0)
    return file[opens], at[opens], end[opens], back[nearest_smaller(fenced)[place]]


def _indented(texts: Texts, lexer: Lexer) -> tuple[np.ndarray, ...]:
    """A block is the lines that follow one and are indented more than it; blank lines and those that begin in a comment or string don't count."""
    data, n = texts.data, len(texts.data)
    begins = np.unique(np.concatenate([texts.offsets[:-1], texts.breaks + 1]))
    begins = begins[begins < n]
    solid = np.flatnonzero(~np.isin(data, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)))
    spot = np.searchsorted(solid, begins)
    first = np.append(solid, n)[spot]
    ok = first < np.append(begins[1:], n)
    begins, first = begins[ok], first[ok]
    ok = lexer.kinds_at(data, texts.offsets, first) == 0
    begins, first = begins[ok], first[ok]
    if len(begins) == 0:
        return (np.zeros(0, np.int64),) * 4
    file = np.searchsorted(texts.offsets, begins, "right") - 1
    tabs = np.concatenate(([0], np.cumsum(data == 9)))
    fenced, place, back = _fenced(first - begins + (_TAB - 1) * (tabs[first] - tabs[begins]), file, -1)
    head = np.flatnonzero((back[:-1] >= 0) & (back[1:] >= 0) & (fenced[1:] > fenced[:-1]))  # lines that one indented more follows
    number = np.full(len(fenced), -1)
    number[head] = np.arange(len(head))
    final = back[next_at_most(fenced)[head] - 1]  # the last line of each block
    stop = np.append(texts.breaks, n)[np.searchsorted(texts.breaks, first[final])]
    end = np.minimum(stop, texts.offsets[1:][file[final]])
    return file[back[head]], first[back[head + 1]], end, number[nearest_smaller(fenced)[head]]


def _passes(files: DataFrame, styles: Mapping[str, str | tuple[str, str]], regions: Mapping[str, Sequence[Region]]):
    lexers = {x: Lexer(regions.get(x, ())) for x in styles}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts, Blocks, Lexer]]:
        for language, rows in sliced(batches):
            if language in styles:
                texts = Texts(rows.column("content"))
                yield rows, texts, Blocks(texts, styles[language], lexers[language]), lexers[language]

    return each


def _int32(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def nested_blocks(files: DataFrame, styles: Mapping[str, str | tuple[str, str]] = STYLES, regions: Mapping[str, Sequence[Region]] = REGIONS) -> DataFrame:
    """The blocks of files (path, language, content), of any depth; brackets in comments and strings are none."""
    each = _passes(files, styles, regions)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, b, _ in each(batches):
            _, line, col = texts.located(b.begin)
            _, last_line, last_col = texts.located(np.maximum(b.end - 1, 0))
            number = np.arange(len(b.file)) - b.first + 1
            parent = np.where(b.parent >= 0, b.parent - b.first + 1, 0)
            end_col = last_col + texts.points[b.end] - texts.points[np.maximum(b.end - 1, 0)]
            columns = [number, b.last - b.first + 1, parent, b.depth, line, col, last_line, end_col]
            yield pa.RecordBatch.from_arrays([rows.column("path").take(pa.array(b.file)), *map(_int32, columns)], ["path", "block", "last", "parent", "depth", "start_line", "start_col", "end_line", "end_col"])

    return files.select("path", "language", "content").mapInArrow(find, "path string, block int, last int, parent int, depth int, start_line int, start_col int, end_line int, end_col int")


def _spans(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word."""
    letter, n = _LETTER[texts.data], len(texts.data)
    starts = np.flatnonzero(letter & (texts.edge[:n] | ~np.concatenate(([False], letter[:-1]))) if n else letter)
    return starts, np.flatnonzero(letter & (texts.edge[1:] | ~np.concatenate((letter[1:], [False]))) if n else letter) + 1


def _matching(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)


def scoped_words(files: DataFrame, styles: Mapping[str, str | tuple[str, str]] = STYLES, regions: Mapping[str, Sequence[Region]] = REGIONS, pattern: str | None = None) -> DataFrame:
    """path, line, col, end_col, text and kind of every word, with the number of the innermost block around it and that block's last (0 and the file's: none).

    With ``pattern`` only the words that it matches are placed and leave the Python workers.
    """
    each = _passes(files, styles, regions)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, b, lexer in each(batches):
            starts, ends = _spans(texts)
            text = texts.strings(starts, ends)
            if pattern is not None:
                kept = _matching(text, pattern)
                starts, ends, text = starts[kept], ends[kept], text.filter(pa.array(kept))
            file, line, col = texts.located(starts)
            number, last = b.around(texts, starts)
            kind = pa.array(lexer.kinds).take(pa.array(lexer.kinds_at(texts.data, texts.offsets, starts)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("path").take(pa.array(file)), _int32(line), _int32(col), _int32(col + ends - starts), text, kind, _int32(number), _int32(last)],
                ["path", "line", "col", "end_col", "text", "kind", "block", "last"],
            )

    return files.select("path", "language", "content").mapInArrow(find, "path string, line int, col int, end_col int, text string, kind string, block int, last int")


def resolved_in_files(files: DataFrame, refs: str, defs: str, styles: Mapping[str, str | tuple[str, str]] = STYLES, regions: Mapping[str, Sequence[Region]] = REGIONS) -> DataFrame:
    """R4 by scope for words that match ``refs``, among those that match ``defs`` and are the same in lower case: ``resolve_in_scope`` of ``scoped_words``.

    A block is in one file, so references and definitions meet where their file is
    read: no word is shuffled, and only references that have a definition leave the
    Python workers. Words without a partner in their file aren't placed at all.
    """
    each = _passes(files, styles, regions)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, b, _ in each(batches):
            starts, ends = _spans(texts)
            text = texts.strings(starts, ends)
            wanted, defining = _matching(text, refs), _matching(text, defs)
            symbol = pc.ascii_lower(text).dictionary_encode().indices.to_numpy().astype(np.int64)
            group = symbol * rows.num_rows + np.searchsorted(texts.offsets, starts, "right") - 1
            wanted &= np.isin(group, group[defining])
            defining &= np.isin(group, group[wanted])
            used = np.flatnonzero(wanted | defining)
            group, wanted, defining, starts = group[used], wanted[used], defining[used], starts[used]
            block, last = b.around(texts, starts)
            spans = np.flatnonzero(defining)
            spans = spans[np.lexsort((spans, block[spans], group[spans]))]
            first = np.ones(len(spans), bool)  # of a block's definitions
            first[1:] = (group[spans[1:]] != group[spans[:-1]]) | (block[spans[1:]] != block[spans[:-1]])
            spans, at = spans[first], np.flatnonzero(wanted)
            here = innermost(group[spans], block[spans], last[spans] + 1, group[at], block[at])
            at, to = at[here >= 0], spans[here[here >= 0]]
            at, to = at[at != to], to[at != to]
            file, line, col = texts.located(starts)
            own = rows.column("path").take(pa.array(file[at]))
            yield pa.RecordBatch.from_arrays([own, *map(_int32, (line[at], col[at])), own, *map(_int32, (line[to], col[to]))], ["path", "line", "col", "def_path", "def_line", "def_col"])

    return files.select("path", "language", "content").mapInArrow(find, "path string, line int, col int, def_path string, def_line int, def_col int")


def block_id(path: str, block: str):
    """G2 for blocks; block 0 is the file."""
    return F.concat_ws(":", path, F.lit("block"), F.col(block).cast("string"))


def block_tree(files: DataFrame, blocks: DataFrame, words: DataFrame) -> DataFrame:
    """G1 with nested blocks: a node for each file, block and word of code; a word hangs from the innermost block around it."""
    none, no, zero = F.lit("NONE"), F.lit(False), F.lit(0)
    text = scalars.normalise_newlines(F.col("content"))
    roots = files.select(
        F.concat_ws(":", "path", F.lit("block"), F.lit("0")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("module").alias("node_type"), "path", zero.alias("start_line"), zero.alias("start_col"),
        (F.size(F.split(text, "\n")) - 1).alias("end_line"), F.length(F.substring_index(text, "\n", -1)).alias("end_col"), no.alias("is_definition"), no.alias("is_reference"), none.alias("name"),
    )
    inner = blocks.select(
        block_id("path", "block").alias("node_id"), block_id("path", "parent").alias("parent_id"), F.lit("block").alias("node_type"), "path", "start_line", "start_col", "end_line", "end_col",
        no.alias("is_definition"), no.alias("is_reference"), none.alias("name"),
    )
    leaves = words.where("kind = 'code'").select(
        F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"), F.lit("word")).alias("node_id"), block_id("path", "block").alias("parent_id"), F.lit("word").alias("node_type"), "path",
        F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), "end_col", no.alias("is_definition"), F.lit(True).alias("is_reference"), F.col("text").alias("name"),
    )
    return roots.unionByName(inner).unionByName(leaves)


def contracted_blocks(files: DataFrame, pattern: str, styles: Mapping[str, str | tuple[str, str]] = STYLES, regions: Mapping[str, Sequence[Region]] = REGIONS) -> DataFrame:
    """G12 of ``block_tree``, of which stay the words of code that match ``pattern``, the blocks right around one, and the files: node_id and anchor.

    A file's blocks are found together, and so is what encloses each: its way up
    doubles in arrays until it ends in a block that stays. No node that goes leaves
    the Python workers, and none is joined.
    """
    each = _passes(files, styles, regions)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, b, lexer in each(batches):
            starts, ends = _spans(texts)
            starts = starts[_matching(texts.strings(starts, ends), pattern)]
            starts = starts[lexer.kinds_at(texts.data, texts.offsets, starts) == 0]
            holder = b.holding(texts, starts)
            kept = np.zeros(len(b.file) + 1, bool)
            kept[holder] = True
            kept[-1] = True  # the file, at -1
            up = b.parent.copy()
            while not kept[up].all():
                up = np.where(kept[up], up, up[up])
            inner = np.flatnonzero(kept[:-1])
            number = np.append(np.arange(len(b.file)) - b.first + 1, 0)  # 0: the file
            file, line, col = texts.located(starts)
            none = pa.nulls(len(inner), pa.int32())
            columns = [
                rows.column("path").take(pa.array(np.concatenate([file, b.file[inner]]))), pa.concat_arrays([_int32(line), none]), pa.concat_arrays([_int32(col), none]),
                pa.concat_arrays([pa.nulls(len(starts), pa.int32()), _int32(number[inner])]), _int32(np.concatenate([number[holder], number[up[inner]]])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["path", "line", "col", "block", "above"])

    found = files.select("path", "language", "content").mapInArrow(find, "path string, line int, col int, block int, above int")
    word = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"), F.lit("word"))
    nodes = found.select(F.when(F.col("block").isNull(), word).otherwise(block_id("path", "block")).alias("node_id"), block_id("path", "above").alias("anchor"))
    return nodes.unionByName(files.select(F.concat_ws(":", "path", F.lit("block"), F.lit("0")).alias("node_id"), F.lit(None).cast("string").alias("anchor")))


def resolve_in_scope(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """R4 by scope: path, line, col and def_path, def_line, def_col of each reference that has a definition in a block around it, the innermost such block's.

    refs: (path, symbol, line, col, block); defs: the same and the block's ``last``. Of
    several definitions of a block the first counts; a definition is none for itself.
    References and definitions of a file's symbol meet in one sort of both by place in
    the pre-order, not pair by pair.
    """
    keys = ["path", "symbol"]
    scopes = defs.groupBy(*keys, "block").agg(F.min(F.struct("line", "col")).alias("d"), F.first("last").alias("last")).select(*keys, "block", "last", F.col("d.line").alias("line"), F.col("d.col").alias("col"), F.lit(0).alias("side"))
    points = refs.select(*keys, "block", F.lit(0).alias("last"), "line", "col", F.lit(1).alias("side"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def met(rows: pa.Table) -> pa.RecordBatch:
            side, block, last = (rows[c].to_numpy().astype(np.int64) for c in ("side", "block", "last"))
            path, symbol = (rows[c].combine_chunks() for c in keys)
            same = np.concatenate(([True], _unequal(path) | _unequal(symbol)))
            group = np.cumsum(same) - 1
            spans, at = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            here = innermost(group[spans], block[spans], last[spans] + 1, group[at], block[at])
            at, to = at[here >= 0], spans[here[here >= 0]]
            line, col = rows["line"].to_numpy(), rows["col"].to_numpy()
            other = (line[at] != line[to]) | (col[at] != col[to])
            at, to = at[other], to[other]
            own = path.take(pa.array(at))
            return pa.RecordBatch.from_arrays([own, pa.array(line[at]), pa.array(col[at]), own, pa.array(line[to]), pa.array(col[to])], ["path", "line", "col", "def_path", "def_line", "def_col"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            cuts = np.flatnonzero(_unequal(rows["path"].combine_chunks())) + 1  # whole files, which bound what is held
            if len(cuts):
                yield met(rows.slice(0, cuts[-1]))
                rows = rows.slice(cuts[-1])
            held = rows.to_batches()
        if held:
            yield met(pa.Table.from_batches(held).combine_chunks())

    rows = scopes.unionByName(points).repartition(*keys).sortWithinPartitions(*keys, "block", "side")
    return rows.mapInArrow(meet, "path string, line int, col int, def_path string, def_line int, def_col int")


def _unequal(column: pa.Array) -> np.ndarray:
    """Whether each string but the first differs from the one before."""
    codes = column.dictionary_encode().indices.to_numpy()
    return codes[1:] != codes[:-1]


def scoped_or_nearest(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """The innermost enclosing definition of each reference, else the nearest: of its file, its folder, or any."""
    inside = resolve_in_scope(refs, defs)
    left = refs.join(inside.select("path", "line", "col"), ["path", "line", "col"], "left_anti")
    return inside.unionByName(nearest_resolved(left, defs))
