"""Tokens with positions, references, definitions and their resolution, as table jobs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import config, scalars

_LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
_SLICE = 1 << 18  # bytes of texts at a time, as words and places take many times as much
LEAF = "line int, ordinal int, col int, end_col int, text string, before string, after string"


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 0) and text of every line; ``\\r\\n`` and ``\\r`` count as ``\\n``."""
    return files.select("path", F.posexplode(F.split(scalars.normalise_newlines(F.col("content")), "\n")).alias("line", "text"))


def extract_leaves(files: DataFrame, keep: Sequence[str] = (), pattern: str | None = None) -> DataFrame:
    """Path, line, ordinal, col, end_col and text of every word, in code points, end exclusive, with the words before and after it in its line.

    A word's column depends on all that precedes it in its line. Finding the words
    of a line where it lies takes one pass and no exchange; with array or window
    functions every token would be shuffled by its line first. ``keep`` names string
    columns of the files to repeat on every word, which spares a join later. With
    ``pattern`` only the words that it matches leave the Python workers.
    """
    names = ["path", *keep]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _all_words(batches, names, pattern)

    return files.select(*names, "content").mapInArrow(find, ", ".join(f"{c} string" for c in names) + f", {LEAF}")


def _all_words(batches: Iterator[pa.RecordBatch], names: Sequence[str], pattern: str | None = None) -> Iterator[pa.RecordBatch]:
    """The words of some files at a time, ``_SLICE`` bytes of them or one longer text."""
    for batch in batches:
        sizes = np.array([0 if s is None else s for s in pc.binary_length(batch.column("content")).to_pylist()])
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _SLICE, prepend=0)) if len(sizes) else []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield _words(batch.slice(a, b - a), names, pattern)


def _words(files: pa.RecordBatch, names: Sequence[str], pattern: str | None = None) -> pa.RecordBatch:
    """All words of some files, or those that match ``pattern``, found in their bytes: no byte of another code point is a letter's or a line end's.

    The pattern is asked first; places are worked out for the words that it leaves.
    """
    content = files.column("content").fill_null("").cast(pa.large_string())
    _, offsets, data = content.buffers()
    offsets = np.frombuffer(offsets, np.int64)[content.offset : content.offset + len(content) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (edge[:-1] | ~np.concatenate(([False], letter[:-1]))))
    ends = np.flatnonzero(letter & (edge[1:] | ~np.concatenate((letter[1:], [False])))) + 1
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts)))), pa.py_buffer(np.ascontiguousarray(data[letter]))).cast(pa.string())
    places = np.arange(len(starts)) if pattern is None else np.flatnonzero(pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False))
    begun, long = starts[places], (ends - starts)[places]
    next_ = np.concatenate((data[1:], np.zeros(min(1, len(data)), np.uint8)))
    breaks = np.flatnonzero((data == 10) | ((data == 13) & ~((next_ == 10) & ~edge[1:])))
    file = np.searchsorted(offsets, begun, "right") - 1
    line_from = np.searchsorted(breaks, offsets[:-1])  # breaks before each file
    stop = np.searchsorted(breaks, begun)  # the break that ends the word's line, if its file does not end first
    line = stop - line_from[file]
    begin = np.where(line > 0, breaks[np.maximum(stop - 1, 0)] + 1 if len(breaks) else 0, offsets[:-1][file])  # of the word's line
    points = np.concatenate(([0], np.cumsum(_LEAD[data])))
    col = points[begun] - points[begin]
    ordinal = places - np.searchsorted(starts, begin)
    after = np.append(starts, len(data))[places + 1]  # where the next word begins
    last = after >= np.minimum(np.append(breaks, len(data))[stop], offsets[1:][file])
    int32 = lambda x: pa.array(x.astype(np.int32))
    neighbour = lambda step, none: text.take(pa.array(places + step, mask=none))
    columns = [files.column(c).take(pa.array(file)) for c in names]
    return pa.RecordBatch.from_arrays(
        [*columns, int32(line), int32(ordinal), int32(col), int32(col + long), text.take(pa.array(places)), neighbour(-1, ordinal == 0), neighbour(1, last)],
        [*names, "line", "ordinal", "col", "end_col", "text", "before", "after"],
    )


def extract_symbols(leaves: DataFrame, pattern: str = config.SYMBOL) -> DataFrame:
    """R2 for texts without a grammar: words that match ``pattern``, lower-cased as ``symbol``."""
    return leaves.where(F.col("text").rlike(pattern)).withColumn("symbol", F.lower("text"))


def pattern_rows(spark: SparkSession, hooks: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """The registry of per-language extractors as rows (language, role, before).

    ``define`` rows hold words that come right before the name they define, ``stop``
    rows words that are never references. Rows with context on both sides are
    ``lexing.pattern_table``'s.
    """
    rows = [(language, role, word) for language, roles in hooks.items() for role, words in roles.items() for word in words]
    return spark.createDataFrame(rows, "language string, role string, word string")


DEFAULT_HOOKS = {language: {"define": words, "stop": tuple(words) + ("self", "cls", "this", "return", "if", "else", "for", "while", "import", "from", "new", "in", "let", "use")} for language, words in config.DEFINING_WORDS.items()}


def extract_definitions(leaves: DataFrame, patterns: DataFrame) -> DataFrame:
    """Words right after a defining word of their file's ``language``, a column of the leaves."""
    defining = patterns.where("role = 'define'").select("language", F.col("word").alias("before"))
    return leaves.join(F.broadcast(defining), ["language", "before"], "left_semi").withColumns({"keyword": F.col("before"), "symbol": F.col("text")})  # a few words a language


def extract_references(leaves: DataFrame, patterns: DataFrame) -> DataFrame:
    """R2: words that neither define a name nor are stop-words of their file's ``language``, a column of the leaves."""
    stops = patterns.where("role = 'stop'").select("language", F.col("word").alias("text"))
    defining = patterns.where("role = 'define'").select("language", F.col("word").alias("before"))
    spoken = leaves.where("language IS NOT NULL")
    return spoken.join(F.broadcast(stops), ["language", "text"], "left_anti").join(F.broadcast(defining), ["language", "before"], "left_anti").withColumn("symbol", F.col("text"))  # a few words a language


def first_definitions(symbols: DataFrame, order: Sequence[str] = ("path", "line", "col"), by: Sequence[str] = ()) -> DataFrame:
    """R3 for texts without a grammar: a symbol's first occurrence, in each ``by`` group, defines it."""
    return symbols.groupBy("symbol", *by).agg(F.min(F.struct(*order, *(c for c in ("path", "line", "col") if c not in order))).alias("d")).select("symbol", *by, "d.path", "d.line", "d.col")


def ranked_definitions(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Every definition of each reference's symbol, nearest first: same file, same folder, then any; never itself."""
    folder = lambda p: F.regexp_extract(p, "^(.*)/", 1)
    targets = defs.select("symbol", F.col("path").alias("def_path"), F.col("line").alias("def_line"), F.col("col").alias("def_col"))
    pairs = refs.select("symbol", "path", "line", "col").join(targets, "symbol").where(~((F.col("path") == F.col("def_path")) & (F.col("line") == F.col("def_line")) & (F.col("col") == F.col("def_col"))))
    distance = F.when(F.col("path") == F.col("def_path"), 0).when(folder(F.col("path")) == folder(F.col("def_path")), 1).otherwise(2)
    return pairs.withColumn("distance", distance)


def resolve_references(refs: DataFrame, defs: DataFrame, most: int | None = None) -> DataFrame:
    """Mappings (ref_path, ref_line, ref_column, mapping) with the ordered list of definitions.

    By default a list has every definition of the symbol, so it is as long as there
    are; with ``most`` it has the ``most`` nearest, and a reference meets no more than
    three times one more than that.
    """
    near = ranked_definitions(refs, defs) if most is None else nearest_definitions(refs, defs, most).select("path", "line", "col", "d.*")
    found = near.groupBy("path", "line", "col").agg(F.sort_array(F.collect_list(F.struct("distance", "def_path", "def_line", "def_col"))).alias("found"))  # as many as a symbol has definitions
    kept = F.col("found") if most is None else F.slice("found", 1, most)
    definitions = F.transform(kept, lambda d: scalars.location(d["def_path"], d["def_line"], d["def_col"]))
    mapping = F.struct(scalars.location(F.col("path"), F.col("line"), F.col("col")).alias("reference"), definitions.alias("definitions"))
    return found.select(F.col("path").alias("ref_path"), F.col("line").alias("ref_line"), F.col("col").alias("ref_column"), mapping.alias("mapping"))


def first_resolved(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """F14 without the lists: path, line, col and the nearest definition of each reference."""
    best = ranked_definitions(refs, defs).groupBy("path", "line", "col").agg(F.min(F.struct("distance", "def_path", "def_line", "def_col")).alias("d"))
    return best.select("path", "line", "col", "d.def_path", "d.def_line", "d.def_col")


def only_resolved(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """``first_resolved`` where a symbol has one definition at most: a reference meets one row, so none has to be found again by its place."""
    return ranked_definitions(refs, defs).select("path", "line", "col", "def_path", "def_line", "def_col")


def nearest_definitions(refs: DataFrame, defs: DataFrame, most: int = 1) -> DataFrame:
    """path, line, col and d (distance, def_path, def_line, def_col): for each reference at least its ``most`` nearest definitions, without pairing it with all of its symbol.

    Of each file, folder and symbol only the first ``most`` definitions and one more
    are kept (one may be the reference itself). A definition comes once, at its
    true distance.
    """
    folder = lambda p: F.regexp_extract(p, "^(.*)/", 1)
    points = refs.select("symbol", "path", "line", "col", folder(F.col("path")).alias("folder"))
    targets = defs.select("symbol", F.col("path").alias("def_path"), F.col("line").alias("def_line"), F.col("col").alias("def_col"), folder(F.col("path")).alias("def_folder")).distinct()
    distance = F.when(F.col("path") == F.col("def_path"), 0).when(F.col("folder") == F.col("def_folder"), 1).otherwise(2)
    offers = None
    for own, other in (("path", "def_path"), ("folder", "def_folder"), (None, None)):
        order = Window.partitionBy("symbol", *([other] if other else [])).orderBy("def_path", "def_line", "def_col")
        some = targets.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most + 1).drop("_rank").withColumnRenamed("symbol", "_symbol")
        same = points["symbol"] == some["_symbol"]
        met = points.join(some, same & (points[own] == some[other]) if own else same)
        itself = (F.col("path") == F.col("def_path")) & (F.col("line") == F.col("def_line")) & (F.col("col") == F.col("def_col"))
        offer = met.where(~itself).select("path", "line", "col", F.struct(distance.alias("distance"), "def_path", "def_line", "def_col").alias("d"))
        offers = offer if offers is None else offers.unionByName(offer)
    return offers if most == 1 else offers.distinct()


def nearest_resolved(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """``first_resolved`` for symbols of many definitions: a reference meets six rows at most."""
    return nearest_definitions(refs, defs).groupBy("path", "line", "col").agg(F.min("d").alias("d")).select("path", "line", "col", "d.def_path", "d.def_line", "d.def_col")


def first_definition(mappings: DataFrame) -> DataFrame:
    """the first definition of each mapping that has one."""
    d = F.element_at("mapping.definitions", 1)
    return mappings.where(F.size("mapping.definitions") > 0).select(
        F.col("ref_path").alias("path"), F.col("ref_line").alias("line"), F.col("ref_column").alias("col"), d["file_path"].alias("def_path"), d["line"].alias("def_line"), d["column"].alias("def_col")
    )


def to_repo_paths(definitions: DataFrame, root: str, files: DataFrame) -> DataFrame:
    """rows (uri, …) with their repository path; those outside or not among ``files`` go."""
    placed = definitions.withColumn("path", scalars.repo_relative(scalars.uri_path(F.col("uri")), root))
    return placed.where(F.col("path").isNotNull()).join(files.select("path"), "path", "left_semi")


def span_text(files: DataFrame, spans: DataFrame) -> DataFrame:
    """text of each span (span_id, path, start_line, start_col, end_line, end_col), end exclusive, trimmed.

    A span is cut from its file in one piece, at the ends of the lines before it, so
    it is one row however many lines it has. Columns beyond a line's end are at its
    end; spans that begin after the file's last line go.
    """
    text = scalars.normalise_newlines(F.col("content")).alias("_text")
    rows = spans.join(files.select("path", text), "path").where(F.col("start_line") <= F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))))
    line_end = lambda line: F.length(F.call_function("substring_index", F.col("_text"), F.lit("\n"), line + 1))
    place = lambda line, col: F.least(F.when(line > 0, line_end(line - 1) + 1).otherwise(F.lit(0)) + col, line_end(line))
    begin, end = place(F.col("start_line"), F.col("start_col")), place(F.col("end_line"), F.col("end_col"))
    return rows.select("span_id", F.trim(F.substring(F.col("_text"), begin + 1, F.greatest(end - begin, F.lit(0)))).alias("text"))
