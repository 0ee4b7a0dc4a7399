"""Column functions over paths, texts, locations and JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import config

LOCATION = "struct<file_path:string,line:int,column:int,location_string:string>"
MAPPING = f"struct<reference:{LOCATION},definitions:array<{LOCATION}>>"


def _map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for names that only begin with one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def has_ignored_part(path: Column, ignore: Sequence[str] = config.IGNORE_FOLDERS) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, ignore)))


def is_excluded(path: Column, ignore: Sequence[str] = config.IGNORE_FOLDERS, suffixes: Sequence[str] = config.STORE_SUFFIXES) -> Column:
    """a store file, or one with an ignored folder in its relative path."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1).isin(*suffixes) | has_ignored_part(path, ignore)


def has_dot_part(path: Column) -> Column:
    return F.exists(parts(path), lambda p: p.startswith("."))


def language(path: Column, languages: Mapping[str, str] = config.LANGUAGES) -> Column:
    """language of the suffix, or null."""
    return F.try_element_at(_map(languages), suffix(path))


def language_label(found: Column) -> Column:
    """F5"""
    return F.coalesce(found, F.lit(config.UNSUPPORTED))


_SPACES, _LETTERS, _DIGITS, _SIGNS, _REST = range(5)
_CLASS = np.full(256, _SIGNS, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = _SPACES
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")] = _LETTERS
_CLASS[list(b"0123456789")] = _DIGITS
_CLASS[0x80:0xC0] = _REST  # of a code point that began before
_COUNTED = 1 << 20  # bytes looked at in one go


def _token_numbers(texts: pa.Array) -> pa.Array:
    """The matches of ``config.TOKEN`` in each text: runs of letters or digits, and other signs, counted where they begin."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    out = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(np.diff(offsets // _COUNTED, prepend=-1)[:-1]):  # the texts that begin in one piece of the data, the last one whole
        j = np.searchsorted(offsets[:-1] // _COUNTED, offsets[i] // _COUNTED, "right")
        first, last = offsets[i], offsets[j]
        kind = _CLASS[data[first:last]]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        begins = offsets[i:j] - first
        new[begins[begins < len(kind)]] = True
        begun = np.concatenate(([0], np.cumsum((kind == _SIGNS) | (new & ((kind == _LETTERS) | (kind == _DIGITS))))))
        out[i:j] = begun[offsets[i + 1 : j + 1] - first] - begun[begins]
    return pa.array(out)


@F.arrow_udf(LongType())
def _counted_tokens(texts: pa.Array) -> pa.Array:
    return _token_numbers(texts)


def count_tokens(text: Column, pattern: str = config.TOKEN) -> Column:
    """F8: a tokenizer's estimate: words, numbers and single other signs. Null counts 0.

    ``regexp_count`` makes a string of every match; the default pattern is counted in the texts' bytes.
    """
    if pattern == config.TOKEN:
        return _counted_tokens(text)
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def estimate_tokens(text: Column) -> Column:
    """F8: the coarse estimate, a token for four characters."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def location_string(path: Column, line: Column, column: Column) -> Column:
    """F10"""
    return F.concat_ws(":", path, line.cast("string"), column.cast("string"))


def location(path: Column, line: Column, column: Column) -> Column:
    return F.struct(path.alias("file_path"), line.cast("int").alias("line"), column.cast("int").alias("column"), location_string(path, line, column).alias("location_string"))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


_RANGE = "start:struct<line:int,character:int>"
_RAW = f"struct<uri:string,range:struct<{_RANGE}>,targetUri:string,targetRange:struct<{_RANGE}>>"


def normalise_definitions(partial: Column, final: Column) -> Column:
    """locations of a reply's partial results, then of its final one.

    Both are JSON, an object or a list of objects, of the form {uri, range} or
    {targetUri, targetRange}; anything else is skipped. Gives an array of
    (uri, line, column).
    """

    def listed(raw: Column) -> Column:
        many = F.from_json(F.when(F.ltrim(raw).startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), f"array<{_RAW}>")
        return F.coalesce(many, F.array().cast(f"array<{_RAW}>"))

    def shaped(d: Column) -> Column:
        plain = d["uri"].isNotNull() & d["range"].isNotNull()
        return F.struct(
            F.when(plain, d["uri"]).otherwise(d["targetUri"]).alias("uri"),
            F.when(plain, d["range"]["start"]["line"]).otherwise(d["targetRange"]["start"]["line"]).alias("line"),
            F.when(plain, d["range"]["start"]["character"]).otherwise(d["targetRange"]["start"]["character"]).alias("column"),
        )

    return F.filter(F.transform(F.concat(listed(partial), listed(final)), shaped), lambda d: d["uri"].isNotNull() & d["line"].isNotNull() & d["column"].isNotNull())


def uri_path(uri: Column) -> Column:
    """Decoded path of a file URI; ``+`` stays ``+``."""
    return F.try_url_decode(F.replace(F.regexp_extract(uri, "^file://[^/]*(/.*)$", 1), F.lit("+"), F.lit("%2B")))


def repo_relative(path: Column, root: str) -> Column:
    """the path inside the repository, or null where it lies outside."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30))


def drop_self(definitions: Column, path: Column, line: Column, column: Column) -> Column:
    """F13"""
    return F.filter(definitions, lambda d: ~((d["file_path"] == path) & (d["line"] == line) & (d["column"] == column)))


def normalise_content(content: Column) -> Column:
    """F16: the text of JSON content: a list's ``text`` fields and bare strings joined, anything else as it stands."""
    items = F.from_json(content, "array<string>")
    text = F.transform(items, lambda x: F.when(F.ltrim(x).startswith("{"), F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).otherwise(x))
    return F.when(F.ltrim(content).startswith("[") & items.isNotNull(), F.array_join(text, "")).otherwise(content)


def whitelist(metrics: Column, names: Sequence[str] = config.PRECHECK_METRICS) -> Column:
    """F17"""
    return F.map_filter(metrics, lambda k, _: k.isin(*names))


def downstream_text(name: Column, node_type: Column, path: Column) -> Column:
    """F18"""
    return F.concat(name, F.lit(" REFERENCES "), node_type, F.lit(" IN "), path)


def upstream_text(name: Column, ref_path: Column, node_type: Column, path: Column) -> Column:
    """F18"""
    return F.concat(name, F.lit(" IN "), ref_path, F.lit(" REFERENCES "), node_type, F.lit(" IN "), path)


def arrow_text(a: Column, b: Column, text: Column) -> Column:
    """F18"""
    return F.concat(a, F.lit(" → "), b, F.lit(": "), text)


def bullets(texts: Column) -> Column:
    """a line for each text, or a dash."""
    return F.coalesce(F.nullif(F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit("")), F.lit("—"))


PROMPT = "Repository: {repo}\nFile: {path}\n\n{code}\n\nUsed by:\n{upstream}\n\nUses:\n{downstream}\n\nDescribe the file in one to three sentences if it is critical; else answer IGNORE."


def file_prompt(repo: Column, path: Column, code: Column, upstream: Column, downstream: Column, template: str = PROMPT) -> Column:
    """``template`` filled with the columns."""
    fields = {"{repo}": repo, "{path}": path, "{code}": code, "{upstream}": upstream, "{downstream}": downstream}
    pieces, rest = [], template
    while rest:
        at, name = min(((rest.find(n), n) for n in fields if n in rest), default=(-1, ""))
        if at < 0:
            pieces.append(F.lit(rest))
            break
        pieces += [F.lit(rest[:at]), F.coalesce(fields[name], F.lit(""))]
        rest = rest[at + len(name) :]
    return F.concat(*pieces)
