"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved offline: once, on the
driver, by encoding each of them with the library. The strings found (no more than
the vocabulary has) go to every executor, where a pre-token among them counts 1
without merging. All other distinct pre-tokens go to the library's merges in one
call for each piece of a text, and their counts are kept for what follows.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .memory import releasing

#: Fixed values of the byte-level format: its split pattern and the rule of its byte alphabet.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_split = regex.compile(SPLIT)
_LONG, _PIECE = 1 << 20, 1 << 16
_KEPT = 300_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer) -> list[str]:
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special), key=len, reverse=True)


def pretokens(text: str) -> Iterator[list[str]]:
    """The strings that merges never cross, in lists; those of a very long text piece by piece."""
    if len(text) < _LONG:
        yield _split.findall(text)
    else:
        found = (m.group() for m in _split.finditer(text))
        while piece := list(islice(found, _PIECE)):
            yield piece


def whole_tokens(tokenizer) -> set[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    back = {c: b for b, c in byte_alphabet().items()}
    found = []
    special = set(special_strings(tokenizer))
    for name in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in name).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in special and _split.findall(text) == [text]:
            found.append(text)
    encoded = tokenizer.encode_batch_fast(found, add_special_tokens=False)
    return {text for text, e in zip(found, encoded, strict=True) if len(e.ids) == 1}


class TokenCounter:
    def __init__(self, path: str, whole: Iterable[str] | None = None):
        self.tokenizer = load(path)
        self.whole = dict.fromkeys(whole_tokens(self.tokenizer) if whole is None else whole, 1)
        self.counts = dict(self.whole)
        special = special_strings(self.tokenizer)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _sum(self, piece: list[str]) -> int:
        try:
            return sum(map(self.counts.__getitem__, piece))
        except KeyError:
            if len(self.counts) > _KEPT:
                self.counts = dict(self.whole)
            missing = list(set(piece).difference(self.counts))
            self.counts.update(zip(missing, (len(e.ids) for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)), strict=True))
            return sum(map(self.counts.__getitem__, piece))

    def count(self, text: str) -> int:
        """Tokens of a text as the library gives them; special strings are one token each."""
        parts, total = [text], 0
        if self.special is not None and self.special.search(text):
            total = sum(1 for _ in self.special.finditer(text))
            parts = self.special.split(text)
        return total + sum(self._sum(piece) for part in parts for piece in pretokens(part))


_counters: dict[str, TokenCounter] = {}


def counter_of(path: str, whole: Iterable[str]) -> TokenCounter:
    """One for each Python worker, which serves many tasks."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = TokenCounter(path, whole)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs`` (doc_id, text).

    path: a byte-level tokenizer file that every executor can open at that place.
    Null texts are empty: 0 bytes and 0 tokens. Rows with null or repeated ids are
    counted like others. Extra columns are ignored; an empty table gives an empty
    result.
    """

    proved = docs.sparkSession.sparkContext.broadcast(sorted(whole_tokens(load(path))))  # the vocabulary's strings at most

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, proved.value)
        for batch in batches:
            texts = batch.column("text")
            n = [0 if t is None else counter.count(t) for t in (x.as_py() for x in texts)]
            sizes = [0 if b is None else b for b in pc.binary_length(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(releasing(counted), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
