"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a stretch of text (many short texts, or a part of a very long
one), sorted, are a trie in depth-first order: words
that follow one another share a prefix. The encoding of a prefix is known from
its last token alone, for the tokens before it are the encoding of the shorter
prefix; a token may come last if it is a suffix of the prefix and stays apart
from the last token of what is left. So each trie node is settled once, from
nodes above it, however many words share it.
"""

from __future__ import annotations

import json
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .memory import releasing
from .token_counts import byte_alphabet, pretokens

_KEPT, _KEPT_PAIRS, _STRETCH = 200_000, 200_000, 400_000
_BATCH_CHARS = 2 << 20


class TrieBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        as_bytes = lambda name: bytes(back[c] for c in name)
        self.ids = {as_bytes(name): i for name, i in spec["model"]["vocab"].items()}
        self.texts: list[bytes] = [b""] * (max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])], default=-1) + 1)
        for text, i in self.ids.items():
            self.texts[i] = text
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: its halves and the rank of their merge
        for rank, (a, b) in enumerate(merges):
            left, right = as_bytes(a), as_bytes(b)
            pair = self.ids[left], self.ids[right]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(self.ids[left + right], (*pair, rank))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.texts[i] = content.encode()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lengths = defaultdict(set)
        for text in self.ids:
            self.lengths[text[-1:]].add(len(text))
        self.lengths = {last: sorted(sizes, reverse=True) for last, sizes in self.lengths.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one end of ``token`` while it is merged, each with the rank of the merge that ends it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            *halves, until = self.parts[token]
            token = halves[side]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens: none comes before the one that takes its left piece away, or with the right one's."""
        key = left, right
        if key not in self.apart:
            rights = self._edge(right, 0)
            self.apart[key] = not any(
                (rank := self.rank.get((a, b))) is not None and rank < a_until and rank <= b_until for a, a_until in self._edge(left, 1) for b, b_until in rights
            )
        return self.apart[key]

    def encode_words(self, words: Iterable[str]) -> None:
        """Keeps the packed ids of distinct words, walking their trie depth first."""
        todo = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        ids, lengths, stays_apart = self.ids, self.lengths, self.stays_apart
        before = b""
        last: list[int] = [-1]  # last token of each prefix of the word before
        for word, name in todo:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                for size in lengths[word[end - 1 : end]]:
                    if size > end:
                        continue
                    token = ids.get(word[end - size : end])
                    if token is not None and (size == end or stays_apart(last[end - size], token)):
                        last.append(token)
                        break
            before = word
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(self.texts[last[end]])
            out.reverse()
            self.kept[name] = array("I", out).tobytes()

    def _pieces(self, text: str) -> list[str]:
        return self.split_special.split(text) if self.split_special is not None else [text]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; special strings are their tokens."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes | list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self._pieces(text):
                if part in self.special:
                    held.append((k, array("I", [self.special[part]]).tobytes()))
                    continue
                for words in pretokens(part):
                    held.append((k, words))
                    size += len(words)
                    if size > _STRETCH:
                        self._encode_held(held, out)
                        held, size = [], 0
        self._encode_held(held, out)
        return [b"".join(parts) for parts in out]

    def _encode_held(self, held: list[tuple[int, bytes | list[str]]], out: list[list[bytes]]) -> None:
        """Appends the ids of each stretch's words to those of its text, all new words walked in one trie."""
        if len(self.kept) > _KEPT:
            self.kept = {}
        if len(self.apart) > _KEPT_PAIRS:
            self.apart = {}
        new = set().union(*(words for _, words in held if not isinstance(words, bytes))).difference(self.kept)
        if new:
            self.encode_words(new)
        for k, words in held:
            out[k].append(words if isinstance(words, bytes) else b"".join(map(self.kept.__getitem__, words)))

    def decode(self, ids: bytes) -> str:
        """Text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.texts.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(2)
def encoder_of(path: str) -> TrieBPE:
    """One for each Python worker, which serves many tasks."""
    return TrieBPE(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, ids (little-endian 32-bit numbers), n_tokens and decoded (text of the ids).

    path: a byte-level tokenizer file that every executor can open at that place.
    Null texts are empty: no ids, and an empty text again. Rows with null or
    repeated ids are encoded like others. Extra columns are ignored; an empty table
    gives an empty result.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = encoder_of(path)
        for batch in batches:
            at, texts, chars = 0, [], 0
            for k in range(batch.num_rows):
                texts.append(batch.column("text")[k].as_py() or "")
                chars += len(texts[-1])
                if chars > _BATCH_CHARS or k + 1 == batch.num_rows:
                    ids = trie.encode_batch(texts)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at, len(ids)), pa.array(ids, pa.binary()), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([trie.decode(b) for b in ids], pa.string())],
                        ["doc_id", "ids", "n_tokens", "decoded"],
                    )
                    at, texts, chars = k + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(releasing(encoded), f"doc_id {kind}, ids binary, n_tokens long, decoded string")
