"""Encoding of texts with a public byte-level BPE vocabulary.

Words are found by the vocabulary's own pattern and encoded with a contiguous rank array: part
boundaries and the rank of each adjacent pair lie in two flat lists; the least rank is found by
scanning, its boundary deleted and the two neighbouring ranks refreshed. A long word takes a heap
instead, whose cost doesn't grow with the square of its length. Results of short words are kept in a
bounded table of the worker.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import spread

TOKENIZERS = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# The pattern that belongs to the byte-level vocabularies, and what it is over ASCII.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = rb"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""

#: A line end between two visible ASCII characters, or with one space after it, is a word by itself,
#: and no word goes over it: texts may be cut there.
CUT = re.compile(r"(?<=[!-~])\n(?= ?[!-~])")
SHORT, KEPT_BYTES, KEPT_WORDS = 96, 48, 150_000
NONE = 1 << 40


class Encoder:
    """ids() and count() of a text under one vocabulary of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.wide = regex.compile(PATTERN).findall
        self.narrow = re.compile(ASCII_PATTERN).findall
        self.words = Words(self)

    def merge(self, word: bytes) -> tuple[int, ...]:
        known = self.ranks.get(word)
        if known is not None:
            return (known,)
        return self.scan(word) if len(word) <= SHORT else self.queue(word)

    def scan(self, word: bytes) -> tuple[int, ...]:
        get = self.ranks.get
        bound = list(range(len(word) + 1))
        rank = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while rank and (least := min(rank)) != NONE:
            i = rank.index(least)
            del bound[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(word[bound[i] : bound[i + 2]], NONE)
            if i:
                rank[i - 1] = get(word[bound[i - 1] : bound[i + 1]], NONE)
        return tuple([self.ranks[word[a:b]] for a, b in zip(bound, bound[1:])])

    def queue(self, word: bytes) -> tuple[int, ...]:
        """The same with the pairs in a heap and the parts in a linked list."""
        n, get = len(word), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts there
        pairs = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, j = heapq.heappop(pairs)
            mid = end[i]
            if mid < 0 or mid >= n or end[mid] != j:
                continue  # one of the two parts has changed
            end[i], end[mid] = j, -1
            if j < n:
                before[j] = i
                if (r := get(word[i : end[j]])) is not None:
                    heapq.heappush(pairs, (r, i, end[j]))
            if (h := before[i]) >= 0 and (r := get(word[h:j])) is not None:
                heapq.heappush(pairs, (r, h, j))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def pieces(self, text: str) -> list:
        """The text's words: bytes where it is ASCII, else strings."""
        if text.isascii():
            return self.narrow(text.encode())
        out: list = []
        for k, part in enumerate(CUT.split(text)):
            if k:
                out.append(b"\n")
            out += self.narrow(part.encode()) if part.isascii() else self.wide(part)
        return out

    def ids(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.words.__getitem__, self.pieces(text)))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.words.__getitem__, self.pieces(text))))


class Words(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: bytes | str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace") if isinstance(word, str) else word
        ids = self.encoder.merge(raw)
        if len(raw) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = BYTE_BPE_50K, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def encode(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids array<int> of every row.

    Empty and null texts give an empty list; white space is text; strings that look like special
    tokens are ordinary text. Other columns are ignored. A narrow operation over whole texts; the
    vocabulary is read by each worker from path, which must be there on every machine.
    """
    path = path or vocabulary()
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                flat, ends = array("i"), array("i", [0])
                for s in b.column(1).to_pylist():
                    if s:
                        flat.extend(own.ids(s))
                    ends.append(len(flat))
                ids = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, ids)], [key, "ids"])

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), df).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """key and n_tokens of every row; 0 for empty and null texts."""
    path = path or vocabulary()
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            n = [own.count(s) if s else 0 for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), df).mapInArrow(run, schema)
