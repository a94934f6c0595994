"""Byte-level BPE: a hierarchical-bitmap rank queue merges each pre-token.

The queue has one bucket per merge rank; a bucket holds positions of a linked list of parts. Two levels of
256-bit words say which buckets have entries, so find-first-set gets the least rank in two steps however long
the pre-token is. Merges leave stale entries behind; they are skipped when they come up.

Edge cases: a null text is an empty one and gives no tokens; texts of any length are split as a stream; repeated
rows give repeated results; an empty table gives an empty one. The columns `tokens` and `decoded` replace columns
of those names; all others pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice
from struct import pack
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField

from .common import append

#: Pre-tokens of up to so many characters are remembered, this many at once, by each task.
REMEMBERED_CHARS, REMEMBERED = 40, 600_000
WIDE = re.compile("[^\x00-\xff]")


def narrow(pattern: str) -> re.Pattern[str]:
    """The pattern for texts of the first 256 code points, with its classes spelt out: `re` is twice as fast."""
    chars = [chr(c) for c in range(256)]
    spelt = {c: "".join(re.escape(x) for x in chars if regex.fullmatch(c, x)) for c in (r"\s", r"\p{L}", r"\p{N}")}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern):
        inside = part == "[" or inside and part != "]"
        part = f"[^{spelt[r'\s']}]" if part == r"\S" else spelt[part] if inside and part in spelt else f"[{spelt[part]}]" if part in spelt else part
        out.append(part)
    return re.compile("".join(out))


class RankQueue:
    """The state of the queue: buckets by rank, and bits of those that have entries; empty after each pre-token."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * ((ranks >> 8) + 1)


class Vocabulary:
    """Ranks of byte strings, and the pattern that splits text into pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split, self.split_narrow = regex.compile(pattern), narrow(pattern)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}
        self.queue = RankQueue(len(self.tokens))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # the part at i is piece[i:end[i]]; the next part starts at end[i]
        before = list(range(-1, n))
        pending = [-1] * (n + 1)  # the rank for which the part at i and the next one now wait
        get, buckets, low, top = ranks.get, self.queue.buckets, self.queue.low, 0
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pending[i] = rank
                buckets[rank].append(i)
                low[rank >> 8] |= 1 << (rank & 255)
                top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1  # find first set, level by level
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pending[i] != rank:
                continue  # stale
            gone = end[i]
            j = end[i] = end[gone]
            pending[gone] = pending[i] = -1
            if j < n:
                before[j] = i
                rank = get(piece[i : end[j]])
                if rank is not None:
                    pending[i] = rank
                    heappush(buckets[rank], i)
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
            if i:
                i = before[i]
                rank = get(piece[i:j])
                if rank is None:
                    pending[i] = -1
                else:
                    pending[i] = rank
                    heappush(buckets[rank], i)
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        ids, i = [], 0
        while i < n:
            j = end[i]
            ids.append(ranks[piece[i:j]])
            i = j
        return ids

    def packed(self, pre: str) -> bytes:
        made = self.merge(pre.encode())
        ids = pack(f"<{len(made)}I", *made)
        if len(pre) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[pre] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        known, packed, parts = self.known.get, self.packed, []
        split = self.split if WIDE.search(text) else self.split_narrow
        found = (m.group() for m in split.finditer(text)) if len(text) > 1 << 20 else iter(split.findall(text))
        while some := list(islice(found, 1 << 16)):
            parts.append(b"".join([known(p) or packed(p) for p in some]))
        return b"".join(parts)

    def decode(self, packed: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


#: The vocabularies of this Python worker.
loaded: WeakSet[Vocabulary] = WeakSet()


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once by each Python worker."""
    loaded.add(made := Vocabulary(path, pattern))
    return made


def forget() -> None:
    """Empties the memory of pre-tokens: Python workers live on, and later steps have other uses for it."""
    for v in loaded:
        v.known.clear()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds `tokens`: the ids of each whole text, packed as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        v = vocabulary(path, pattern)
        return [pa.array([v.encode(x.as_py() or "") for x in batch.column(text)], pa.binary())]

    return append(docs, [StructField("tokens", BinaryType())], run, forget)


def decode(docs: DataFrame, path: str, pattern: str, tokens: str = "tokens") -> DataFrame:
    """Adds `decoded`: the bytes for which the ids stand; null ids give none."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        v = vocabulary(path, pattern)
        return [pa.array([v.decode(x.as_py() or b"") for x in batch.column(tokens)], pa.binary())]

    return append(docs, [StructField("decoded", BinaryType())], run)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """encode() and decode() in one pass, so that a task holds one Python worker and one vocabulary."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        v = vocabulary(path, pattern)
        tokens = [v.encode(x.as_py() or "") for x in batch.column(text)]
        return [pa.array(tokens, pa.binary()), pa.array([v.decode(t) for t in tokens], pa.binary())]

    return append(docs, [StructField("tokens", BinaryType()), StructField("decoded", BinaryType())], run, forget)


def ids(packed: bytes) -> Iterator[int]:
    """The ids of a `tokens` value."""
    return iter(np.frombuffer(packed, "<u4").tolist())
