"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary finds whole pre-tokens that are tokens
themselves. Tier two, for the rest: a heap over a linked list of bytes merges the
neighbours of lowest rank first, the leftmost of equals, until none can be merged.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, texts
from .chunk_tokens import ChunkCodec, Memo, spare_collector

_MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: n keys, n slots, one displacement for
    about two keys. Buckets are placed from the largest; those of one key take the free slots."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        grouped: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            grouped.setdefault(h % self.buckets, []).append((h, i))
        self.shift = [0] * self.buckets
        slots: list[int | None] = [None] * n
        single = []
        for b, group in sorted(grouped.items(), key=lambda g: -len(g[1])):
            if len(group) == 1:
                single.append((b, group[0][1]))
                continue
            d = 0
            while True:
                d += 1
                at = [self._slot(h, d) for h, _ in group]
                if len(set(at)) == len(at) and all(slots[a] is None for a in at):
                    break
                if d > 5_000_000:
                    raise ValueError("keys repeat, or their hashes do")
            self.shift[b] = d
            for a, (_, i) in zip(at, group, strict=True):
                slots[a] = i
        free = (a for a, s in enumerate(slots) if s is None)
        for b, i in single:
            a = next(free)
            slots[a], self.shift[b] = i, -a - 1
        self.keys = [keys[i] for i in slots]
        self.values = [values[i] for i in slots]

    def _slot(self, h: int, d: int) -> int:
        h = ((h >> 16) ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & _MASK
        return (h >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        a = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[a] if self.keys[a] == key else None


class BytePairs:
    """Ranks of tokens -> ids of texts and back. limit: pre-tokens whose ids are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 100_000):
        self.hash = PerfectHash(list(ranks), list(ranks.values()))
        self.token = {v: k for k, v in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        # (left, right) -> rank of both as one, for every cut of every token into two tokens.
        self.pairs = {(a, b): r for k, r in ranks.items() for i in range(1, len(k)) if (a := ranks.get(k[:i])) is not None and (b := ranks.get(k[i:])) is not None}
        find, words = regex.compile(pattern).findall, Memo(self.word, limit)
        self.codec = ChunkCodec(lambda chunk: b"".join(map(words.__getitem__, find(chunk))), keep=True, limit=250_000)
        self.encode = self.codec.encode

    def word(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.hash.get(raw)
        return array("I", self.merge(raw) if whole is None else (whole,)).tobytes()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token, in time n log n for any length."""
        pair, byte = self.pairs.get, self.byte
        ids = [byte[c] for c in word]
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # Heap entries are rank << 32 | place: the lowest rank first, then the leftmost.
        heap = [r << 32 | i for i, x in enumerate(zip(ids, ids[1:])) if (r := pair(x)) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            # Stale if either token has been merged since: then the pair has another rank, or none.
            if j >= n or (r := pair((ids[i], ids[j]))) is None or r != top >> 32:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := pair((r, ids[k]))) is not None:
                    heappush(heap, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := pair((ids[h], r))) is not None:
                heappush(heap, q << 32 | h)
        return [x for x in ids if x >= 0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, array("I", ids)))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One per worker process."""
    spare_collector()
    return BytePairs(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens (long) and ids (binary, little-endian unsigned 32-bit).

    path: a rank file that every executor can read (part of the installation, not of the data).
    Null and empty texts have no tokens; repeated rows give repeated rows, null ids
    stay null; other columns are ignored, whatever their names; an empty table gives no
    rows. No shuffle; a worker holds one text and tables of bounded size.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path, pattern)
        for b in slices(batches, 1):
            ids = [pairs.encode(t) for t in texts(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of encoded and the decoded bytes (binary). Null ids are decoded as none; an id
    outside the vocabulary fails the job."""
    names = [c for c in encoded.columns if c != out_col]
    slim = encoded.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(ids_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path, pattern)
        for b in slices(batches, at, 2 << 20):
            out = [pairs.decode(x or b"") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.mapInArrow(run, f"{schema}, `{out_col}` binary")
