"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens. Tier two: other pre-tokens are merged
from single bytes, lowest rank first, with a heap over a linked list of byte spans.

Edge cases: a null text encodes like an empty one (no ids); decoding returns the exact UTF-8 bytes of the text; ids are
little-endian unsigned 32-bit integers; rows are mapped one to one, so repeated rows stay and an empty table stays empty.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Pre-tokens that a worker remembers per generation; two generations are alive at most.
CACHE = 200_000


class PerfectHash:
    """Hash-and-displace minimal perfect hash: n keys, n slots; buckets of one key store their slot directly."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = r = max(1, n // 4)
        self.shift = np.zeros(r, dtype=np.int64)
        self.index = np.full(max(1, n), -1, dtype=np.int64)
        parts = [[] for _ in range(r)]
        for k, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            parts[h % r].append((h >> 20, (h >> 42) | 1, k))
        taken = bytearray(n)
        free = 0
        for b in sorted(range(r), key=lambda b: -len(parts[b])):
            own = parts[b]
            if not own:
                continue
            if len(own) == 1:
                while taken[free]:
                    free += 1
                slots, self.shift[b] = [free], -free - 1
            else:
                d = 0
                while True:
                    slots = [(f + d * s) % n for f, s, _ in own]
                    if len(set(slots)) == len(slots) and not any(taken[x] for x in slots):
                        break
                    d += 1
                self.shift[b] = d
            for slot, (_, _, k) in zip(slots, own, strict=True):
                taken[slot] = 1
                self.index[slot] = k
        self.shift, self.index = self.shift.tolist(), self.index.tolist()

    def slot(self, key: bytes) -> int:
        """Position of the only key that can be equal to ``key``."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.index[-d - 1 if d < 0 else ((h >> 20) + d * ((h >> 42) | 1)) % self.n]


class Vocabulary:
    """Ranked byte strings (id = rank) with both lookup tiers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self.packed = [np.uint32(ranks[k]).astype("<u4").tobytes() for k in self.keys]
        self.by_id = {i: k for k, i in ranks.items()}
        # The library's white space is Unicode's White_Space, which leaves out the separators \x1c-\x1f.
        self.pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def piece(self, piece: bytes) -> bytes:
        """Packed ids of one pre-token."""
        k = self.hash.slot(piece)
        return self.packed[k] if self.keys[k] == piece else self.merge(piece)

    def merge(self, piece: bytes) -> bytes:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the span that starts at i ends; 0 once it is absorbed
        before = list(range(-1, n))  # start of the span to the left
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= e or end[mid] != e:
                continue
            end[i], end[mid], before[e] = e, 0, i
            if e < n and (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
            j = before[i]
            if j >= 0 and (r := ranks.get(piece[j:e])) is not None:
                heapq.heappush(heap, (r, j, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return np.array(out, dtype="<u4").tobytes()

    def encoder(self):
        """A function from text to packed ids that remembers recent pre-tokens."""
        split = regex.compile(self.pattern).findall
        young: dict[str, bytes] = {}
        old: dict[str, bytes] = {}

        def miss(token: str) -> bytes:
            nonlocal young, old
            found = old.get(token)
            if found is None:
                found = self.piece(token.encode())
            if len(young) >= CACHE:
                old, young = young, {}
            young[token] = found
            return found

        def encode(text: str) -> bytes:
            return b"".join([young.get(t) or miss(t) for t in split(text)])

        return encode

    def decode(self, packed: bytes) -> bytes:
        by_id = self.by_id
        return b"".join([by_id[i] for i in np.frombuffer(packed, "<u4").tolist()])


def _mapped(df: DataFrame, source: str, target: str, make, null_as):
    """Adds the binary column ``target`` = make()(source); replaces a column of that name."""
    keep = [c for c in df.columns if c != target]
    kinds = [f.simpleString() for f in df.select(*[f"`{c}`" for c in keep]).schema.fields]
    renamed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    at = keep.index(source)
    types = ", ".join(f"c{i} {k.split(':', 1)[1]}" for i, k in enumerate(kinds))
    state: list = []

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(make())
        one = state[0]
        values = [one(null_as if x is None else x) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*batch.schema.names, "made"])

    out = map_slices(renamed, fn, f"{types}, made binary")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("made").alias(target))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (binary, packed) for the whole of every text. The vocabulary travels as one broadcast, whose size is that of its file."""
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)
    return _mapped(df, text, ids, lambda: shipped.value.encoder(), "")


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that the packed ids stand for; null ids give no bytes."""
    shipped = df.sparkSession.sparkContext.broadcast(vocabulary)
    return _mapped(df, ids, decoded, lambda: shipped.value.decode, b"")
