"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased runs of letters and digits. For each benchmark item, windows of as many words are laid over a
document wherever the two share a shingle (a window that shares none has similarity zero). A window's SimHash is looked up
in a multi-index of the fingerprints of the items of its size: eight 8-bit blocks, each probed within two bits, which finds
every fingerprint within ``RADIUS`` (at most 23) bits. Candidates are verified by the exact weighted Jaccard similarity of
the shingle multisets; a shingle's weight grows with its rarity among the items.

The benchmark is dealt to blocks of bounded size. Each block's texts are broadcast, indexed by the workers that use it, and
run against all documents.

Edge cases: null texts and texts without words match nothing, as document or item; an item with fewer words than a shingle
is one shingle; items may have any type of id, a null one too; repeated items match alike; repeated documents give the same
row each; equal windows: the first one is reported; an empty table, of either kind, gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SLICE_ROWS

WORDS, THRESHOLD, RADIUS = 5, 0.8, 22
#: Text bytes of the items that are indexed at a time.
BLOCK_BYTES = 4 << 20
_BLOCKS, _PROBE = 8, 2
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_BITS = np.arange(64, dtype=np.uint64)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(parts: list[str], words: int) -> list[tuple[str, ...]]:
    return [tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []


def _print(bag: dict[tuple, float]) -> int:
    """SimHash of weighted shingles."""
    h = np.array([xxhash.xxh64_intdigest(" ".join(s)) for s in bag], np.uint64)
    signs = np.where((h[:, None] >> _BITS) & np.uint64(1), 1.0, -1.0)
    return int(np.packbits(np.array(list(bag.values())) @ signs > 0, bitorder="little").view(np.uint64)[0])


def similarity(a: dict[tuple, float], b: dict[tuple, float]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima."""
    low = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


@dataclass
class Item:
    item_id: object
    size: int
    bag: dict[tuple, float]
    fp: int


class Index:
    """Items of one block of the benchmark."""

    def __init__(self, rows: list[tuple[object, str]], words: int):
        self.words = words
        parts = [(i, words_of(t)) for i, t in rows]
        own = [(i, p, shingles(p, words)) for i, p in parts if p]
        seen = Counter(s for _, _, found in own for s in set(found))
        self.weight = {s: 1 + math.log(len(own) / n) for s, n in seen.items()}
        self.top = 1 + math.log(max(1, len(own)))
        self.items = [Item(i, len(p), b := self.bag(found), _print(b)) for i, p, found in own]
        self.word_ids: dict[str, int] = {}
        self.places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, _, found) in enumerate(own):
            for at, s in enumerate(found):
                self.places[s].append((k, at))
        for s in self.places:
            for w in s:
                self.word_ids.setdefault(w, len(self.word_ids) + 1)
        self.short = {len(s) for s in self.places if len(s) < words}
        self.grams = {n: np.unique(self.roll(np.array([[self.word_ids[w] for w in s] for s in self.places if len(s) == n], np.uint64).T)) for n in {len(s) for s in self.places}}
        self.tables = self.multi_index()

    @staticmethod
    def roll(columns: np.ndarray) -> np.ndarray:
        h = np.zeros(columns.shape[1], np.uint64)
        for c in columns:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def bag(self, found: list[tuple]) -> dict[tuple, float]:
        return {s: n * self.weight.get(s, self.top) for s, n in Counter(found).items()}

    def multi_index(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each size: the items, their fingerprints, and near[block, value]: which items' block is within two bits of value."""
        apart = np.array([[(u ^ v).bit_count() for v in range(256)] for u in range(256)]) <= _PROBE
        tables = {}
        for size in {item.size for item in self.items}:
            own = np.array([k for k, item in enumerate(self.items) if item.size == size])
            fps = np.array([self.items[k].fp for k in own], np.uint64)
            blocks = fps.view(np.uint8).reshape(-1, _BLOCKS)
            tables[size] = own, fps, np.stack([apart[:, blocks[:, b]] for b in range(_BLOCKS)])
        return tables

    def within(self, fp: int, size: int) -> list[int]:
        """All items of that size whose fingerprint differs in at most ``RADIUS`` bits."""
        own, fps, near = self.tables[size]
        found = np.flatnonzero(np.logical_or.reduce([near[b, fp >> 8 * b & 255] for b in range(_BLOCKS)]))
        return own[found[np.bitwise_count(fps[found] ^ np.uint64(fp)) <= RADIUS]].tolist()

    def hits(self, parts: list[str]):
        """(position, shingle) of the document's shingles that an item has."""
        get = self.word_ids.get
        ids = np.array([get(w, 0) for w in parts], np.uint64)
        for n, grams in self.grams.items():
            m = len(ids) - n + 1
            if m <= 0:
                continue
            whole = ids[:m] > 0
            for i in range(1, n):
                whole &= ids[i : i + m] > 0
            at = np.flatnonzero(whole)
            if len(at):
                h = self.roll(np.stack([ids[at + i] for i in range(n)]))
                k = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
                for p in at[grams[k] == h].tolist():
                    s = tuple(parts[p : p + n])
                    if s in self.places:
                        yield p, s

    def matches(self, text: str, threshold: float) -> list[tuple[object, int, int, int, float]]:
        """(item, first word, words, differing bits, similarity): the best window of each item that reaches the threshold."""
        if not self.items:
            return []
        parts = words_of(text)
        best: dict[int, tuple] = {}
        tried: set[tuple[int, int]] = set()
        for p, s in self.hits(parts):
            for k, at in self.places[s]:
                size = self.items[k].size
                start = min(max(0, p - at), max(0, len(parts) - size))
                if (size, start) in tried:
                    continue
                tried.add((size, start))
                bag = self.bag(shingles(parts[start : start + size], self.words))
                fp = _print(bag)
                for j in self.within(fp, size):
                    item = self.items[j]
                    sim = similarity(bag, item.bag)
                    if sim >= threshold - 1e-9 and (j not in best or (-sim, start) < best[j][:2]):
                        best[j] = (-sim, start, (item.fp ^ fp).bit_count())
        return [(self.items[j].item_id, start, self.items[j].size, bits, -low) for j, (low, start, bits) in sorted(best.items())]


def contaminations(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, bits, similarity: a row per document and item that it contains."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / BLOCK_BYTES))
    names = ["doc_id", "item_id", "start_word", "n_words", "bits", "similarity"]
    kinds = [docs.select(doc_id).schema[0].dataType.simpleString(), items.schema["i"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word int, n_words int, bits int, similarity double"
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("t is not null")
    kind = to_arrow_type(items.schema["i"].dataType)
    out = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        shipped = spark.sparkContext.broadcast(sorted(((r["i"], r["t"]) for r in rows), key=repr))

        def run(batches, shipped=shipped):
            index = Index(shipped.value, words)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    found = [(k, *m) for k, t in enumerate(part.column(1).to_pylist()) for m in index.matches(t, threshold)]
                    if found:
                        k, *cols = zip(*found, strict=True)
                        arrays = [part.column(0).take(pa.array(k, pa.int32())), pa.array(cols[0], kind), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.float64())]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out
