"""Substring dedup with repeated-phrase automata.

A phrase is a window of ``WINDOW`` consecutive words. Each word is removed that lies in a phrase which also starts earlier
(in a document of smaller id, or earlier in the same one); phrases are judged on the input.

1. Candidates. The anchor of a phrase is its ``GRAM``-word gram of least hash, so equal phrases have equal anchors. Anchors
   that only one text holds, and it once, can't belong to a recurring phrase. Exact copies of an earlier text are settled
   by their hash: every phrase in them starts earlier.
2. Confirmation. Phrases with a recurring anchor are hashed (96 bits); a phrase recurs if several documents hold it, or one
   holds it twice. The least id that holds it is its first document.
3. Location. Each document gets its confirmed phrases that start elsewhere or repeat. They are compiled, shard by shard of
   documents, into Aho-Corasick automata over word numbers; every document of the shard is streamed through, which locates
   every occurrence, and the covered words are cut.

Edge cases: words are split at ASCII white space and left unchanged; a null or empty text has no words; texts of fewer than
``WINDOW`` words stay whole; a null id sorts last; rows that share an id, or have none, go by their text's hash; rows of equal
id and text are one document, neither earlier than the other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_slices, single_ids, utf8

WINDOW, GRAM = 20, 6
#: Phrases per automaton.
SHARD = 10_000
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_KNOWN = 150_000


#: Hashes of words that this worker has met lately.
_known: dict[bytes, bytes] = {}


def word_hashes(parts: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_known) > _KNOWN:
        _known.clear()
    get, digest = _known.get, xxhash.xxh64_digest

    def miss(w: bytes) -> bytes:
        _known[w] = h = digest(w, 1)
        return h

    return np.frombuffer(b"".join([get(w) or miss(w) for w in parts]), ">u8").astype(np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), mod 2**64."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 18), base, np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.multiply.accumulate(known)
    return known[:n]


_INVERSE = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES}


def rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash, mod 2**64, of every run of n hashes."""
    m = len(h)
    total = np.zeros(m + 1, np.uint64)
    np.add.accumulate(h * _powers(_INVERSE[int(base)], m), out=total[1:])
    return (total[n:] - total[:-n]) * _powers(base, m)[: m - n + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _BASES[0]
    return x ^ (x >> np.uint64(29))


#: Low bits of a gram's key that hold its place; the hash bits above decide, the leftmost of equals wins.
_PLACE = np.uint64((1 << 24) - 1)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase of the hashed words, where its anchor starts and the anchor's hash."""
    if len(h) > 1 << 23:  # places would overflow: by overlapping halves
        half = len(h) // 2
        (a, x), (b, y) = anchors(h[: half + WINDOW - 1]), anchors(h[half:])
        return np.concatenate([a, b + half]), np.concatenate([x, y])
    grams = _mix(rolled(h, GRAM, _BASES[0]))
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, step = WINDOW - GRAM + 1, 1
    while 2 * step <= span:  # minima over 2, 4, 8, ... grams
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: len(low) - span + step], low[span - step :])
    at = (low & _PLACE).astype(np.int64)
    return at, grams[at]


def cut(parts: list[bytes], covered: np.ndarray | None) -> tuple[int, str]:
    """How many words go, and the digest of those that stay."""
    kept = parts if covered is None else [w for w, gone in zip(parts, covered.tolist(), strict=True) if not gone]
    return len(parts) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


class Automata:
    """Phrases of a shard of documents, as automata of at most ``SHARD`` phrases each."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.first: dict[tuple[int, ...], int] = {}

    def number(self, parts: list[bytes]) -> tuple[int, ...]:
        numbers = self.numbers
        return tuple([numbers.setdefault(w, len(numbers) + 1) for w in parts])

    def add(self, text: tuple[int, ...], at: int, first: int) -> None:
        self.first[text[at : at + WINDOW]] = first

    def compiled(self):
        phrases = list(self.first.items())
        for at in range(0, len(phrases), SHARD):
            one = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for k, (phrase, first) in enumerate(phrases[at : at + SHARD]):
                one.add_word(phrase, (k, first))
            one.make_automaton()
            yield one


def locate(automaton, text: tuple[int, ...], doc: int, starts: np.ndarray) -> None:
    """Marks in ``starts`` where phrases start that also start earlier."""
    met = set()
    for end, (k, first) in automaton.iter(text):
        if first < doc or k in met:
            starts[end - WINDOW + 1] = True
        met.add(k)


def _cover(starts: np.ndarray) -> np.ndarray:
    edge = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


def _grams(docs: DataFrame) -> DataFrame:
    """d, t, h: the distinct anchors of each document with its text's hash (63 bits of it); an anchor that it repeats also with the last bit set."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [text.split() for text in batch.column(2).to_pylist()]
        sizes = np.array([len(p) for p in split])
        of = np.repeat(np.arange(len(split)), sizes)  # document of each word
        if len(of) >= WINDOW:
            at, own = anchors(word_hashes([w for p in split for w in p]))
            inside = of[: len(at)] == of[WINDOW - 1 :]
            at, first = np.unique(at[inside], return_index=True)
            own, of = own[inside][first], of[at]
        else:
            own, of = np.zeros(0, np.uint64), of[:0]
        order = np.lexsort((own, of))
        own, of = own[order], of[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
        again = np.zeros(len(own), bool)
        again[1:] = ~new[1:] & new[:-1]  # the second time only
        d, t = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        h = np.concatenate([own[new], own[again]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[of[new]], d[of[again]]])), pa.array(np.concatenate([t[of[new]], t[of[again]] ^ 1])), pa.array(h.view(np.int64))], names=["d", "t", "h"])

    return map_slices(docs.select("d", "t", "text"), fn, "d long, t long, h long")


def _phrases(joined: DataFrame) -> DataFrame:
    """Of documents with their recurring anchors: settled rows (digest set), texts (text set) and candidate phrases (w set)."""
    schema = "d long, doc_id {0}, n_words long, n_removed long, kept string, text binary, w long, v int, pos int, again boolean"
    kind = joined.schema["doc_id"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = [], []
        for i, (doc, text, grams, copy) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("d", "text", "grams", "copy")], strict=True)):
            parts = text.split()
            n = len(parts)
            if n < WINDOW or not grams and not copy:
                rows.append((i, n, *cut(parts, None), None))
            elif copy:
                rows.append((i, n, *cut(parts, np.ones(n, bool)), None))
            else:
                h = word_hashes(parts)
                _, own = anchors(h)
                known = np.sort(np.array(grams, np.int64).view(np.uint64))
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
                w = rolled(h, WINDOW, _BASES[0])[at]
                order = np.argsort(w, kind="stable")
                w, at = w[order], at[order]
                new = np.ones(len(w), bool)
                new[1:] = w[1:] != w[:-1]
                last = np.append(np.flatnonzero(new)[1:], len(w)) - np.flatnonzero(new) > 1
                v = rolled(h, WINDOW, _BASES[1])[at[new]]
                found.append((np.full(int(new.sum()), doc, np.int64), w[new], (v >> np.uint64(32)).astype(np.uint32), at[new].astype(np.int32), last))
                rows.append((i, n, None, None, text))
        m = sum(len(f[0]) for f in found)
        k = pa.array([r[0] for r in rows], pa.int32())
        null = lambda t: pa.nulls(len(rows), t)
        a = [batch.column("d").take(k), batch.column("doc_id").take(k), *[pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.binary()))], null(pa.int64()), null(pa.int32()), null(pa.int32()), null(pa.bool_())]
        names = ["d", "doc_id", "n_words", "n_removed", "kept", "text", "w", "v", "pos", "again"]
        if m:
            d, w, v, pos, again = [np.concatenate(c) for c in zip(*found, strict=True)]
            b = [pa.array(d), *[pa.nulls(m, x.type) for x in a[1:6]], pa.array(w.view(np.int64)), pa.array(v.view(np.int32)), pa.array(pos), pa.array(again)]
            a = [pa.concat_arrays([x, y]) for x, y in zip(a, b, strict=True)]
        return pa.RecordBatch.from_arrays(a, names=names)

    return map_slices(joined, fn, schema.format(kind))


def _located(texts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of documents with the starts (and first documents) of their confirmed phrases."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        automata, split, numbered = Automata(), [t.split() for t in batch.column("text").to_pylist()], []
        for parts, phrases in zip(split, batch.column("phrases").to_pylist(), strict=True):
            text = automata.number(parts) if phrases else None
            numbered.append(text)
            for p in phrases or ():
                automata.add(text, p["pos"], p["first"])
        starts = [None if t is None else np.zeros(len(t), bool) for t in numbered]
        for one in automata.compiled():
            for doc, text, s in zip(batch.column("d").to_pylist(), numbered, starts, strict=True):
                if s is not None:
                    locate(one, text, doc, s)
        done = [cut(parts, None if s is None else _cover(s)) for parts, s in zip(split, starts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(p) for p in split], pa.int64()), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_slices(texts, fn, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "substring")
    source = single_ids(docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text")), "d", "doc_id", "text", scratch)
    hashed = source.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))}).withColumn("t", F.col("h2").bitwiseAND(F.lit(-2)))
    # One shuffle serves count and join. A gram has one row a document (two if it repeats it): at most as many as there are
    # documents, which a window streams and spills.
    by = Window.partitionBy("h")
    held = _grams(hashed).withColumns({"low": F.min("t").over(by), "high": F.max("t").over(by)}).filter("low <> high").select("d", "h")
    texts = hashed.groupBy("h1", "h2").agg(F.min("d").alias("first"))
    copies = hashed.select("h1", "h2", "d").join(texts, ["h1", "h2"]).filter("d > first").select("d", F.lit(None).cast("long").alias("h"), F.lit(True).alias("copy"))
    known = held.select("d", "h", F.lit(False).alias("copy")).union(copies).groupBy("d").agg(F.collect_set("h").alias("grams"), F.max("copy").alias("copy"))
    joined = source.join(known, "d", "left").select("d", "doc_id", "text", "grams", F.coalesce("copy", F.lit(False)).alias("copy"))
    rows = scratch.write(_phrases(joined))

    phrases = rows.filter("w is not null").select("d", "w", "v", "pos", "again")
    confirmed = phrases.groupBy("w", "v").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.max("again").alias("twice")).filter("first < last or twice").select("w", "v", "first")
    own = phrases.join(confirmed, ["w", "v"]).filter("first < d or again").groupBy("d").agg(F.collect_list(F.struct("pos", "first")).alias("phrases"))
    located = _located(rows.filter("text is not null").select("d", "doc_id", "text").join(own, "d", "left"))
    settled = rows.filter("kept is not null").select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    return settled.union(located)
