"""SimHash near-duplicates: word-shingle fingerprints, pivot distance tables, components of links.

Links join fingerprints that differ in at most ``RADIUS`` bits. Documents are first reduced to distinct fingerprints.
Fingerprints that link agree on two of four 16-bit blocks, so one of six block pairs is an equal key. Among rows of a key
a table of Hamming distances to fixed reference fingerprints is compared: by the triangle inequality a pair is discarded
if any coordinate differs by more than the radius; survivors are verified bit by bit. A key that too many distinct
fingerprints share is not paired up: its members are linked through masked copies (every way to blank two bits gives a
key whose members are all within the radius of each other, so a star to the least of them keeps every connection), which
costs a fixed number of rows a fingerprint however large the key is.

Edge cases: a null text has no words; without words the fingerprint is zero, and such documents link like others; with
fewer words than a shingle holds, the whole sequence is the shingle; a null id never becomes a component's id unless the
component has no other; repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_slices, spread_join, utf8
from .components import connected_components

RADIUS = 2
#: Distinct fingerprints that may share a block key before they are linked through masked copies.
PAIRED = 128
#: Reference fingerprints: fixed pseudo-random numbers.
PIVOTS = [xxhash.xxh64_intdigest(b"pivot%d" % i, 7) for i in range(8)]
_PIECE = 1 << 15


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> list[int]:
    """XXH64 of every word shingle of the text, A-Z lower-cased (other letters are left alone)."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if n <= words:
        return [digest(join(parts), seed)]
    if words == 3:
        return [digest(b"%b %b %b" % t, seed) for t in zip(parts, parts[1:], parts[2:])]
    return [digest(join(parts[i : i + words]), seed) for i in range(n - words + 1)]


def fingerprint(hashes: list[int]) -> int:
    """Bits that are set in over half of the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _PIECE):  # bounds the memory of a very long text
        ones += np.unpackbits(h[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long) for every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("id"), utf8(text).alias("text")), fn, "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _coordinates(fp) -> list:
    return [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("byte").alias(f"p{i}") for i, p in enumerate(PIVOTS)]


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between the distinct fingerprints of column fp; enough of them to keep every connection."""
    if radius != 2:
        raise ValueError("the block pairs and masks are laid out for a radius of 2")
    masks = [sum(0xFFFF << 16 * b for b in pair) for pair in combinations(range(4), 2)]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    shared = scratch.write(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    small = keyed.join(shared.filter(F.col("n") <= PAIRED), ["t", "key"]).select("t", "key", "fp", *_coordinates(F.col("fp")))
    left, right = small.alias("l"), small.alias("r")
    near = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
    for i in range(len(PIVOTS)):
        near &= F.abs(F.col(f"l.p{i}").cast("int") - F.col(f"r.p{i}").cast("int")) <= radius
    near &= F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= radius
    pairs = left.join(right, near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    crowded = keyed.join(shared.filter(F.col("n") > PAIRED), ["t", "key"], "left_semi").select("fp").distinct()
    blank = F.array(*[F.lit(_signed(((1 << 64) - 1) ^ (1 << i) ^ (1 << j))) for i, j in combinations(range(64), 2)])
    masked = crowded.select("fp", F.posexplode(blank).alias("which", "mask")).select("fp", "which", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # Two blanked bits leave a key with four members at most, all within the radius of each other.
    groups = masked.groupBy("which", "key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = groups.select("a", F.explode("all").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, words, doc_id, text))
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("held")))
    parts = connected_components(links(distinct.select("fp"), scratch), scratch)
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", "held", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.write(rooted)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id", "held")
    return spread_join(prints, classes, "fp", "held", prints.count()).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
