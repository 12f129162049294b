"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words (split at ASCII white space). A line is removed if an earlier line (smaller document id, or
the same document and a smaller line number) has a Jaccard similarity of 0.8 or more; lines are judged on the input, not on
what is left. Equal sets are first reduced to their earliest line. The words of the others are ordered by rarity (measured
counts of hashed words over all lines, then hash); two similar lines share a word in their prefixes, so prefixes are joined,
with filters on order, length, position and a bitmap of the set. Each word turns one bit of the bitmap, so two sets differ in
as many words as their bitmaps do in bits, or more: unlike a bitmap of words that are present, it doesn't fill up as lines
grow, and what passes is nearly always similar. Candidates are verified on the words themselves.

Copies of a line that differ here and there share their prefixes, and pairing them all up would cost the square of their
number. So each line is first compared with the earliest line of each of its prefix words that is as long; only lines that
this leaves unmatched are then joined with all others. No partner is dropped, and a line that has a match needs no other.

Edge cases: lines without words stay, as do null texts (no lines) and empty ones; up to three words, only equal sets are
similar; a null id sorts last; rows that share an id, or have none, go by their text's hash; rows of equal id and text are
one document; an empty table gives an empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, single_ids

#: Hashed words are counted in so many classes.
CLASSES = 1 << 16

#: A word of a class that counts more is frequent: its lines are dealt to PIECES pieces where each is compared with a leader.
PIECE, PIECES = 1 << 18, 64


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _spaced(line: Column) -> Column:
    """The line's pieces between ASCII white space, empty ones included."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\f"))
    return F.split(F.when(odd, F.translate(line, "\t\r\x0b\f", "    ")).otherwise(line), " ")


def _worded(line: Column) -> Column:
    return F.regexp_like(line, F.lit("[^ \t\x0b\f\r\n]"))


def _words(line: Column) -> Column:
    """Distinct words of a line."""
    return F.array_distinct(F.array_remove(_spaced(line), ""))


def _at_least(n: Column) -> Column:
    """ceil(0.8 n)"""
    return F.ceil(n * 4 / 5).cast("int")


def _class(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(CLASSES - 1)).cast("int")


def _each(base: DataFrame) -> DataFrame:
    return base.select("d", F.posexplode(_split(F.col("text"))).alias("l", "line"))


def _ranks(base: DataFrame) -> tuple[Column, int]:
    """An array literal with the rank by count (0: rarest) of each class of hashed words, over all texts, times 2^32; the first rank of more than ``PIECE``."""
    words = _each(base).select(F.explode(_spaced(F.col("line"))).alias("w"))
    counts = words.groupBy(_class(F.xxhash64("w")).alias("c")).count().collect()  # CLASSES rows at most
    rank = [0] * CLASSES
    for r, row in enumerate(sorted(counts, key=lambda row: (row["count"], row["c"]))):
        rank[row["c"]] = r
    frequent = sum(row["count"] <= PIECE for row in counts)
    return F.split(F.lit(",".join(str(r << 32) for r in rank)), ",").cast("array<long>"), frequent


def _folded(of: str, bit) -> Column:
    """Exclusive or of ``bit`` of each element."""
    return F.aggregate(of, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(bit(k)))


def _sets(base: DataFrame) -> DataFrame:
    """The earliest line of each set of words: d, l, n, bitmap (b1, b2), prefix (words by rarity) and how many of it are not frequent."""
    ranks, frequent = _ranks(base)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    low, n = F.lit((1 << 32) - 1), F.size("k")
    # Hashes are quicker to compare than words. A filter on n would be pushed down and split each line once more.
    words = F.array_remove(F.array_distinct(F.transform(_spaced(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    hashed = _each(base).filter(_worded(F.col("line"))).select("d", "l", words.alias("k"))
    # Keys of the words: rank above, hash below; sorted, the rarest come first.
    order = F.sort_array(F.transform("k", lambda k: F.coalesce(F.get(ranks, _class(k)), none).bitwiseOR(F.shiftrightunsigned(k, 32))))
    prefix = F.when(n > 3, F.slice(order, F.lit(1), n - _at_least(n) + 1)).otherwise(F.array().cast("array<long>"))
    # A word turns one bit of 128: sets differ in as many words as bits, at least.
    bit = lambda upper: lambda k: F.when(k.bitwiseAND(F.lit(64)) == upper, F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int"))).otherwise(none)
    folded = hashed.select("d", "l", n.alias("n"), _folded("k", lambda k: k).alias("h"), _folded("k", bit(0)).alias("b1"), _folded("k", bit(64)).alias("b2"), prefix.alias("keys"))
    # Thirty-one bits of a word's hash name it from here on: a clash costs a comparison, nothing else.
    named = F.transform("keys", lambda k: k.bitwiseAND(low).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    rare = F.size(F.filter("keys", lambda k: k < F.lit(frequent << 32)))
    # Equal sets are those whose folded hash, bitmap and size are equal: 192 bits and more.
    first = folded.groupBy("h", "b1", "b2", "n").agg(F.min(F.struct("d", "l", "keys")).alias("x")).select("x.*", "n", "b1", "b2")
    return first.select("d", "l", "n", "b1", "b2", named.alias("prefix"), rare.alias("rare"))


def _near(n: Column, m: Column, differ: Column) -> Column:
    """Bitmap and length filter: similar sets differ in a ninth of n + m words at most, and their bitmaps in as few bits."""
    return (9 * differ <= n + m) & (5 * F.least(n, m) >= 4 * F.greatest(n, m))


def _places(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Position filter: the first common word has the others behind it, and all are four ninths of n + m at least."""
    return 9 * F.least(n - i, m - j) >= 4 * (n + m)


def _verified(pairs: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame:
    """d, l of the pairs (d, l, e, k) of lines that are similar, by their words."""
    pairs = scratch.write(pairs)
    ids = pairs.select("d", "l").union(pairs.select(F.col("e").alias("d"), F.col("k").alias("l"))).distinct().groupBy("d").agg(F.collect_list("l").alias("of"))
    each = base.join(ids, "d").select("d", "of", F.posexplode(_split(F.col("text"))).alias("l", "line"))
    texts = scratch.bucketed(each.filter(F.array_contains("of", F.col("l"))).select("d", "l", "line"), "d", "l")
    other = texts.select(F.col("d").alias("e"), F.col("l").alias("k"), F.col("line").alias("other"))

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts, ["d", "l"]).join(other, ["e", "k"]).select("d", "l", _words(F.col("line")).alias("x"), _words(F.col("other")).alias("y"))
        return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("d", "l").distinct()

    # Most lines that match any do so at their earliest candidate; the others count only for lines that don't.
    earliest = pairs.groupBy("d", "l").agg(F.min(F.struct("e", "k")).alias("y")).select("d", "l", "y.e", "y.k")
    matched = scratch.write(similar(earliest))
    second = pairs.join(matched, ["d", "l"], "left_anti").join(earliest, ["d", "l", "e", "k"], "left_anti")
    out = scratch.write(matched.union(similar(second)))
    scratch.discard(texts)
    return out


def near_removed(sets: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame:
    """d, l of the lines in ``sets`` that have an earlier similar one."""
    entries = lambda of, *more: of.filter(F.size("prefix") > 0).select("d", "l", "n", "b1", "b2", *more, F.posexplode("prefix").alias("i", "word"))
    # A line number and a small one fit in one number, and so do a word, a piece and a length: narrow rows, and a key that sorts fastest.
    at = lambda of: F.shiftleft(F.col("l").cast("long"), 32).bitwiseOR(of.cast("long"))
    line = lambda of: F.shiftright(of, 32).cast("int")
    low = lambda of: of.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    earlier = lambda d, l, e, k: (e < d) | ((e == d) & (k < l))

    # One leader for each word and class of lengths; a frequent word's lines are dealt to pieces, each with a leader of its own.
    piece = F.when(F.col("i") >= F.col("rare"), F.pmod(F.xxhash64("d", "l"), F.lit(PIECES))).otherwise(0)
    length = F.floor(F.log(F.col("n")) * 10)
    key = F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(F.shiftleft(piece, 26)).bitwiseOR(length)
    keyed = entries(sets, "rare").select(key.alias("key"), "d", at(F.col("n")).alias("at"), "b1", "b2")
    lead = F.min(F.struct("d", "at", "b1", "b2")).over(Window.partitionBy("key"))
    led = keyed.select("d", "at", "b1", "b2", lead.alias("y"))
    differ = F.bit_count(F.col("b1").bitwiseXOR(F.col("y.b1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("y.b2")))
    led = led.filter(earlier(F.col("d"), line(F.col("at")), F.col("y.d"), line(F.col("y.at"))) & _near(low(F.col("at")), low(F.col("y.at")), differ))
    matched = _verified(led.select("d", line(F.col("at")).alias("l"), F.col("y.d").alias("e"), line(F.col("y.at")).alias("k")).distinct(), base, scratch)

    done = matched.select("d", "l", F.lit(True).alias("done"))
    # Matched lines are only partners from here on, which a negative n says: both sides of the join then read the same entries, and share a shuffle.
    marked = scratch.write(sets.join(done, ["d", "l"], "left").withColumn("n", F.when(F.col("done"), -F.col("n")).otherwise(F.col("n"))).drop("done"))
    packed = entries(marked).select("word", "d", at(F.col("i")).alias("at"), "n", "b1", "b2")
    x, y = (lambda name: F.col(f"x.{name}")), (lambda name: F.col(f"y.{name}"))
    n, m = F.abs(x("n")), F.abs(y("n"))
    differ = F.bit_count(x("b1").bitwiseXOR(y("b1"))) + F.bit_count(x("b2").bitwiseXOR(y("b2")))
    before = earlier(x("d"), line(x("at")), y("d"), line(y("at")))
    met = (x("word") == y("word")) & (x("n") * m > 0) & before & _near(n, m, differ) & _places(n, low(x("at")), m, low(y("at")))
    rest = packed.alias("x").join(packed.alias("y"), met)
    late = rest.select(x("d").alias("d"), line(x("at")).alias("l"), y("d").alias("e"), line(y("at")).alias("k")).distinct()
    return matched.union(_verified(late, base, scratch))


def kept_lines(base: DataFrame, scratch: Scratch) -> DataFrame:
    """d, l: the lines with words that stay. base: d and text, bucketed by d."""
    sets = scratch.write(_sets(base))
    return sets.select("d", "l").join(near_removed(sets, base, scratch), ["d", "l"], "left_anti")


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (their numbers from 0, comma-separated) for every row."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = scratch.bucketed(single_ids(rows, "d", "doc_id", "text", scratch), "d")
    kept = kept_lines(base.select("d", "text"), scratch).groupBy("d").agg(F.collect_list("l").alias("kept"))
    lines, none = _split(F.col("text")), F.array().cast("array<int>")
    worded = F.array_compact(F.transform(lines, lambda line, i: F.when(_worded(line), i)))
    own = base.select("doc_id", "d", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n"), F.coalesce(worded, none).alias("worded"))
    both = own.join(kept, "d", "left").withColumn("gone", F.sort_array(F.array_except("worded", F.coalesce("kept", none))))
    return both.select("doc_id", F.col("n").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed_lines"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``."""
    scratch = Scratch(docs.sparkSession, "lines")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index(text)]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    base = scratch.bucketed(single_ids(rows, "d", names[docs.columns.index(doc_id)], own, scratch), "d")
    kept = kept_lines(base.select("d", F.col(own).alias("text")), scratch).groupBy("d").agg(F.collect_list("l").alias("kept"))
    stays = lambda line, i: ~_worded(line) | F.coalesce(F.array_contains("kept", i), F.lit(False))
    out = base.join(kept, "d", "left").withColumn(own, F.array_join(F.filter(_split(F.col(own)), stays), "\n"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
