"""Periodic runs, vector codes and license scans against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import licenses, periodic, registry, vectorcodes

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def words_with_runs(rng, n, letters):
    w = [f"w{x}" for x in rng.integers(0, letters, n)]
    for _ in range(int(rng.integers(0, 4))):
        p = int(rng.integers(1, max(2, n // 4)))
        a = int(rng.integers(0, n))
        m = int(rng.integers(1, n + 1))
        w[a : a + m] = [w[(a + (i % p)) % n] for i in range(len(w[a : a + m]))]
    return w


def test_runs_equal_a_plain_scan():
    rng, met = np.random.default_rng(11), 0
    for _ in range(400):
        w = [x.encode() for x in words_with_runs(rng, int(rng.integers(1, 260)), int(rng.choice([1, 2, 3, 50, 1000])))]
        got = periodic.runs_of(w)
        assert got == plain_runs(w)
        met += len(got)
    assert met > 150


def test_runs_of_long_texts(monkeypatch):
    """Beyond the table, in pieces."""
    rng = np.random.default_rng(5)
    w = [str(x).encode() for x in rng.integers(0, 5000, 9000)]
    w[100:4000] = [w[100 + i % 1300] for i in range(3900)]
    w[5000:5400] = [b"a", b"b"] * 200
    want = plain_runs(w)
    assert len(want) == 2 and periodic.runs_of(w) == want
    monkeypatch.setattr(periodic, "TABLE", 1000)
    monkeypatch.setattr(periodic, "PIECE", 5000)
    monkeypatch.setattr(periodic, "_tables", [])
    assert periodic.runs_of(w) == want


def test_clashing_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(periodic, "_mixed", lambda ids: (ids % 2).astype(np.uint64))
    rng = np.random.default_rng(2)
    for _ in range(60):
        w = [x.encode() for x in words_with_runs(rng, 150, 4)]
        assert periodic.runs_of(w) == plain_runs(w)


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(words_with_runs(rng, int(rng.integers(1, 400)), int(rng.choice([2, 40, 900]))))) for i in range(150)]
    rows += [(None, "a b " * 30), (None, None), (7, ""), (8, " \n\t\x0b\f\r "), (3, rows[3][1]), (3, "x y\x1cz " * 40), (11, "é " * 9000), (12, "q"), (20, None)]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    got = Counter(tuple(r) for r in got.collect())
    assert got == Counter(plain_row(*r) for r in rows) and sum(r[1] > 0 for r in got) > 20


def test_runs_keep_other_columns(spark):
    df = spark.createDataFrame([("a b " * 20, 5, [1.0], None)], "body string, Runs_ int, x array<double>, n string")
    r = periodic.find(df, "body", n_words="m").first()
    assert (r["Runs_"], r["x"], r["n"], r["m"], r["best"]["period"], r["collapsed"]) == (5, [1.0], None, 40, 2, "a b")
    assert periodic.find(df.limit(0), "body").count() == 0
    with pytest.raises(ValueError):
        periodic.find(df.withColumn("BEST", F.lit(1)), "body")


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(int(x) * 4096 if abs(x) > 1e15 else x * 4096) for x in r[1]] for r in kept]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in ints] for p in range(parts)]
    books = [c[:entries] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(x, books[p])[1] for x in cut[p]]
            for e in range(len(books[p])):
                own = [x for x, k in zip(cut[p], of, strict=True) if k == e]
                if own:
                    books[p] = [*books[p][:e], [sum(c) // len(own) for c in zip(*own, strict=True)], *books[p][e + 1 :]]
    ends = [[near(x, books[p]) for x in cut[p]] for p in range(parts)]
    error = [sum(ends[p][i][0] for p in range(parts)) for i in range(len(kept))]
    of_label = Counter()
    for r, e in zip(kept, error, strict=True):
        of_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    long = lambda x: x if x < 1 << 63 else None
    return Counter((r[0], "".join(f"{ends[p][i][1]:02x}" for p in range(parts)), long(error[i]), long(of_label[r[2]]), sha) for i, r in enumerate(kept))


@pytest.mark.parametrize("scale", [0.2, 40.0, 1e200])
def test_vector_codes_equal_plain_lloyd(spark, tmp_path, scale):
    rng = np.random.default_rng(4)
    grid = scale <= 1
    make = lambda: [float(x) for x in (rng.integers(-3, 4, 16) / 8 * scale if grid else rng.normal(size=16) * scale)]
    rows = [(int(i), make(), int(i % 4) if i % 5 else None) for i in rng.permutation(90)]
    same = make()
    rows += [(5, same, 1), (5, same, 1), (None, same, 2), (200, same, None), (201, None, 1), (202, [*same[:15], None], 1), (203, [*same[:15], float("nan")], 1), (204, [*same[:15], float("inf")], 2), (205, [], 1), (206, [0.0, -0.0] * 8, 3)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, part string, held int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(r) for r in registry.QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect())
    assert got == plain_codes([r for r in rows if r[1] != []])


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(2, [1.0] * 8, "a"), (1, [2.0] * 8, None), (3, [1.0] * 7, "a"), (4, [5.0] * 16, "b")], "vec_id int, embedding array<float>, label string")
    coded, books = vectorcodes.compress(df)
    got = {r.vec_id: (r.codes, r.error) for r in vectorcodes.label_errors(coded).collect()}
    assert got == {1: ([0] * 8, 0), 2: ([1] * 8, 0)} and [len(b) for b in books] == [2] * 8
    assert vectorcodes.label_errors(vectorcodes.compress(df.limit(0))[0]).count() == 0


def test_limbs():
    for x in (0, 1, -1, 2**31, -(2**32), 2**63, -(2**63), 3**200, -(7**150)):
        parts = vectorcodes.limbs(x)
        assert sum(v << 32 * k for k, v in enumerate(parts)) == x and all(-(2**63) <= v < 2**63 for v in parts)


def test_codes_and_licenses_equal_their_sql(spark):
    con = duckdb.connect()
    for name, table in (("op12_vector_codes", "embeddings"), ("op13_license_scans", "documents")):
        for sf in (SF, "/root/testdata/sf0.01"):
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
            df = registry.QUERIES[name](spark, sf)
            rel = con.execute(registry.ORACLE_SQL[name])
            cols = [d[0] for d in rel.description]
            assert cols == df.columns
            assert Counter(tuple(r) for r in df.collect()) == Counter(rel.fetchall())


MIT = next(t.words for t in licenses.NOTICES if t.label == "mit")


def plain_licenses(doc_id, text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower) if x]
    base, label, score = [], set(), 0.0
    for k, t in enumerate(licenses.BASE + licenses.NOTICES):
        for off in range(-len(t.split) + 1, len(w)):
            same = sum(0 <= off + i < len(w) and w[off + i] == x for i, x in enumerate(t.split))
            window = " " + " ".join(w[max(0, off) : max(0, off + len(t.split))]) + " "
            if same >= t.least and all(f" {key} " in window for key in t.keys):
                label.add(t.label)
                score = max(score, round(same / len(t.split), 6))
                if k < len(licenses.BASE):
                    base.append((max(0, off), t.label))
    return (doc_id, len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({b for _, b in base})), ",".join(sorted(label)), score)


def test_licenses_equal_brute_force(spark, tmp_path):
    mit = MIT.split()
    holes = [x if i % 6 else "zz" for i, x in enumerate(mit)]
    rows = [
        (1, "All Rights Reserved. all rights reserved all rights"), (2, "CC-BY cc\tby\ncc by-nc 4.0"), (3, MIT), (4, "see: " + MIT.upper() + " end"), (4, " ".join(mit[:-2])), (4, " ".join(mit[3:])), (5, " ".join(holes)), (6, MIT.replace("without restriction", "with restriction")),
        (7, "Licensed under the Apache License, Version 2.0."), (8, "licensed under that apache license version 2 0"), (9, "This work is licensed under the GNU General Public License, version 3."), (None, "general public license"), (None, None), (None, "général public license é"),
        (10, ""), (11, "\x00 \x7f ---"), (12, "x " * 30000 + "cc by"), (13, "Released under the MIT License. Released under the MIT License."), (14, "license apache the under licensed"), (15, "licensed under cc by nc 4 0 all rights reserved"), (1, "All Rights Reserved. all rights reserved all rights"),
    ]
    spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, label int, start string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in registry.QUERIES["op13_license_scans"](spark, str(tmp_path)).collect())
    want = Counter(plain_licenses(*r) for r in rows)
    assert got == want and sum("mit" in r[6] for r in want) >= 4
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert licenses.scan(df).columns == [*df.columns, "n_words", "matches"] and licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df.withColumn("Matches", F.lit(1)))


def test_any_template_is_found_by_its_rare_places(spark):
    """Random templates with repeated words, random files: the index loses no match."""
    rng = np.random.default_rng(3)
    pick = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 6, n))
    templates = tuple(licenses.Template(f"t{k}", pick(int(rng.integers(2, 9))), float(rng.choice([0.5, 0.8, 1.0]))) for k in range(8))
    rows = [(i, pick(int(rng.integers(0, 60)))) for i in range(60)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates, ()).collect()
    for r, (_, text) in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        w = text.split()
        want = Counter((max(0, off), t.label) for t in templates for off in range(-len(t.split) + 1, len(w)) if sum(0 <= off + i < len(w) and w[off + i] == x for i, x in enumerate(t.split)) >= t.least)
        assert Counter((m["start"], m["label"]) for m in r.matches) == want
