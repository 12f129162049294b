"""Language ID, sharding, the quality classifier and fingerprint components against plain versions of their methods."""

import heapq
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from trackloom.llm import bpe, decontaminate, langid, quality, registry, sharding, simhash
from trackloom.llm.common import fold
from trackloom.llm.ngrams import codes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def plain_vector(text, idf):
    """TF-IDF of a text's n-grams as a dictionary of unit length."""
    n = Counter({int(k): int(c) for k, c in enumerate(langid.term_counts(text)) if c})
    v = {k: math.log1p(c) * float(idf[k]) for k, c in n.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()}


def test_language_is_the_nearest_centroid(spark, docs):
    model = langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: r for r in registry.QUERIES["op4_language_id"](spark, SF).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    for r in rows:
        mine = got[r.doc_id]
        if not r.text or not regex.search(r"\p{L}", r.text):
            assert mine.lang_pred == "und"
            continue
        v = plain_vector(r.text, model.idf)
        cosine = [sum(x * float(c[k]) for k, x in v.items()) for c in model.centroids]
        best = max(range(len(cosine)), key=lambda k: cosine[k])
        near = [model.langs[model.owner[k]] for k in range(len(cosine)) if cosine[k] > cosine[best] - 1e-5]
        assert mine.lang_pred in near and abs(mine.score - cosine[best]) < 1e-5
        least = model.limits[model.owner[best]] * math.sqrt(min(1, len(v) / langid.FULL))
        assert mine.rejected == (cosine[best] < least) or abs(cosine[best] - least) < 1e-5
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows if r.lang and r.text]) > 0.95


def test_centroids_are_spherical_means():
    rng = np.random.default_rng(0)
    x = langid._unit(np.abs(np.concatenate([rng.normal(m, 0.2, (20, 12)) for m in (rng.random((3, 12)))])).astype(np.float64))
    want = [x[int((x @ x.mean(0)).argmax())]]
    while len(want) < 3:
        want.append(min(x, key=lambda v: max(float(v @ c) for c in want)))
    for _ in range(langid.ROUNDS):
        near = [max(range(3), key=lambda k: float(v @ want[k])) for v in x]
        sums = [sum((v for v, n in zip(x, near, strict=True) if n == k), np.zeros(12)) for k in range(3)]
        want = [s / np.linalg.norm(s) if np.linalg.norm(s) else want[k] for k, s in enumerate(sums)]
    assert np.allclose(langid.cluster(x, 3), want)


def test_shards_are_those_of_plain_scheduling(spark, docs):
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("g")).collect()
    size = lambda t: len((t or "").encode()) + 16
    groups = defaultdict(int)
    for r in rows:
        groups[r.g] += size(r.text)
    total, units = sum(groups.values()), registry.SHARDS * sharding.GRAIN
    assert all(b * units >= total for b in groups.values())  # so small a table has no bundles
    load, shard = [0] * registry.SHARDS, {}
    for g, b in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        s = load.index(min(load))
        shard[g], load[s] = s, load[s] + b
    got = registry.QUERIES["op5_lpt_sharding"](spark, SF).collect()
    text = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) and all(r.shard == shard[text[r.doc_id].g] and r["size"] == size(text[r.doc_id].text) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_schedule_is_longest_first():
    rng = np.random.default_rng(1)
    units = [(k, int(s)) for k, s in enumerate(rng.integers(1, 30, 200))]
    heap, want = [(0, s) for s in range(7)], {}
    for k, s in sorted(units, key=lambda u: (-u[1], u[0])):
        n, at = heapq.heappop(heap)
        want[k] = at
        heapq.heappush(heap, (n + s, at))
    assert sharding.schedule(units, 7) == want


def plain_descent(rows, y):
    """Dual coordinate descent with dictionaries."""
    share = {c: float(np.mean(y == c)) for c in (0, 1)}
    w, bias, alpha, rng = defaultdict(float), 0.0, [0.0] * len(rows), np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            s = 1.0 if y[i] == 1 else -1.0
            gradient = s * (sum(w[k] * v for k, v in rows[i].items()) + bias) - 1
            new = min(max(alpha[i] - gradient / (sum(v * v for v in rows[i].values()) + 1), 0.0), quality.COST * 0.5 / share[int(y[i])])
            for k, v in rows[i].items():
                w[k] += (new - alpha[i]) * s * v
            bias += (new - alpha[i]) * s
            alpha[i] = new
    return w, bias


def test_quality_is_plain_coordinate_descent():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "fine", "clear", "a", "the", "of"] if k % 3 else ["buy", "click", "now", "a", "the", "of"], 12)).encode() for k in range(60)]
    y = np.array([1 if k % 3 else 0 for k in range(60)])
    rows = [quality.features(t) for t in texts]
    assert all(set(np.concatenate([codes(t, n, quality.BITS) for n in quality.SIZES]).tolist()) <= set(r.tolist()) for t, r in zip(texts, rows, strict=True))
    ratio = quality.ratios(rows, y)
    for k in (int(rows[0][0]), int(rows[1][-1])):
        n = [1 + sum(k in r for r, label in zip(rows, y, strict=True) if label == c) for c in (0, 1)]
        total = [(1 << quality.BITS) + sum(len(r) for r, label in zip(rows, y, strict=True) if label == c) for c in (0, 1)]
        assert abs(ratio[k] - math.log(n[1] / total[1] / (n[0] / total[0]))) < 1e-9
    own = [i for i in range(60) if i % 4 != 3]
    scaled = [{int(k): float(ratio[k]) / float(np.linalg.norm(ratio[r])) for k in r} for r in rows]
    w, bias = plain_descent([scaled[i] for i in own], y[own])
    model = quality.train(rows, y)
    assert abs(model.bias - bias) < 1e-6 and max(abs(model.weights[k] - v) for k, v in w.items()) < 1e-6
    for t, v in zip(texts, scaled, strict=True):
        margin = sum(w[k] * x for k, x in v.items()) + bias
        assert abs(model.score(t) - 1 / (1 + math.exp(-(model.slope * margin + model.offset)))) < 1e-6


def test_components_of_fingerprints_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for f in range(6):
        base = [f"f{f}w{x}" for x in rng.integers(0, 5000, 250)]
        for k in range(12):
            t = list(base)
            for at in rng.integers(0, 250, k % 3):
                t[at] = f"new{rng.integers(0, 10**6)}"
            rows.append((int(rng.integers(0, 10**6)) * 100 + len(rows), " ".join(t)))
    rows += [(5, None), (6, ""), (7, " \t"), (8, "one two"), (9, "ONE two")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3).collect()}

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))

    fp, root = {i: fingerprint(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", find(i)) for i in fp}
    assert 6 < len({find(i) for i in fp}) < len(fp)


CLASH = "doc_id long, text string, lang string, score double, lang_pred string, rejected int, ids string, decoded int, held_out int, d int, id int, h long"


def test_clashing_columns_of_the_others(spark):
    df = spark.createDataFrame([(i, t, "en", 0.5, "x", 1, "y", 2, 3, 4, 5, 6) for i, t in ((1, "the cat sat on the mat and was glad of it"), (2, None), (3, ""))], CLASH)
    found = langid.identify(df, langid.fit(df))
    assert found.count() == 3 and set(found.columns) == set(df.columns)
    scored = quality.score(df, quality.fit(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")))
    assert scored.columns == ["doc_id", "score"] and scored.count() == 3
    done = bpe.decode(bpe.encode(df.select("doc_id", "text", "lang"), registry.vocabulary()), registry.vocabulary())
    assert done.count() == 3


def test_decontamination_of_repeated_rows_and_long_texts(spark):
    item = " ".join(f"q{i}" for i in range(40))
    long = " ".join(f"w{i * 7919 % 9973}" for i in range(60_000))
    rows = [(1, f"a {item} b"), (1, f"a {item} b"), (2, f"{long} {item}"), (3, long), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.start_word) for r in decontaminate.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert set(got) == {(1, 7, 1), (2, 7, 60_000)} and got[1, 7, 1] == 2 * got[2, 7, 60_000]
