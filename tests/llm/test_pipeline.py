"""The pipeline stage by stage, and as a whole, against brute force on the smallest tables."""

import hashlib
import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as P
from trackloom.llm import registry, similar
from trackloom.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def brute_lines(docs):
    seen, out = [], {}
    for i in sorted(docs):
        kept = []
        for line in docs[i].split("\n"):
            w = {x for x in re.split("[ \t\x0b\f\r\n]+", line) if x}
            if not w or not any(9 * len(w & s) >= 4 * (len(w) + len(s)) for s in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = "\n".join(kept)
    return out


def brute_groups(docs):
    sets, root = {i: set(shingle_hashes(t.encode(), 5)) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: docs[i] for i in ids if find(i) == i}


def brute_clean(docs, items):
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    return {i: t for i, t in docs.items() if not any(words(x) in words(t) for x in items)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base, df, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, df, SF).write.parquet(f"{base}/{name}")
        df = spark.read.parquet(f"{base}/{name}")
        out.append(df)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, stages):
    language, lines, near, clean, _ = stages
    assert all(s.columns == P.COLUMNS for s in stages[:-1])
    assert texts(language) == texts(spark.read.parquet(f"{SF}/documents.parquet"))  # all are in a known language
    assert texts(lines) == brute_lines(texts(language))
    assert texts(near) == brute_groups(texts(lines))
    assert texts(clean) == brute_clean(texts(near), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])


def test_tokens_and_run(spark, stages):
    import public_tokenizers as T

    enc = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=registry.vocabulary().ranks, special_tokens={})
    want = set()
    for r in stages[3].collect():
        ids = enc.encode_ordinary(r.text)
        want.add((r.doc_id, r.lang, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert {tuple(r) for r in stages[4].collect()} == want
    assert {tuple(r) for r in P.run(spark, SF).collect()} == want


def test_near_dedup_catches_copies_and_keeps_others(spark):
    base = [f"u{i * 31 % 997}" for i in range(400)]
    near = [w if i not in (50, 180, 300) else "new" for i, w in enumerate(base)]
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (13, " ".join(f"v{i}" for i in range(300))), (14, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, df, SF).collect()) == [10, 13, 14]


def test_near_dedup_ignores_how_often_a_shingle_repeats(spark):
    """Equal shingle sets whose fingerprints differ in up to half of their bits."""
    text = lambda k, n: " ".join([f"k{k}w{i}" for i in range(300)] + ["run"] * n)
    rows = [(2 * k + j, text(k, n)) for k in range(12) for j, n in enumerate((5, 1000))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, df, SF).collect()) == list(range(0, 24, 2))


def test_near_dedup_links_large_families(spark):
    """Two families of 60 near copies that share buckets, with one pair of similarity 0.806 between them."""
    core, ends = [f"c{i}" for i in range(200)], [[f"{f}{i}" for i in range(24)] for f in "ab"]
    rows = [(100 * f + k, " ".join(core + ends[f] + [f"x{f}y{k}z{i}" for i in range(10)])) for f in (0, 1) for k in range(60)]
    rows += [(200 + f, " ".join(core + ends[f])) for f in (0, 1)]
    got = similar.groups(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    assert len(got) == 122 and {r.component for r in got} == {0}
