"""Rows that share an id or have none, against brute force row by row; searches at extreme scales."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from trackloom.llm import ann, linededup, similar, substring
from trackloom.llm.common import Scratch, single_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
W = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"]
LINES = [" ".join(f"{k}{i}" for i in range(8)) for k in "stuvwxyz"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


CASES = [
    [(1, W[0] + " tail"), (None, W[0] + " other"), (None, W[1])],
    [(1, W[0]), (5, W[0]), (5, W[1]), (8, W[4]), (8, W[4]), (None, W[5]), (None, W[5]), (5, W[2] + " x"), (5, W[2] + " y"), (5, W[3]), (None, W[3]), (None, W[2]), (None, None), (None, ""), (5, None)],
    [(1, "\n".join(LINES[:3])), (None, "\n".join(LINES[2:5])), (None, "\n".join(LINES[4:8])), (None, LINES[0]), (7, LINES[1]), (7, LINES[5] + "\n" + LINES[6]), (7, LINES[7])],
]


def ordered(spark, rows):
    """The rows with the keys that the operators go by; keys of different ids keep their order."""
    df = frame(spark, rows)
    keyed = single_ids(df, "key", "doc_id", "text", Scratch(spark, "t")).collect()
    by = {(r.doc_id, r.text or ""): r.key for r in keyed}
    assert len(set(by.values())) == len(by) and sorted(by.values()) == [by[k] for k in sorted(by, key=lambda k: (k[0] is None, k[0] or 0, by[k]))]
    return df, by


@pytest.mark.parametrize("rows", CASES)
def test_repeated_phrases_go_by_row(spark, rows):
    df, by = ordered(spark, rows)
    first = {}
    texts = [(by[i, t or ""], (t or "").split()) for i, t in rows]
    for key, w in texts:
        for at in range(len(w) - 19):
            k = tuple(w[at : at + 20])
            first[k] = min(first.get(k, (key, at)), (key, at))
    want = Counter()
    for (i, _), (key, w) in zip(rows, texts, strict=True):
        gone = {at + d for at in range(len(w) - 19) if first[tuple(w[at : at + 20])] < (key, at) for d in range(20)}
        kept = [x for at, x in enumerate(w) if at not in gone]
        want[i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring.dedup(df).collect()) == want


@pytest.mark.parametrize("rows", CASES)
def test_lines_go_by_row(spark, rows):
    df, by = ordered(spark, rows)
    seen, kept = [], {}
    for (i, t), key in sorted(by.items(), key=lambda kv: kv[1]):
        out = []
        for n, line in enumerate(t.split("\n")):
            w = set(line.split())
            if not w or not any(9 * len(w & s) >= 4 * (len(w) + len(s)) for s in seen):
                out.append(n)
            if w:
                seen.append(w)
        kept[i, t] = out
    got = Counter((r.doc_id, r.removed_lines) for r in linededup.removals(df).collect())
    assert got == Counter((i, ",".join(str(n) for n in range(len((t or "").split("\n"))) if t is not None and n not in kept[i, t])) for i, t in rows)
    cut = lambda i, t: "\n".join(line for n, line in enumerate(t.split("\n")) if n in kept[i, t])
    assert Counter((r.doc_id, r.text) for r in linededup.dedup(df).collect()) == Counter((i, None if t is None else cut(i, t)) for i, t in rows)


@pytest.mark.parametrize("rows", CASES)
def test_near_copies_go_by_row(spark, rows):
    df, by = ordered(spark, rows)
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t.split() else set()
    sets = {key: shingles(t) for (_, t), key in by.items()}
    root = {k: k for k in sets}
    for a in sets:  # few rows: spread the least key until nothing changes
        for _ in sets:
            for b in sets:
                if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert Counter((r.doc_id, r.text) for r in similar.keep_first(df).collect()) == Counter((i, t) for i, t in rows if root[by[i, t or ""]] == by[i, t or ""])


def test_contaminated_rows_without_an_id_go(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"see {item} end"), (None, W[0]), (4, W[1]), (4, item), (None, None), (6, W[2])]
    got = Counter((r.doc_id, r.text) for r in P.decontamination(spark, frame(spark, rows), str(tmp_path)).collect())
    assert got == Counter([rows[1], rows[2], rows[4], rows[5]])


@pytest.mark.parametrize("scale", [1e-200, 1e19, 1e150, None])
def test_search_is_exact_at_any_scale(spark, scale):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16)) * (scale if scale else 10.0 ** rng.integers(-120, 120, 400)[:, None])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 400, 100):
        score = np.cumsum(x * x[q], axis=1)[:, -1]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [i for _, i, _ in sorted(got[q])] == want and [s for _, _, s in sorted(got[q])] == [score[i] for i in want]
