"""Every query with an oracle against DuckDB over the smallest tables; the others for a stable schema."""

import math
import os

import duckdb
import pytest

from trackloom import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    want = sorted(tuple(plain(r[cols.index(c)]) for c in names) for r in rel.fetchall())
    assert len(got) == len(want)
    off = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not off, off[:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_oracle(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_every_query_says_what_it_covers():
    assert set(registry.COVERS) == set(registry.QUERIES)
