"""Every registered query of the library against its SQL, on the smallest tables."""

import hashlib
from pathlib import Path

import duckdb
import pytest

from corpuswright.plans import FIXTURE_SQL, FIXTURES, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES | FIXTURE_SQL))
def test_same_rows(spark, con, name):
    got = (QUERIES | FIXTURES)[name](spark, SF)
    want = con.sql((ORACLES | FIXTURE_SQL)[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(repr, want.project(quoted).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_file_fingerprints(spark):
    got = {r.file: (r.sha256, r.n_bytes) for r in QUERIES["file_fingerprints"](spark, SF).collect()}
    assert got == {p.name: (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in Path(SF).glob("*.parquet")}
