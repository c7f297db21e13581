"""The driver contract: every query runs, and those with SQL give the rows of the SQL."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from mendframe.plans import registry

FOLDER = "/root/testdata/sf0.001"
GOLDENS = (Path(__file__).parent / "test_goldens.py").read_text()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLES:
        assert f'"{name}"' in GOLDENS, "a query without SQL has a golden"
        return
    rel = tables.execute(registry.ORACLES[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    assert Counter(tuple(plain(r[have.index(c)]) for c in cols) for r in rel.fetchall()) == got
