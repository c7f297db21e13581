"""Every training-data query runs, and those with SQL give the rows of the SQL."""

import os
from collections import Counter

import duckdb
import pytest

from mendframe.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in cols) for r in df.collect())
    if name not in queries.ORACLES:
        return
    rel = tables.execute(queries.ORACLES[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    assert Counter(tuple(r[have.index(c)] for c in cols) for r in rel.fetchall()) == got


COLUMNS = {
    "p1_found": [("record_kind", "string"), ("key_a", "string"), ("key_b", "string")], "p2_found": [("traj_id", "string"), ("attempt", "bigint"), ("defect", "string")], "p3_found": [("traj_id", "string"), ("turn_no", "bigint"), ("message_id", "bigint")],
    "p4_found": [("problem_id", "string"), ("group_family", "string")], "p5_found": [("record_kind", "string"), ("key_a", "string"), ("key_b", "string")], "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_are_as_defined(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).dtypes == COLUMNS[name]
