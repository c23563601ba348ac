"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from glimmer import plans
from glimmer.registry import QUERIES, SQL

plans.load()
SF = "/root/testdata/sf0.001"
#: Queries without SQL, and the tests that compare what they do with loops.
TESTED = {"e10_answer_cascade": "test_answer_cascade.py", "e15_final_evidence": "test_finalisation.py"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert name in SQL or name in TESTED, "a query without SQL needs a test of its own"
    if name in SQL:
        out = duck.sql(SQL[name])
        assert sorted(out.columns) == columns
        names = out.columns
        want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in out.fetchall()), key=str)
        assert got == want
