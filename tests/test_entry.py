"""Every registered query on the smallest tables, against SQL where there is some."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from promptloom.jobs.oracles import ORACLES
from promptloom.jobs.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name in ORACLES:
        want = con.execute(ORACLES[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == cols
        a = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)
        assert a == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
