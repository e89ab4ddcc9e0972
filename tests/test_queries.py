"""Every registered query against its SQL on the smallest data set."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from maskwright.plans.check_queries import CHECKS
from maskwright.plans.queries import QUERIES

FOLDER = entry.SMOKE_FOLDER
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def shown(value):
    return repr(round(value, 6) if isinstance(value, float) else value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text", "n_redactions"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(shown(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(CHECKS[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == Counter(tuple(shown(r[i]) for i in order) for r in rel.fetchall())
