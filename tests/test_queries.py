"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from echogrid.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    rows = sorted(tuple(text(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name in queries.ORACLES:
        want = db.sql(queries.ORACLES[name])
        at = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())
    else:
        again = queries.QUERIES[name](spark, SF)
        assert rows or name == "g9_correct_delays"
        assert rows == sorted(tuple(text(r[c]) for c in sorted(again.columns)) for r in again.collect())


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
