"""All queries of the reference's operators against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from grainmill.plans import queries

#: The smallest table has too few units for these; they are tested on shards of their own elsewhere.
NAMES = sorted(queries.SQL)


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["batch", "n", "n_chars"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
