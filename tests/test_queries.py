"""Every query of the core engine against its SQL."""

import math

import duckdb
import pytest
from lodestone import queries as core

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = core.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = db.execute(core.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    assert names == sorted(cols)
    assert got == want


def test_every_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
