"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from lexforge.plans import queries as Q
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(x):
    return ("nan" if math.isnan(x) else repr(round(x, 9) + 0.0)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in Q.ORACLES:
        assert rows
        return
    want = con.execute(Q.ORACLES[name])
    names = [c[0] for c in want.description]
    want = want.fetchall()
    assert sorted(df.columns) == sorted(names)
    at = [df.columns.index(n) for n in names]
    assert sorted(tuple(plain(r[i]) for i in at) for r in rows) == sorted(tuple(map(plain, r)) for r in want)
    assert rows or name in ("near_dups",)


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(Q.QUERIES) <= set(e.queries())
