"""Every registered query against its SQL in DuckDB, or for the ones without SQL, that it gives rows."""

import math
import os

import duckdb
import pytest

from orefall.plans import catalog
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def shown(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    got = table(df.collect(), df.columns)
    if name not in catalog.ORACLES:
        assert got[1]
        return
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert got == table(cur.fetchall(), names)
