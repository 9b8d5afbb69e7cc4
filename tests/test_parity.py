"""Every ledger query against its SQL in another engine."""

from decimal import Decimal

import duckdb
import pytest

from ledgerglass.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def other(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return ""
    if isinstance(v, str):
        return v
    return str(int(v)) if isinstance(v, (bool, int, Decimal)) or float(v).is_integer() else repr(float(v))


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[k]) for k in order) for r in found)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_parity(name, spark, data, other):
    df = catalog.QUERIES[name](spark, data)
    want = other.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())
