"""Every registered ledger query against its SQL in DuckDB, on a small copy of the tables."""

import os

import duckdb
import pytest

from ledgerloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            c.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return c


def shown(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, DATA)
    got = df.collect()
    want = duck.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert shown(tuple(r[c] for c in columns) for r in got) == shown(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall())


#: Queries whose rows come in an order that their columns show.
ORDERED = {
    "export_window": "initiated_us, transaction_id",
    "entries_by_account": "created_us, id",
    "resumable_transfers": "initiated_us, id",
    "recon_exceptions": "category, reference, coalesce(delta_minor, 0)",
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_rows_come_in_order(spark, duck, name):
    query, sql = QUERIES[name]
    want = duck.sql(f"select * from ({sql}) order by {ORDERED[name]}")
    got = [tuple(r[c] for c in want.columns) for r in query(spark, DATA).collect()]
    assert len(got) > 1 and got == want.fetchall()


def test_every_query_has_sql():
    assert len(QUERIES) >= 70 and all(sql for _, sql in QUERIES.values())
