"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sitegraph.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(text(r[i]) for i in order) for r in rows), sorted(columns)


def test_every_query_states_its_result():
    assert set(all_oracles()) == set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(name, spark, duck):
    df = all_queries()[name](spark, SF)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(all_oracles()[name])
    want = rows_of(cursor.fetchall(), [c[0] for c in cursor.description])
    assert got == want
