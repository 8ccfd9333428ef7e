"""Every query that has SQL gives DuckDB's rows on the smallest driver tables."""

import os

import duckdb
import pytest

from sparkmine.catalog import ORACLE, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in [*TABLES, "labels"]:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def shaped(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = shaped(found.fetchall(), columns)
    assert want and shaped([tuple(r) for r in df.collect()], df.columns) == want
