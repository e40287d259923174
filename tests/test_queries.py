"""Every registered stream query against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF
from rivulet.queries import QUERIES, SQL

TABLES = "events orders lineitem customer".split()




@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    text = lambda rows: sorted(tuple("" if x is None else str(x).removesuffix(".0") for x in r) for r in rows)
    assert text(got) == text(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
