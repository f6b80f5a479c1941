"""Every query with SQL gives that SQL's rows on the smallest tables; the rest runs."""

from pathlib import Path

import duckdb
import pytest
from lodestone.plans import registry

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def cell(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([repr(cell(r[i])) for i in order] for r in data))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        want = db.execute(SQL[name])
        columns = [x[0] for x in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows(columns, want.fetchall())
    assert got or name in {"embed_missing_anti"}


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES) and registry.FLAGSHIP in QUERIES
