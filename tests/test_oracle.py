"""Every query of the reference's operators that SQL can express, against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest

from graphloom.plans import registry

ORACLE = registry.oracle_sql()


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, want.fetchall())


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).columns


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(registry.queries())
