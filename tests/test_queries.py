"""Every query with SQL agrees with DuckDB on the small tables, doubles to nine digits."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as library
from wattline.plans import catalogue

DATA = "/root/testdata/sf0.001"


def _alike(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def _rows(names, rows):
    """Rows of (sorted) columns, sorted by all but the doubles and then by these to six digits."""
    found = []
    for r in rows:
        r = [r[i] for i in sorted(range(len(names)), key=names.__getitem__)]
        found.append((str([v for v in r if not isinstance(v, float)]), [f"{v:.6e}" for v in r if isinstance(v, float)], r))
    return [r for *_, r in sorted(found, key=lambda x: x[:2])]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    a = library.queries()[name](spark, DATA)
    b = tables.execute(library.oracle_sql()[name])
    names = [c[0] for c in b.description]
    assert sorted(a.columns) == sorted(names)
    a, b = _rows(a.columns, map(tuple, a.collect())), _rows(names, b.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(map(_alike, x, y)), (x, y)


def test_entry(spark):
    assert library.entry(spark).count() >= 0
