"""The corpus queries that SQL can express agree with DuckDB."""

import glob
import os

import pytest

pytest.importorskip("wattline.llm")
import duckdb  # noqa: E402

from wattline.llm import entry  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    a = entry.queries()[name](spark, DATA).toPandas()
    b = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values))
    assert rows(a) == rows(b)
