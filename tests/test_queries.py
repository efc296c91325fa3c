"""Every query that has an SQL twin gives the same rows as DuckDB."""

import collections
import os

import pytest

import __spark_entry__ as entry
from quarrylight.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def tidy(frame, columns):
    def cell(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return repr([cell(x) for x in v])
        if v is None or str(v) in ("NaT", "<NA>", "nan", "None"):
            return None
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return collections.Counter(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert tidy(got, columns) == tidy(want, columns)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["query", "match_kind", "id", "path", "ord"]
