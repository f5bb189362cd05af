"""Every query of the subpackage with an SQL form, against DuckDB at the smallest size."""

import duckdb
import pytest

from kestrel.llm.queries import QUERIES
from tests.conftest import SF001
from tools.check import TABLES, rows_of, type_mismatches


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    query, sql = QUERIES[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = query(spark, SF001)
    got = con.execute(sql)
    cols, want = [c[0] for c in got.description], got.fetchall()
    assert sorted(df.columns) == sorted(cols) and not type_mismatches(df, con, sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, want)


def test_registered_and_guarded():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
