"""Every query with SQL gives the same rows as DuckDB at the smallest size."""

import duckdb
import pytest

from skyloom.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLE[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    want, got = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got)
    for c in columns:
        assert ((want[c] == got[c]) | (want[c].isna() & got[c].isna())).all(), c


def test_entry_and_registry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
