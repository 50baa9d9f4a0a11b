"""Driver contract and a DuckDB oracle pass at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from cartwise.sources.tables import TABLES

from .conftest import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["bundle", "size", "support_count", "support"]


def test_oracles_are_a_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


FAST = ["F01", "F06", "F07", "P06", "Q11", "Q13", "A07", "A19", "M02", "S11", "L04", "R05", "R04"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_match_small(spark, name):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from oracle_check import digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    s_rows = [tuple(r) for r in df.collect()]
    o_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, s_rows)[0] == digest(rel.columns, o_rows)[0]
