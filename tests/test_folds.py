"""Folds are numbered by ranges of the digest: nothing is sampled, written or joined back; lines are dealt to as many tasks as they need."""

import hashlib
import re

import pytest

from cartwise.functions import ordering
from cartwise.operators.baskets import create_baskets
from cartwise.operators.clean import preprocess
from cartwise.operators.features import kfold
from cartwise.sources import tables as T
from tests.conftest import SF


def _wanted(keys, k, seed):
    order = sorted(set(keys), key=lambda x: (hashlib.md5(f"{seed}|{'' if x is None else x}".encode()).hexdigest(), x is not None, x or ""))
    return {key: at % k for at, key in enumerate(order)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _no_checkpoint(df):
    raise AssertionError("nothing needs to be written")


@pytest.mark.parametrize("digits", [1, 3])
def test_folds_are_numbered_in_digest_order(spark, monkeypatch, digits):
    monkeypatch.setattr(ordering, "cut_lineage", _no_checkpoint)        # before: a checkpoint of keys and digests
    monkeypatch.setattr(ordering, "DIGITS", digits)
    keys = [str(k) for k in range(700)] + [None, "", "é"]
    df = spark.createDataFrame([(k, at) for at, k in enumerate(keys)], "InvoiceNo string, at int").repartition(5)
    here, plain = kfold(df, 7, 3, one_row_a_key=True), kfold(df, 7, 3)
    for out in (here, plain):
        rows = out.collect()
        assert out.columns == ["InvoiceNo", "at", "fold"] and sorted(r["at"] for r in rows) == list(range(len(keys)))
        assert {r["InvoiceNo"]: r["fold"] for r in rows} == _wanted(keys, 7, 3)
    assert "Aggregate [InvoiceNo" not in _plan(here) and _plan(here).count("Join") == 1     # that of the ranges' sizes
    moved = _plan(here)[_plan(here).index("RepartitionByExpression"):]
    assert "_w0" in _plan(here) and "_w0" not in moved          # the digest is made where the row arrives


def test_rows_of_a_key_share_their_fold(spark):
    keys = ["a", "b", "a", None, "c", None, "a"]
    df = spark.createDataFrame([(k, at) for at, k in enumerate(keys)], "InvoiceNo string, at int")
    rows = kfold(df, 3, 42).collect()
    assert sorted(r["at"] for r in rows) == list(range(7)) and {r["InvoiceNo"]: r["fold"] for r in rows} == _wanted(keys, 3, 42)
    assert kfold(df.filter("at < 0"), 3, one_row_a_key=True).collect() == []


def test_lines_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    rows = lambda df: sorted(map(str, df.collect()))
    made = lambda: create_baskets(preprocess(T.retail_lines(spark, SF, placed=True), placed_by=T.PLACED_BY), placed_by=T.PLACED_BY)
    assert "RepartitionByExpression" not in _plan(T.retail_lines(spark, SF, placed=True))       # few lines: as Spark does
    wanted = rows(made())
    monkeypatch.setattr(T, "LINES_A_TASK", 100, raising=False)
    tasks = -(-T.table(spark, SF, "lineitem").count() // 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = made()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(rf"hashpartitioning\([lo]_orderkey#\d+L?, {tasks}\)", plan)) >= 2     # before: the session's number
    above = plan[:plan.index("SortMergeJoin [l_orderkey")]
    assert "hashpartitioning" not in above.split("Subquery")[0]
    assert rows(made()) == wanted
