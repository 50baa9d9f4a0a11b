"""Cases that used to lose, repeat or hide rows."""

import duckdb
import pytest

import __spark_entry__ as E
from cartwise.operators.features import kfold
from cartwise.sources import files as FS
from cartwise.sources.tables import TABLES

from .conftest import SF


def test_kfold_keeps_null_and_repeated_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("b", 4)], "InvoiceNo string, v int")
    rows = kfold(df, 2).collect()
    assert sorted(r["v"] for r in rows) == [1, 2, 3, 4]
    assert len({r["fold"] for r in rows if r["InvoiceNo"] == "b"}) == 1 and {r["fold"] for r in rows} == {0, 1}


def test_cache_reads_the_current_version_only(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "key string, value string"
    assert FS.load_kv_cache(spark, path, schema) is None
    FS.save_kv_cache(spark.createDataFrame([("k1", "old"), ("k2", "x")], schema), path)
    FS.save_kv_cache(spark.createDataFrame([("k1", "new")], schema), path)
    got = FS.load_kv_cache(spark, path, schema)
    assert got.columns == ["key", "value"] and [tuple(r) for r in got.collect()] == [("k1", "new")]


def test_aliases_that_differ_in_case(spark, tmp_path):
    f = tmp_path / "alias.json"
    f.write_text('{"Mug": "Cup", "mug": "beaker", "Pan": "pot"}')
    assert sorted(tuple(r) for r in FS.load_alias_map(spark, str(f)).collect()) == [("mug", "beaker"), ("pan", "pot")]
    f.write_text("{broken")
    assert FS.load_alias_map(spark, str(f)).count() == 0        # no map in it: no aliases, as where the file is missing
    assert FS.load_alias_map(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("name", ["P07", "L04"])
def test_oracles(spark, name):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from oracle_check import digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = E.queries()[name](spark, SF), con.sql(E.oracle_sql()[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0]


def _named(spark, bundles):
    return spark.createDataFrame([(list(b), "|".join(b), len(b), 9) for b in bundles],
                                 "items array<string>, bundle string, size int, support_count bigint")


def test_bundles_with_the_same_printed_name_stay_apart(spark):
    from cartwise.operators.features import label_baskets
    from cartwise.operators.recommend import applicable_bundles
    bundles = _named(spark, [("a|b", "c"), ("a", "b|c")])
    baskets = spark.createDataFrame([("1", ["a|b", "b|c"]), ("2", ["c", "a|b", None]), ("3", ["b|c", "a", "a"]), ("4", None)],
                                    "InvoiceNo string, Items array<string>")
    got = {r["InvoiceNo"]: r["label"] for r in label_baskets(baskets, bundles).collect()}
    assert got == {"1": 0, "2": 1, "3": 1, "4": 0}
    req = spark.createDataFrame([("r", ["a|b", "a"])], "request_id string, items array<string>")
    assert sorted(r["bundle_items"] for r in applicable_bundles(req, bundles, 5).collect()) == [["a", "b|c"], ["a|b", "c"]]


def test_an_item_with_a_pipe_is_repaired(spark):
    from cartwise.operators.stock import repair_bundles
    recs = spark.createDataFrame([("r", 1, "mug a|b|x", ["mug a|b", "x"]), ("r", 2, "mug a|y", ["mug a", "y"])],
                                 "request_id string, rank int, bundle string, bundle_items array<string>")
    inv = spark.createDataFrame([("mug a|b", False)], "item string, in_stock boolean")
    out = {r["rank"]: r["resolved_bundle"] for r in repair_bundles(recs, inv, 0.3).collect()}
    assert out == {1: "mug a|x", 2: "mug a|y"}


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    from cartwise.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(1)
    data = [(float(a), int(b) if b else None, None) for a, b in zip(rng.normal(size=997), rng.integers(0, 5, 997))]
    df = spark.createDataFrame(data + [(float("nan"), 3, None)], "a double, b int, c double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    assert np.allclose(got["a"], np.quantile([r[0] for r in data], probs), rtol=1e-12)
    assert np.allclose(got["b"], np.quantile([r[1] for r in data if r[1]] + [3], probs))
    assert got["c"] == [None] * 6
    assert exact_quantiles(df.limit(0), ["a"], (0.5,)) == {"a": [None]}


def test_scorer_quota_errors_and_single_use(spark, tmp_path):
    import pandas as pd

    from cartwise.operators import enrich as EN
    keys = spark.range(100).selectExpr("cast(id as string) AS key", "cast(id as string) AS text").coalesce(1)
    calls = tmp_path / "calls"

    def third_call_spends_the_quota(pdf):
        with open(calls, "a") as f:
            f.write("x")
        spent = len(calls.read_text()) == 3
        return pd.DataFrame({"key": pdf["key"], "raw": '{"category": "c"}', "status": "quota" if spent else "ok"})

    replies = EN.keep_replies(EN.run_scorer(keys, third_call_spends_the_quota))
    count = {r["status"]: r["count"] for r in replies.groupBy("status").count().collect()}
    assert count == {"ok": 20, "quota": 80} and calls.read_text() == "xxx"
    valid, quarantine = EN.ingest(replies, EN.CATEGORY_SCHEMA)
    assert (valid.count(), quarantine.count(), calls.read_text()) == (20, 80, "xxx")

    def picky(pdf):
        if (pdf["key"] == "7").any():
            raise RuntimeError("no")
        return pd.DataFrame({"key": pdf["key"][1:], "raw": "{}"})

    count = {r["status"]: r["count"] for r in EN.run_scorer(keys, picky).groupBy("status").count().collect()}
    assert count == {"error": 10 + 9, "ok": 81}


def test_naive_bayes_without_a_second_class_or_varying_items(spark):
    from cartwise.operators import models as MD
    from cartwise.operators.features import vocabulary
    schema = "InvoiceNo string, Items array<string>, label int, fold int"
    same = spark.createDataFrame([(str(i), ["a"], int(i > 1), i % 2) for i in range(6)], schema)
    vocab = vocabulary(same)
    out = MD.fit_gaussian_nb(same, vocab).predict_proba(same).collect()
    assert {round(r["p1"], 9) for r in out} == {round(4 / 6, 9)} and {r["prediction"] for r in out} == {1}
    assert all(r["p1"] is not None for r in MD.cv_gaussian_nb(same, vocab, 2).collect())
    ones = same.withColumn("label", same["label"] * 0 + 1)
    for cv in (MD.cv_multinomial_nb, MD.cv_gaussian_nb):
        assert {(r["p1"], r["prediction"]) for r in cv(ones, vocab, 2).collect()} == {(1.0, 1)}


def test_svm_classes_follow_the_margin(spark):
    from cartwise.operators import models as MD
    rows = [(str(i), ["x", f"n{i % 3}"] if i % 2 else ["y", f"n{i % 3}"], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "InvoiceNo string, Items array<string>, label int")
    out = MD.fit_svm(df).predict_proba(df).collect()
    assert all(r["prediction"] == r["label"] and (r["p1"] > 0.5) == bool(r["label"]) for r in out)
