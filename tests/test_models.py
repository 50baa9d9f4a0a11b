"""Labels, splits, Naive Bayes against hand-computed values, metrics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cartwise.operators import features as X
from cartwise.operators import metrics as MT
from cartwise.operators import models as MD


def _tx(spark, tx):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(tx)], "InvoiceNo string, Items array<string>")


def _bundles(spark, bs):
    return spark.createDataFrame([(sorted(b), "|".join(sorted(b)), len(b), 1) for b in bs],
                                 "items array<string>, bundle string, size int, support_count bigint")


def test_labels(spark):
    b = _tx(spark, [["a", "b", "c"], ["a", "b"], ["c"]])
    lab = {r["InvoiceNo"]: r["label"] for r in X.label_baskets(b, _bundles(spark, [("a", "b"), ("a", "c")])).collect()}
    assert lab == {"0": 1, "1": 1, "2": 0}
    b2 = _tx(spark, [["a", "b"], ["b", "c"], ["a", "c"], ["a", "b", "c"]])
    lab2 = [r["label"] for r in X.label_baskets(b2, _bundles(spark, [("a", "b"), ("b", "c")])).orderBy("InvoiceNo").collect()]
    assert lab2 == [1, 1, 0, 1]


@pytest.mark.parametrize("limit", [X.BROADCAST_BYTES, 0])
def test_labels_of_long_baskets_copy_no_basket_needlessly(spark, limit):
    rng = random.Random(5)
    names = [f"i{n}" for n in range(40)]
    tx = [rng.sample(names, rng.randint(1, 8)) for _ in range(300)] + [[f"long{n}" for n in range(500)] + ["i1", "i2"], [], None]
    sets = [tuple(rng.sample(names, k)) for k in (2, 2, 2, 3, 3, 4) for _ in range(4)] + [("i1", "i2", "long7"), ("absent", "i1")]
    out = X.label_baskets(_tx(spark, tx), _bundles(spark, sets), broadcast_bytes=limit)
    assert {int(r["InvoiceNo"]): r["label"] for r in out.collect()} == {
        i: int(any(set(b) <= set(t or ()) for b in sets)) for i, t in enumerate(tx)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Items reach the test of a basket either where the bundles are (broadcast), or after a semi-join on their rarest items.
    assert plan.count("LeftSemi") == (1 if limit else 2) and ("rightHint=(strategy=broadcast)" in plan) == bool(limit)
    many = [(f"long{n}", "i1") for n in range(0, 500, 50)]
    big = spark.createDataFrame([("b", tx[300])], "InvoiceNo string, Items array<string>")
    assert X.label_baskets(big, _bundles(spark, many), broadcast_bytes=limit).first()["label"] == 1


def test_labels_without_bundles(spark):
    none = spark.createDataFrame([], "items array<string>, bundle string, size int, support_count bigint")
    assert [r["label"] for r in X.label_baskets(_tx(spark, [["a"], ["b"]]), none).collect()] == [0, 0]


def test_kfold_sizes_disjoint_cover(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("InvoiceNo"))
    f = X.kfold(df, 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [20] * 5
    f7 = sorted(r["count"] for r in X.kfold(spark.range(103).select(F.col("id").cast("string").alias("InvoiceNo")), 7)
                .groupBy("fold").count().collect())
    assert max(f7) - min(f7) <= 1 and sum(f7) == 103
    with pytest.raises(ValueError):
        X.kfold(df, 1)


def test_random_split_deterministic(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("InvoiceNo"))
    a = X.random_split(df, 0.2).filter("is_test").count()
    b = X.random_split(df.repartition(9), 0.2).filter("is_test").count()
    assert a == b and 150 < a < 250


def test_multinomial_nb_matches_formula(spark):
    tx = [["a", "b"], ["b", "c"], ["a", "c"], ["a", "b", "c"], ["a"]]
    labels = [1, 1, 0, 1, 0]
    df = spark.createDataFrame([(str(i), t, y) for i, (t, y) in enumerate(zip(tx, labels))],
                               "InvoiceNo string, Items array<string>, label int")
    vocab = X.vocabulary(df)
    model = MD.fit_multinomial_nb(df, vocab)
    # counts per class: class 0 rows {a,c},{a}: a=2,c=1 ; class 1 rows {a,b},{b,c},{a,b,c}: a=2,b=3,c=2
    theta = {0: {"a": 3 / 6, "b": 1 / 6, "c": 2 / 6}, 1: {"a": 3 / 10, "b": 4 / 10, "c": 3 / 10}}
    j0 = math.log(2 / 5) + math.log(theta[0]["a"]) + math.log(theta[0]["b"])
    j1 = math.log(3 / 5) + math.log(theta[1]["a"]) + math.log(theta[1]["b"])
    want = 1 / (1 + math.exp(j0 - j1))
    req = spark.createDataFrame([("r", ["a", "b", "zzz"])], "InvoiceNo string, Items array<string>")
    got = model.predict_proba(req).first()["p1"]
    assert abs(got - want) < 1e-12


def test_single_class_training(spark):
    df = spark.createDataFrame([("0", ["a"], 0), ("1", ["b"], 0)], "InvoiceNo string, Items array<string>, label int")
    model = MD.fit_multinomial_nb(df, X.vocabulary(df))
    assert model.predict_proba(df).agg(F.max("p1")).first()[0] == 0.0


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = MT.binary_metrics(df).first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and abs(m["accuracy"] - 2 / 3) < 1e-9


def test_svm_separable(spark):
    tx = [(["a", "b"], 1), (["a", "b", "c"], 1), (["c"], 0), (["d"], 0)] * 10
    df = spark.createDataFrame([(str(i), t, y) for i, (t, y) in enumerate(tx)], "InvoiceNo string, Items array<string>, label int")
    model = MD.fit_svm(df, C=1.0)
    pred = model.predict_proba(df)
    acc = pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc == 1.0


def test_svm_is_cross_validated_by_fold(spark):
    """Baskets with "a" are labelled: each fold's machine, fitted on the other fold, finds them."""
    rows = [(str(i), (["a"] if i % 2 else ["b"]) + [f"x{i % 7}"], i % 2, (i // 2) % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "InvoiceNo string, Items array<string>, label int, fold int").coalesce(1).cache()
    vocab = X.vocabulary(df)
    got = {r["model"]: r for r in MD.cross_validate(df, vocab, 2, ("nb", "gnb", "svm")).collect()}
    assert got["svm"]["accuracy"] == 1.0 and got["svm"]["n_splits"] == 2
    assert {m: r for m, r in got.items() if m != "svm"} == {r["model"]: r for r in MD.cross_validate(df, vocab, 2).collect()}
    assert {r["prediction"] for r in MD.cv_svm(df.withColumn("label", F.lit(1)), 2).collect()} == {1}


def test_ensemble_is_the_mean_of_the_models_that_answered(spark):
    df = spark.createDataFrame([("r", "nb", 0.2), ("r", "svm", 0.6), ("r", "gnb", 1.0), ("s", "nb", 0.3)],
                               "request_id string, model string, confidence double")
    got = {r["request_id"]: r for r in MT.side_by_side(df, models=["nb", "gnb", "svm"], ensemble=("nb", "svm")).collect()}
    assert got["r"]["ensemble"] == 0.4 and got["s"]["ensemble"] == 0.3 and got["s"]["svm"] is None
