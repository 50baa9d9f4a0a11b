"""Single requests and batches from the saved engine, against the fitted models."""

import time

import pytest
from pyspark.sql import functions as F

from cartwise.operators import lookup as LK
from cartwise.operators import models as MD
from cartwise.operators import recommend as R
from cartwise.plans import q_recommend as QR
from cartwise.plans.catalog import bundles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    data = QR.split(spark, SF)
    models = MD.fit_all(data.filter(~F.col("is_test")), QR.vocab_of(spark, SF))
    at = str(tmp_path_factory.mktemp("lookup") / "engine")
    LK.save_lookup(models, bundles(spark, SF), at)
    return models, LK.Lookup.open(spark, at)


def test_buckets_agree_with_spark(spark):
    names = ["a", "", "é ß", "a|b", "x" * 500]
    got = spark.createDataFrame([(n,) for n in names], "item string").select("item", LK.item_bucket("item", 64).alias("b")).collect()
    assert {r["item"]: r["b"] for r in got} == {n: LK.bucket_of(n, 64) for n in names}


def test_one_request_equals_the_batch_row(spark, engine):
    models, opened = engine
    some = QR.split(spark, SF).filter("is_test").limit(4).collect()
    asked = {r["InvoiceNo"]: r["Items"] for r in some} | {"none": ["never seen"], "empty": []}
    reqs = spark.createDataFrame(list(asked.items()), "request_id string, items array<string>")
    scores, first = R.model_scores(reqs, models).collect(), R.applicable_bundles(reqs, bundles(spark, SF), 5).collect()
    batch = opened.batch(reqs, threshold=0.0).collect()
    for key, items in asked.items():
        got = opened.one(items, threshold=0.0)
        want = {r["recommender"]: r["confidence"] for r in scores if r["request_id"] == key}
        assert all(abs(got["confidence"][n] - p) < 6e-4 for n, p in want.items()) and set(want) == {"nb", "gnb", "svm"}
        assert abs(got["ensemble_confidence"] - sum(want.values()) / 3) < 6e-4
        assert got["bundles"] == [r["bundle"] for r in sorted((r for r in first if r["request_id"] == key), key=lambda r: r["rank"])]
        rows = [r for r in batch if r["request_id"] == key]
        assert [r["bundle"] for r in sorted(rows, key=lambda r: r["rank"]) if r["recommender"] == "nb"] == got["bundles"]
        assert all(abs(r["confidence"] - got["confidence"][r["recommender"]]) < 1.1e-3 for r in rows)
    assert opened.one(["never seen"], threshold=1.0)["bundles"] == []
    with pytest.raises(ValueError):
        opened.one(["a"], threshold=1.5)
    with pytest.raises(ValueError):
        opened.one(["a"], top_n=6)


def test_a_warm_request_reads_its_buckets_alone(spark, engine):
    _, opened = engine
    items = QR.split(spark, SF).filter("is_test").first()["Items"][:3]
    plan = opened._held(opened.weights, items)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    opened.one(items)
    took = []
    for _ in range(5):
        began = time.time()
        opened.one(items)
        took.append(time.time() - began)
    assert sorted(took)[2] < 2.0, took
    print("warm lookup", sorted(took)[2])


def test_kernel_machines_have_no_lookup(spark):
    with pytest.raises(ValueError):
        LK._terms(MD.KernelSVMModel(None, None, 0.0, 1.0, 0.0, [0, 1]))
