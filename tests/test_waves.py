"""Scorer waves and dealt tasks (E06), the bucketed cache (S07), the ensemble with the SVM."""

import os

import pandas as pd
from pyspark.sql import functions as F

from cartwise.operators import enrich as EN
from cartwise.sources import files as FS


def test_all_dealt_tasks_call_the_scorer(spark):
    keys = spark.range(200_000).selectExpr("concat('item ', id) AS key", "concat('item ', id) AS text").coalesce(1)

    def scorer(pdf):
        from pyspark import TaskContext
        return pd.DataFrame({"key": pdf["key"], "raw": str(TaskContext.get().partitionId())})

    replies = EN.score_in_waves(keys, scorer, batch_rows=1000, tasks=24)
    per_task = {r["raw"]: r["count"] for r in replies.groupBy("raw").count().collect()}
    assert len(per_task) == 24 and max(per_task.values()) < 3 * 200_000 / 24
    assert replies.filter("status = 'ok'").select("key").distinct().count() == 200_000


def test_quota_ends_the_calls_of_the_whole_job(spark, tmp_path):
    keys = spark.range(5000).selectExpr("cast(id as string) AS key", "cast(id as string) AS text")
    calls = str(tmp_path)

    def scorer(pdf):
        with open(f"{calls}/{pdf['key'].iloc[0]}", "w"):
            pass
        spent = len(os.listdir(calls)) > 60
        return pd.DataFrame({"key": pdf["key"], "raw": "{}", "status": "quota" if spent else "ok"})

    replies = EN.score_in_waves(keys, scorer, batch_rows=10, tasks=8, wave_keys=500)
    count = {r["status"]: r["count"] for r in replies.groupBy("status").count().collect()}
    made = len(os.listdir(calls))
    wave = 500 / 10 + 8 + 30                # calls of a wave: full batches, one short one per task, uneven hashing
    assert sum(count.values()) == 5000 and replies.select("key").distinct().count() == 5000
    assert 60 < made <= 60 + wave and count["quota"] >= 5000 - 10 * made and count["ok"] > 300
    assert EN.score_in_waves(keys.limit(0), scorer).count() == 0 and len(os.listdir(calls)) == made


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_only_the_buckets_that_got_keys(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "key string, value string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert FS.load_bucket_cache(spark, path, schema) is None
    first = [(f"k{i}", "old") for i in range(2000)]
    assert len(FS.merge_bucket_cache(frame([*first, (None, "x")]), path)) == 64
    before, old_reader = files_of(path), FS.load_bucket_cache(spark, path, schema)
    assert FS.merge_bucket_cache(frame([("k7", "new")]), path) == FS.merge_bucket_cache(frame([("k7", "newer")]), path)
    after = files_of(path)
    assert before <= after and len(after - before) == 2         # one bucket, rewritten twice; 63 keep their files
    assert dict(map(tuple, old_reader.collect())) == dict(first)    # a reader of the old manifest is unaffected
    assert dict(map(tuple, FS.load_bucket_cache(spark, path, schema).collect())) == dict(first) | {"k7": "newer"}
    assert FS.merge_bucket_cache(frame([]), path) == []
    assert FS.load_bucket_cache(spark, path, schema).count() == 2000


def test_the_ensemble_is_the_mean_of_naive_bayes_and_svm(spark):
    from cartwise.plans import q_models as QM
    from cartwise.plans import q_recommend as QR
    sf = "/root/testdata/sf0.001"
    models, data = QR.svm_engine(spark, sf)
    assert set(models) == {"nb", "svm"}
    mean = {r["request_id"]: r["confidence"] for r in QR.r01s(spark, sf).collect()}
    each = QM.compared_scores(spark, sf, ("nb", "svm")).collect()
    assert len(mean) == len(each) > 0 and all(abs(mean[r["request_id"]] - (r["nb"] + r["svm"]) / 2) < 2e-6 for r in each)
    batch = QR.r06s(spark, sf).cache()
    assert {r["recommender"] for r in batch.select("recommender").distinct().collect()} <= {"nb", "svm"}
    assert batch.agg(F.min("confidence")).first()[0] >= 0.299 and batch.agg(F.max("rank")).first()[0] <= 5
    both = {r["request_id"]: r for r in QR.r07s(spark, sf).collect()}
    assert all(r["total_models"] == 2 for r in both.values())
    twice = batch.groupBy("request_id").agg(F.collect_set(F.struct("recommender", "confidence")).alias("c")).filter(F.size("c") == 2).collect()
    assert all(abs(both[r["request_id"]]["ensemble_confidence"] - sum(x["confidence"] for x in r["c"]) / 2) < 0.0011 for r in twice)
