"""Snapshots and their reuse, scorer-chosen alternatives, text files."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cartwise import jobs
from cartwise.operators import enrich as EN
from cartwise.schema import JobParams
from cartwise.sources import files as FS
from cartwise.sources.tables import TABLES, retail_lines

from .conftest import SF


def test_snapshot_is_reused_forced_and_given_new_bundles(spark, tmp_path):
    out, calls = str(tmp_path / "snap"), []

    def load():
        calls.append(1)
        return retail_lines(spark, SF)

    with pytest.raises(FileNotFoundError):
        jobs.regenerate_bundles(spark, out)
    few, many = JobParams(min_support=0.01, max_bundle_size=2), JobParams(min_support=0.003, max_bundle_size=2)
    first = jobs.prepare(spark, out, load, few)
    again = jobs.prepare(spark, out, load, few)
    assert len(calls) == 1 and again["timestamp"] == first["timestamp"]
    new = jobs.regenerate_bundles(spark, out, many)
    assert len(calls) == 1 and new["timestamp"] > first["timestamp"] and new["lines_at"] == first["lines_at"]
    assert new["bundles"].count() > first["bundles"].count()
    same = lambda s: sorted(map(tuple, s["baskets"].select("InvoiceNo", "Items").collect()))
    assert same(new) == same(first)
    forced = jobs.prepare(spark, out, load, few, force=True)
    assert len(calls) == 2 and forced["timestamp"] > new["timestamp"]
    tsv = spark.read.options(**FS.PLAIN).csv(f"{out}/{forced['lines_at']}_tsv")
    assert tsv.count() == forced["lines"].count()


def test_text_files_keep_quotes_and_blanks(spark, tmp_path):
    src = tmp_path / "raw.csv"
    src.write_text('InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n'
                   '1,0a,"  6"" PLATE, RED ",2,12/1/2010 8:26,1.5,17850,UK\n', encoding="latin-1")
    df = FS.load_raw_csv(spark, str(src))
    assert df.first()["Description"] == '  6" PLATE, RED '
    FS.csv_to_tsv(df, str(tmp_path / "out"))
    assert spark.read.options(**FS.PLAIN).csv(str(tmp_path / "out")).first()["Description"] == '  6" PLATE, RED '


def test_alternatives_come_from_the_scorer_then_the_cache_then_the_words(spark):
    schema = "g int, item string"
    missing = spark.createDataFrame([(1, "red mug"), (1, "odd mug"), (1, "full mug"), (2, "red mug"), (3, "lone"), (1, None), (1, "")], schema)
    held = spark.createDataFrame([(1, "blue mug"), (1, "tin pot"), (2, "red cup"), (2, "pan"), (1, None)], schema)

    def scorer(pdf):
        rows = []
        for key, text in zip(pdf["key"], pdf["text"]):
            asked = json.loads(text)
            item, names = asked["missing_item"], asked["candidates"]
            reply = [{"item": names[0], "score": 0.5}, {"item": names[1], "score": 0.9, "reason": "r"}, {"item": "x", "score": 1.0}]
            bad = json.dumps([{"item": "x", "score": 7}])
            rows.append((key, bad if item == "odd mug" else json.dumps(reply), "error" if item == "full mug" else "ok"))
        return pd.DataFrame(rows, columns=["key", "raw", "status"])

    out, cache = EN.select_alternatives(missing, held, scorer, "g", max_alternatives=2)
    want = {(1, "red mug"): ("tin pot", 0.9, "r"), (1, "odd mug"): ("blue mug", 1 / 3, "token-overlap"),
            (1, "full mug"): ("blue mug", 1 / 3, "token-overlap"), (2, "red mug"): ("red cup", 0.9, "r")}
    assert {(r["g"], r["item"]): (r["alternative"], r["score"], r["reason"]) for r in out.collect()} == want
    kept = cache.collect()
    assert len(kept) == 2
    known = spark.createDataFrame(kept, cache.schema)
    out, _ = EN.select_alternatives(missing, held, None, "g", max_alternatives=2, cache=known)
    assert {(r["g"], r["item"]): (r["alternative"], r["score"], r["reason"]) for r in out.collect()} == want
    out, _ = EN.select_alternatives(missing, held, scorer, "g", max_candidates=200, max_alternatives=1)
    assert {r["alternative"] for r in out.filter("item = 'red mug'").collect()} == {"blue mug", "pan"}


def test_streaming_clean_equals_batch(spark, tmp_path):
    from cartwise.operators.clean import (clean_lines, normalize_descriptions)
    from cartwise.streaming.baskets import clean_stream
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cols = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
    lines = retail_lines(spark, SF).withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp"))
    lines.select(*cols).repartition(3).write.parquet(src)
    stream = clean_stream(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), watermark="20000 days")
    done = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).option("path", out) \
        .trigger(availableNow=True).start()
    done.awaitTermination()
    batch = normalize_descriptions(clean_lines(retail_lines(spark, SF)))
    keys = lambda d: sorted(map(tuple, d.select("InvoiceNo", "StockCode", "Description").collect()))
    assert keys(spark.read.parquet(out)) == keys(batch)


@pytest.mark.parametrize("name", ["S01", "S02", "S07", "S08", "P02T", "F02T", "F08T", "E04"])
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
