"""File round trips, enrichment cache behaviour, streaming cleaning."""

import os
import tempfile

from pyspark.sql import functions as F

from cartwise.operators import enrich as EN
from cartwise.sources import files as FS


def test_csv_latin1_and_tsv(spark):
    d = tempfile.mkdtemp(prefix="cartwise-test-")
    p = os.path.join(d, "data.csv")
    with open(p, "wb") as f:
        f.write("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n".encode())
        f.write('000123,0042A,"CAFÉ MUG, LARGE",2,12/1/2010 8:26,1.5,17850,Fran\xe7e\n'.encode("latin-1"))
    df = FS.load_raw_csv(spark, p)
    r = df.first()
    assert r["InvoiceNo"] == "000123" and r["Description"] == "CAFÉ MUG, LARGE" and r["Country"] == "Françe"
    FS.csv_to_tsv(df, FS.default_tsv_path(p))
    back = spark.read.option("sep", "\t").option("header", True).csv(os.path.join(d, "data.tsv"))
    assert back.first()["Description"] == "CAFÉ MUG, LARGE"


def test_enrichment_cache_cold_warm_equal(spark):
    df = spark.createDataFrame([("red mug",), ("blue bolt",), ("green cup",)], "Description string")
    cold, cache = EN.enrich_categories(df, EN.rule_category_scorer)
    calls = []

    def counting(pdf):
        calls.append(len(pdf))
        return EN.rule_category_scorer(pdf)
    warm, _ = EN.enrich_categories(df, counting, cache=cache.cache())
    a = sorted(map(tuple, cold.collect()), key=str)
    b = sorted(map(tuple, warm.collect()), key=str)
    assert a == b
    got = {r["Description"]: r["category"] for r in cold.collect()}
    assert got == {"red mug": "mug", "blue bolt": None, "green cup": "cup"}


def test_no_scorer_all_null(spark):
    df = spark.createDataFrame([("red mug",)], "Description string")
    out, _ = EN.enrich_categories(df, None)
    assert out.first()["category"] is None


def test_ingest_fenced_bare_and_invalid(spark):
    raw = spark.createDataFrame([("a", '```json\n{"contexts": [{"context": "gift", "confidence": 0.9}]}\n```', "ok"),
                                 ("b", '[{"context": "home", "confidence": 0.7}]', "ok"),
                                 ("c", "not json", "ok"), ("d", '{"contexts": []}', "quota")], EN.RAW_SCHEMA)
    valid, bad = EN.ingest(raw, EN.CONTEXT_SCHEMA)
    assert sorted(r["key"] for r in valid.collect()) == ["a", "b"]
    assert sorted(r["key"] for r in bad.collect()) == ["c", "d"]


def test_nb_model_round_trip(spark):
    from cartwise.operators import features as X
    from cartwise.operators import models as MD
    df = spark.createDataFrame([("0", ["a", "b"], 1), ("1", ["c"], 0)], "InvoiceNo string, Items array<string>, label int")
    m = MD.fit_multinomial_nb(df, X.vocabulary(df))
    d = tempfile.mkdtemp(prefix="cartwise-model-")
    FS.save_nb_model(m, d)
    m2 = FS.load_nb_model(spark, d)
    a = [r["p1"] for r in m.predict_proba(df).orderBy("InvoiceNo").collect()]
    b = [r["p1"] for r in m2.predict_proba(df).orderBy("InvoiceNo").collect()]
    assert a == b
