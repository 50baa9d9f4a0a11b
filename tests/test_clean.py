"""Cleaning chain and line features on small literal fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from cartwise.operators import clean as C
from cartwise.schema import RAW_LINES


def _raw(spark, rows):
    df = spark.createDataFrame(rows, RAW_LINES)
    return df.withColumn("row_order", F.monotonically_increasing_id())


def _realistic(spark):
    rows = []
    for i in range(100):
        inv = f"C{536000 + i}" if i < 5 else f"{536000 + i}"
        cust = None if 5 <= i < 10 else float(17000 + i % 7)
        qty = -1 if i == 10 else 1 + i % 4
        price = -5.0 if i == 11 else 1.5 + i % 3
        rows.append((inv, f"8512{i % 5}", f"  Item {i % 5} ", qty, "12/1/2010 8:26", price, cust, "UK"))
    return _raw(spark, rows)


def test_cancellations_split(spark):
    df = _realistic(spark)
    assert C.reject_cancellations(df).count() == 5
    kept = C.handle_cancellations(df)
    assert kept.count() == 95
    assert kept.filter("IsCancellation").count() == 0


def test_missing_customers_and_amounts(spark):
    df = C.handle_cancellations(_realistic(spark))
    assert C.reject_missing_customers(df).count() == 5
    df = C.remove_missing_customers(df)
    assert df.count() == 90
    df = C.keep_positive_amounts(C.drop_missing_descriptions(df))
    assert df.count() == 88


def test_null_description_dropped(spark):
    rows = [("1", "A", "x", 1, "1/1/2023 0:00", 1.0, 1.0, "UK"),
            ("2", "B", None, 1, "1/1/2023 0:00", 1.0, 1.0, "UK"),
            ("3", "C", "z", 1, "1/1/2023 0:00", 1.0, 1.0, "UK")]
    assert C.drop_missing_descriptions(_raw(spark, rows)).count() == 2


def test_duplicates_report_all_members_and_keep_first(spark):
    rows = [("1", "A", "first", 1, "1/1/2023 0:00", 1.0, 1.0, "UK"),
            ("1", "A", "second", 2, "1/1/2023 0:00", 1.0, 1.0, "UK"),
            ("1", "B", "other", 1, "1/1/2023 0:00", 1.0, 1.0, "UK")]
    df = _raw(spark, rows)
    assert C.duplicate_lines(df).count() == 2
    kept = C.dedup_first(df).orderBy("StockCode").collect()
    assert [r["Description"] for r in kept] == ["first", "other"]


def test_dedup_invariant_under_repartition(spark):
    df = _realistic(spark)
    a = sorted(map(tuple, C.clean_lines(df.repartition(1)).drop("row_order").collect()))
    b = sorted(map(tuple, C.clean_lines(df.repartition(17)).drop("row_order").collect()))
    assert a == b


def test_features(spark):
    rows = [("1", "A", " Mug ", 2, "12/1/2010 8:26", 1.5, 1.0, "UK")]
    out = C.engineer_features(C.normalize_descriptions(_raw(spark, rows))).first()
    assert out["Description"] == "mug"
    assert out["InvoiceDate"] == dt.datetime(2010, 12, 1, 8, 26)
    assert out["InvoiceSeason"] == 1          # December -> winter
    assert out["InvoiceDayOfWeek"] == 3       # Wednesday, Monday = 1
    assert out["TransactionValue"] == 3.0


def test_rejects_reasons(spark):
    counts = {r["reason"]: r["count"] for r in C.rejects(_realistic(spark)).groupBy("reason").count().collect()}
    assert counts == {"Cancellations": 5, "no_CustomerID": 5}   # invoices are unique: no duplicates
