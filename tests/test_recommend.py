"""Recommendation, cross-sell, alternatives, stock repair, text normalization."""

from pyspark.sql import functions as F

from cartwise.functions.text import normalize_basic
from cartwise.operators import recommend as R
from cartwise.operators import stock as ST


def _bundles(spark, bs):
    return spark.createDataFrame([(sorted(b), "|".join(sorted(b)), len(b), 10 - i) for i, b in enumerate(bs)],
                                 "items array<string>, bundle string, size int, support_count bigint")


def test_cross_sell_scores_and_padding(spark):
    b = _bundles(spark, [("item_1", "item_2"), ("item_2", "item_3"), ("item_3", "item_4")])
    req = spark.createDataFrame([("r1", ["item_1"])], "request_id string, items array<string>")
    out = [(r["product"], r["score"]) for r in R.cross_sell(req, b, 5).orderBy("rank").collect()]
    assert out == [("item_2", 0.5), ("item_3", 0.0), ("item_4", 0.0)]


def test_applicable_bundles_top_n(spark):
    b = _bundles(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")])
    req = spark.createDataFrame([("r", ["a"])], "request_id string, items array<string>")
    got = [r["bundle"] for r in R.applicable_bundles(req, b, 2).orderBy("rank").collect()]
    assert got == ["a|b", "a|c"]


def test_jaccard_alternative(spark):
    miss = spark.createDataFrame([("blue cotton shirt",), ("apple",)], "item string")
    cand = spark.createDataFrame([("blue shirt",), ("red shirt",), ("xyz",)], "item string")
    got = {r["item"]: (r["alternative"], r["score"]) for r in ST.best_alternatives(miss, cand).collect()}
    assert got["blue cotton shirt"][0] == "blue shirt" and abs(got["blue cotton shirt"][1] - 2 / 3) < 1e-12
    assert "apple" not in got


def test_inventory_rules(spark):
    df = spark.createDataFrame([("Product_B", "no"), ("item_2", "0"), ("Widget", "YES"), ("widget ", "1.0"), ("x", "maybe")],
                               "Description string, In_Stock string").withColumn("o", F.monotonically_increasing_id())
    inv = {r["item"]: r["in_stock"] for r in ST.inventory_from_frame(df, "o").collect()}
    assert inv == {"product_b": False, "item_2": False, "widget": True, "x": False}
    bad = spark.createDataFrame([("a", "1")], "name string, qty string")
    assert ST.inventory_from_frame(bad).count() == 0


def test_repair_bundles(spark):
    recs = spark.createDataFrame([("r", 1, "blue shirt|red hat"), ("r", 2, "blue cap|red hat")],
                                 "request_id string, rank int, bundle string")
    inv = spark.createDataFrame([("blue shirt", False)], "item string, in_stock boolean")
    out = {r["rank"]: r for r in ST.repair_bundles(recs, inv, 0.3).collect()}
    assert out[1]["resolved_bundle"] == "blue cap|red hat"
    assert out[1]["substitutions"][0]["missing_item"] == "blue shirt"
    assert out[2]["resolved_bundle"] == "blue cap|red hat" and out[2]["substitutions"] == []


def test_normalize_basic(spark):
    cases = [("  10 Inches   Frame ", "10 in frame"), ("5 centimeters", "5 cm"), (None, ""),
             ("Kilograms of GRAMS", "kg of g"), ("10 in. x", "10 in. x")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    got = [r[0] for r in df.select(normalize_basic("t")).collect()]
    assert got == [b for _, b in cases]
