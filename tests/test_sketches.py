"""Approximate modes against exact ones, merged sketches, distinct counts without copies of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.functions import quantiles as QT
from cartwise.functions import sketches as SK
from cartwise.operators import anomaly as AN
from cartwise.operators import profile as P
from cartwise.operators import query as Q


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(2)
    rows = list(zip(rng.normal(size=40_000).tolist(), rng.exponential(size=40_000).round(2).tolist(), rng.integers(0, 30, 40_000).tolist()))
    df = spark.createDataFrame([*rows, (float("nan"), None, 1)], "a double, b double, day int")
    return df.withColumn("none", F.lit(None).cast("double")).repartition(6).cache()


def rank_error(values, found, p):
    values = np.sort(values)
    low, high = np.searchsorted(values, found, "left") / len(values), np.searchsorted(values, found, "right") / len(values)
    return max(0.0, low - p, p - high)


def test_sketched_quantiles_are_within_a_hundredth_of_rank(spark, numbers):
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    whole = QT.quantiles(numbers, ["a", "b", "none"], probs, approximate=True)
    days = SK.quantile_sketches(numbers, ["a", "b", "none"], ["day"]).cache()
    assert days.count() == 30
    merged = SK.sketched_quantiles(days, ["a", "b", "none"], probs)
    assert whole["none"] == merged["none"] == [None] * 7
    for c in ("a", "b"):
        values = np.array([r[0] for r in numbers.select(c).collect() if r[0] is not None and r[0] == r[0]])
        for got in (whole[c], merged[c]):
            assert max(rank_error(values, x, p) for x, p in zip(got, probs)) <= 0.01
            assert got[0] == values.min() and got[-1] == values.max()
    plan = SK.quantile_sketches(numbers, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("InMemoryTableScan") <= 2


def test_approximate_modes_of_the_operators(spark, numbers):
    numbers = numbers.filter("not isnan(a)")
    exact, near = ({r["column"]: r for r in P.numeric_profile(numbers, ["a", "b"], approximate=x).collect()} for x in (False, True))
    for c in ("a", "b"):
        assert exact[c]["mean"] == near[c]["mean"] and all(abs(exact[c][q] - near[c][q]) < 0.05 for q in ("q1", "median", "q3"))
    low, high = (AN.iqr_bounds(numbers, ["a", "none"], approximate=x).collect() for x in (False, True))
    assert abs(low[0]["lower"] - high[0]["lower"]) < 0.1 and high[1]["upper"] == float("inf")
    flags = [AN.flag_anomalies(numbers, fields=["b"], multiplier=1.5, approximate=x).filter("check_anomaly").count() for x in (False, True)]
    assert abs(flags[0] - flags[1]) < 0.01 * 40_000
    out = [P.numeric_outliers(numbers, ["b"], approximate=x).first()["outlier_count"] for x in (False, True)]
    assert abs(out[0] - out[1]) < 0.01 * 40_000


def lines(spark):
    return spark.range(60_000).selectExpr("cast(id % 20000 as double) AS CustomerID", "concat('s', id % 3000) AS StockCode",
                                          "if(id % 5 = 0, null, concat('c', id % 40)) AS Country", "concat('i', id) AS InvoiceNo")


def test_approximate_distinct_counts(spark):
    df = lines(spark)
    exact, near = Q.stats(df).first(), Q.stats(df, approximate=True).first()
    assert exact["total_records"] == near["total_records"]
    for c in ("unique_customers", "unique_products", "unique_countries", "unique_invoices"):
        assert abs(near[c] - exact[c]) <= 0.03 * exact[c]
    assert "Expand" not in Q.stats(df, approximate=True)._jdf.queryExecution().executedPlan().toString()
    a, b = ({r["column"]: r for r in P.column_stats(df, approximate=x).collect()} for x in (False, True))
    assert all(abs(a[c]["unique_count"] - b[c]["unique_count"]) <= 0.03 * a[c]["unique_count"] and a[c]["null_count"] == b[c]["null_count"] for c in a)


def test_exact_distinct_counts_without_expand(spark):
    df = lines(spark).withColumns({"z": F.expr("if(InvoiceNo = 'i1', -0.0D, if(InvoiceNo = 'i2', double('NaN'), 0.0D))"), "none": F.lit(None).cast("int")})
    stats = P.column_stats(df)
    got = {r["column"]: r["unique_count"] for r in stats.collect()}
    want = df.agg(*[F.countDistinct(c).alias(c) for c in df.columns]).first().asDict()
    assert got == want and got["z"] == 2 and got["none"] == 0
    text = df.select(F.concat(F.col("StockCode"), F.lit("-X")).alias("t"), "Country", F.lit(None).cast("string").alias("n"))
    profile = P.text_profile(text, ["t", "Country", "n"])
    by = {r["column"]: r for r in profile.collect()}
    assert (by["t"]["case_sensitive_unique"], by["t"]["unique_count_reduction"], by["n"]["case_insensitive_unique"]) == (3000, 2999, 0)     # cleaned: all "sx"
    for d in (stats, profile):
        assert "Expand" not in d._jdf.queryExecution().executedPlan().toString()
    assert P.column_stats(df.limit(0)).agg(F.max("unique_count")).first()[0] == 0
