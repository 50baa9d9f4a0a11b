"""Baskets, frequent itemsets, sampling."""

from itertools import combinations

from pyspark.sql import functions as F

from cartwise.operators import mining as M
from cartwise.operators.baskets import create_baskets


def _lines(spark, rows):
    df = spark.createDataFrame(rows, "InvoiceNo string, Description string, Quantity int, TransactionValue double, "
                                     "CustomerID double, InvoiceDate timestamp_ntz")
    return df.withColumn("row_order", F.monotonically_increasing_id())


def test_baskets_keep_singles_and_order(spark):
    rows = [("001", "item1", 1, 1.0, None, None), ("001", "item2", 1, 1.0, 5.0, None), ("001", "item3", 1, 1.0, 6.0, None),
            ("002", "item2", 2, 2.0, 7.0, None), ("002", "item4", 1, 1.0, 7.0, None), ("003", "item5", 1, 1.0, 8.0, None)]
    b = {r["InvoiceNo"]: r for r in create_baskets(_lines(spark, rows)).collect()}
    assert b["001"]["Items"] == ["item1", "item2", "item3"]
    assert b["001"]["CustomerID"] == 5.0          # first non-null
    assert b["002"]["Quantity"] == 3
    assert b["003"]["Items"] == ["item5"]


def test_all_single_baskets_empty(spark):
    rows = [("001", "a", 1, 1.0, 1.0, None), ("002", "b", 1, 1.0, 1.0, None), ("003", "c", 1, 1.0, 1.0, None)]
    assert create_baskets(_lines(spark, rows)).count() == 0


def _brute(tx, min_support, max_size):
    n, out = len(tx), {}
    items = sorted({i for t in tx for i in t})
    for k in range(2, max_size + 1):
        for c in combinations(items, k):
            s = sum(1 for t in tx if set(c) <= set(t))
            if s >= min_support * n:
                out["|".join(c)] = s
    return out


def test_fpgrowth_equals_bruteforce(spark):
    tx = [["a", "b", "c"], ["a", "b"], ["b", "c"], ["a", "c", "d"], ["a", "b", "c", "d"], ["b", "d"], ["a", "b", "d"]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(tx)], "InvoiceNo string, Items array<string>")
    for ms in (0.2, 0.3, 0.5):
        got = {r["bundle"]: r["support_count"] for r in M.mine_bundles(df, ms, 3).collect()}
        assert got == _brute(tx, ms, 3)


def test_support_monotone_and_max_size(spark):
    tx = [["a", "b", "c"], ["a", "b", "c"], ["a", "b"], ["c", "d"]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(tx)], "InvoiceNo string, Items array<string>")
    lo, hi = M.mine_bundles(df, 0.25, 5).count(), M.mine_bundles(df, 0.6, 5).count()
    assert lo >= hi
    assert M.mine_bundles(df, 0.25, 2).agg(F.max("size")).first()[0] == 2


def test_duplicate_items_in_basket(spark):
    df = spark.createDataFrame([("1", ["a", "a", "b"]), ("2", ["a", "b"])], "InvoiceNo string, Items array<string>")
    assert {r["bundle"] for r in M.mine_bundles(df, 0.5, 3).collect()} == {"a|b"}
    fi = {r["item"]: r["item_count"] for r in M.frequent_items(df, 0.5).collect()}
    assert fi == {"a": 3, "b": 2}                 # occurrences, repeats included


def test_hash_sample_exact_and_deterministic(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("InvoiceNo"))
    a = sorted(r[0] for r in M.hash_sample(df, "InvoiceNo", 137).collect())
    b = sorted(r[0] for r in M.hash_sample(df.repartition(13), "InvoiceNo", 137).collect())
    assert len(a) == 137 and a == b
    assert M.quick_sample_size(1000) == 25 and M.quick_sample_size(100000) == 500


def _random_baskets(spark, n, seed=3):
    import random
    rng = random.Random(seed)
    tx = [[x for x in "abcdefgh" if rng.random() < (0.75 if x < "e" else 0.3)] for _ in range(n)]
    tx = [t + t[:1] for t in tx] + [[], ["a"]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(tx)] + [("n", None), ("m", ["a", None, "b"])],
                               "InvoiceNo string, Items array<string>")
    return tx + [[], ["a", "b"]], df


def test_levelwise_search_equals_brute_force_up_to_five(spark):
    tx, df = _random_baskets(spark, 300)
    df = df.repartition(3)
    for support, size in ((0.05, 5), (0.1, 3), (0.3, 5)):
        for block in (64, M.BLOCK_BASKETS):
            got = {r["bundle"]: r["support_count"] for r in M.mine_bundles_levelwise(df, support, size, block_baskets=block).collect()}
            assert got == _brute(tx, support, size)
    assert max(len(b.split("|")) for b in _brute(tx, 0.05, 5)) == 5


def test_levelwise_search_forms_no_set_above_its_size_and_prunes(spark, monkeypatch):
    tx, df = _random_baskets(spark, 200)
    formed = []
    monkeypatch.setattr(M, "candidates", lambda level, k, f=M.candidates: (lambda made: formed.append((k, {tuple(r["items"]) for r in made.collect()})) or made)(f(level, k)))
    plans = M.mine_bundles_levelwise(df, 0.05, 3)
    assert [k for k, _ in formed] == [2, 3] and all(len(s) == k for k, sets in formed for s in sets)
    pairs = {tuple(b.split("|")) for b in _brute(tx, 0.05, 2)}
    assert all(p in pairs for s in formed[1][1] for p in combinations(s, 2))       # every subset is frequent
    assert "FPGrowth" not in plans._jdf.queryExecution().toString()
    formed.clear()
    assert M.mine_bundles_levelwise(df, 0.99, 5).count() == 0 and [k for k, _ in formed] == [2]      # stops at the empty level
    empty = spark.createDataFrame([], "InvoiceNo string, Items array<string>")
    assert M.mine_bundles_levelwise(empty, 0.1, 3).count() == 0
    counts = {r["size"]: r["n_itemsets"] for r in M.level_counts(M.mine_bundles_levelwise(df, 0.05, 3), 5).collect()}
    assert counts[2] == len(pairs) and counts[4] == 0 and 5 not in counts


def test_mining_releases_the_baskets_it_keeps(spark):
    _, df = _random_baskets(spark, 50)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    M.mine_bundles(df.filter(F.col("Items").isNotNull()).withColumn("Items", F.filter("Items", lambda x: x.isNotNull())), 0.1, 3).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
