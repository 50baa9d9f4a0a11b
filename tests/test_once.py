"""Steps that the basket queries share run once and move no basket: the gate, the labels, the trees."""

import itertools

from pyspark.sql import functions as F

from cartwise.operators.baskets import create_baskets
from cartwise.operators.features import label_baskets

LINE = "InvoiceNo string, Description string, CustomerID double, InvoiceDate timestamp, TransactionValue double, Quantity int, row_order int"


def _lines(spark, rows, seen=None):
    df = spark.createDataFrame([(i, d, 1.0, None, 1.0, 1, at) for at, (i, d) in enumerate(rows)], LINE).coalesce(1)
    return df if seen is None else df.filter(F.udf(lambda x: seen.add(1) or True, "boolean")("InvoiceNo"))


def _rows(df):
    return sorted(map(str, df.collect()))


def test_whether_a_basket_has_two_items_is_looked_up_in_the_kept_baskets(spark):
    rows = [("1", "a"), ("1", "b"), ("2", "a"), (None, "c")]
    seen, kept = spark.sparkContext.accumulator(0), []

    def keep(df):
        kept.append(df.persist())
        return kept[-1]
    got = create_baskets(_lines(spark, rows, seen), keep=keep)
    assert _rows(got) == _rows(create_baskets(_lines(spark, rows))) and len(kept) == 1
    assert seen.value <= 2 * len(rows) - 1          # before: a run for the gate beside that for the baskets
    assert "Subquery" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert create_baskets(_lines(spark, [("1", "a"), ("2", "b")]), keep=keep).collect() == []
    for df in kept:
        df.unpersist()


def test_baskets_are_labelled_where_they_lie(spark):
    held = [["a", "b", "c"], ["a"], [], None, ["b", None, "c"], ["x", "y", "z"], ["x", "y"], ["q", "a", "a"]]
    sets = [["a", "b"], ["x", "y", "z"], ["q"], ["b", "c", "n"], [None, "a"]]
    df = spark.createDataFrame([(str(k), b) for k, b in enumerate(held)], "InvoiceNo string, Items array<string>").repartition(2)
    bundles = spark.createDataFrame([(b,) for b in sets], "items array<string>")
    wanted = {str(k): int(any(None not in s and set(s) <= set(b or ()) for s in sets)) for k, b in enumerate(held)}
    here = label_baskets(df, bundles, one_row_a_key=True)
    for out in (here, label_baskets(df, bundles), label_baskets(df, bundles, broadcast_bytes=0)):
        assert {r["InvoiceNo"]: r["label"] for r in out.collect()} == wanted and out.columns == ["InvoiceNo", "Items", "label"]
    assert "Join" not in here._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_key_share_their_label_and_a_null_key_has_none(spark):
    df = spark.createDataFrame([("1", ["a", "b"]), ("1", ["c"]), (None, ["a", "b"])], "InvoiceNo string, Items array<string>")
    bundles = spark.createDataFrame([(["a", "b"],)], "items array<string>")
    for limit in (0, 1 << 20):
        assert sorted((r["InvoiceNo"] or "", r["label"]) for r in label_baskets(df, bundles, broadcast_bytes=limit).collect()) == [("", 0), ("1", 1), ("1", 1)]
    assert [r["label"] for r in label_baskets(df.filter("InvoiceNo IS NULL"), bundles, one_row_a_key=True).collect()] == [0]


def test_baskets_with_the_same_most_frequent_items_lie_together(spark):
    from cartwise.operators.mining import _tree_path, mine_bundles
    frequent = [{"item": "a", "n": 9}, {"item": "b", "n": 9}, {"item": "c", "n": 4}]
    df = spark.createDataFrame([(["c", "b", "a"],), (["b", "z", "a"],), (["b"],), (["z", None],), (None,)], "items array<string>")
    assert [r[0] for r in df.coalesce(1).select(_tree_path(frequent)("items")).collect()] == [1 << 32 | 2, 1 << 32 | 2, 2 << 32 | 2, 0, 0]
    held = [[x for x in "abcdefg" if (k * 7 + ord(x) * 3) % 11 < 5] + (["hot", "pair"] if k % 3 else []) for k in range(150)]
    baskets = spark.createDataFrame([(str(k), b) for k, b in enumerate(held)], "InvoiceNo string, Items array<string>")
    names = sorted({i for b in held for i in b})
    counted = {"|".join(s): n for k in (2, 3) for s in itertools.combinations(names, k) if (n := sum(set(s) <= set(b) for b in held)) >= 15}
    assert {r["bundle"]: r["support_count"] for r in mine_bundles(baskets, 0.1, 3).collect()} == counted and counted


def test_a_baskets_label_goes_with_its_items(spark):
    from cartwise.operators import models as MD
    rows = [(str(k), [x for x in "abcd" if (k * 3 + ord(x)) % 5 < 2] + [None], k % 2, k % 3) for k in range(24)] + [("e", [], 1, 0), ("n", None, 0, 1), (None, ["a"], 1, 2)]
    df = spark.createDataFrame(rows, "InvoiceNo string, Items array<string>, label int, fold int")
    vocab = spark.createDataFrame([(x,) for x in "abcd"], "item string")
    for fit in (MD.fit_multinomial_nb, MD.fit_gaussian_nb):
        here = fit(df, vocab, one_row_a_key=True)
        assert _rows(here.params) == _rows(fit(df, vocab).params) and here.base.collect() == fit(df, vocab).base.collect()
    assert MD.cross_validate(df, vocab, 3, one_row_a_key=True).collect() == MD.cross_validate(df, vocab, 3).collect()
    plan = MD._items_with(df, ["label"], "InvoiceNo", "Items", True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
