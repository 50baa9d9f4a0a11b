"""Where no key comes twice, baskets are scored where they lie, as the joins by item and key score them."""

import random

import numpy as np
from pyspark.sql import functions as F

from cartwise.operators import features as X
from cartwise.operators import models as MD


def test_baskets_are_scored_where_they_lie(spark):
    rng = random.Random(11)
    rows = [(str(i), [x for x in "abcdef" if rng.random() < 0.4] * 2 + [None], i % 5) for i in range(120)]
    rows = [(k, b, int(("a" in b) != (rng.random() < 0.1)), f) for k, b, f in rows] + [(None, ["a", "b"], 1, 2), ("e", [], 0, 3), ("n", None, 1, 4)]
    df = spark.createDataFrame(rows, "InvoiceNo string, Items array<string>, label int, fold int").coalesce(2).cache()
    vocab = X.vocabulary(df)
    train, odd = df.filter("fold < 4 AND InvoiceNo IS NOT NULL"), df.withColumn("Items", F.concat("Items", F.array(F.lit("unknown"))))

    def scores(frame):
        return {(r["InvoiceNo"], r["fold"]): (r["prediction"], r["p1"] if "p1" in frame.columns else 0.0) for r in frame.collect()}

    def same(here, joined):
        a, b = scores(here), scores(joined)
        assert a.keys() == b.keys() and len(a) == len(rows)
        assert all(a[k][0] == b[k][0] and np.isclose(a[k][1], b[k][1], rtol=1e-9, atol=1e-12) for k in b)
        return here._jdf.queryExecution().optimizedPlan().toString()

    for model in MD.fit_all(train, vocab, one_row_a_key=True).values():
        plan = same(model.predict_proba(odd, one_row_a_key=True), model.predict_proba(odd))
        assert "Join" not in plan and "Generate" not in plan
    for validate in (MD.cv_multinomial_nb, MD.cv_gaussian_nb):
        plan = same(validate(df, vocab, 5, one_row_a_key=True), validate(df, vocab, 5))
        assert "ArrowEvalPython" in plan
    plan = same(MD.cv_svm(df, 5, one_row_a_key=True), MD.cv_svm(df, 5))
    assert "Generate" not in plan and "Aggregate" not in plan


def test_baskets_of_no_fold_are_scored_alike(spark):
    """A fold that the models do not have: its baskets have priors alone, or no row, in both ways."""
    rows = [(str(i), ["a"] if i % 3 else ["b"], i % 2, i % 4) for i in range(40)] + [("x", ["a"], 1, 7), ("y", ["b"], 0, None)]
    df = spark.createDataFrame(rows, "InvoiceNo string, Items array<string>, label int, fold int").coalesce(1).cache()
    vocab = X.vocabulary(df)
    for validate in (lambda **k: MD.cv_multinomial_nb(df, vocab, 4, **k), lambda **k: MD.cv_gaussian_nb(df, vocab, 4, **k)):
        here, joined = ({r["InvoiceNo"]: (r["fold"], r["prediction"]) for r in validate(one_row_a_key=way).collect()} for way in (True, False))
        assert here == joined
