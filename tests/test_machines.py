"""SVMs: several machines in one pass, kernels by feature maps, calibration, persistence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.operators import machines as K
from cartwise.operators import models as MD

SCHEMA = "InvoiceNo string, Items array<string>, label int"


def accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def noisy(n, seed, rule):
    rng, rows = random.Random(seed), []
    for i in range(n):
        held = [x for x in "abcdefgh" if rng.random() < 0.4]
        rows.append((str(i), held + held[:1], int(rule(held, rng))))
    return rows


@pytest.fixture(scope="module")
def xor(spark):
    """Two items decide by exclusive or; the four cases are equally frequent, so no line does better than chance."""
    rng = random.Random(7)
    rows = [(str(i), [x for x, on in (("a", i % 2), ("b", i // 2 % 2)) if on] + [f"n{rng.randrange(3)}"], int(i % 2 != i // 2 % 2)) for i in range(600)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2).cache()


def test_rbf_separates_what_no_line_does(xor):
    models = {k: MD.fit_svm(xor, kernel=k, max_iter=60) for k in ("linear", "rbf")}
    lined = models["linear"].predict_proba(xor)
    # A line can still place one of the four corners on the right side of half: judged on balanced corners.
    assert accuracy(lined) <= 0.8 and accuracy(models["rbf"].predict_proba(xor)) >= 0.95
    weights = {r["item"]: r["w"] for r in models["linear"].weights.collect()}
    assert set(weights) == {"a", "b", "n0", "n1", "n2"}


def test_poly_separates_what_no_line_does(xor):
    assert accuracy(MD.fit_svm(xor, kernel="poly", degree=2, coef0=1.0, max_iter=60).predict_proba(xor)) >= 0.95


def scaled_rows(features, baskets):
    names = sorted(features.scale)
    return np.array([[features.scale[i] if i in set(b) else 0.0 for i in names] for b in baskets])


@pytest.mark.parametrize("kernel,params,limit", [("rbf", {"n_components": 2048}, 0.05), ("poly", {"coef0": 1.0}, 0.05), ("sigmoid", {}, 0.05)])
def test_feature_maps_approach_their_kernels(spark, kernel, params, limit):
    rng = random.Random(3)
    baskets = [[f"i{k}" for k in range(12) if rng.random() < 0.3] for _ in range(600)]
    df = spark.createDataFrame([(str(i), b, i % 2, -1) for i, b in enumerate(baskets)], SCHEMA + ", left_out int")
    stats = K.item_stats(df, "Items", 1)
    features = MD.kernel_map(df, stats, kernel, **params)
    sample = baskets[:200]
    z, x = features.features(sample), scaled_rows(features, sample)
    exact = features.kernel(x, x)
    if kernel == "sigmoid":        # not positive semi-definite: the nearest such matrix is what a map can reach
        values, vectors = np.linalg.eigh(exact)
        assert np.abs(z @ z.T - (vectors * np.clip(values, 0, None)) @ vectors.T).mean() < limit
    assert np.abs(z @ z.T - exact).mean() < limit * max(1.0, np.abs(exact).mean())
    assert features.features([["unknown"], [], None]).shape == (3, features.size)


def test_gamma_scale_is_the_variance_rule(spark):
    baskets = [["a"], ["a", "b"], ["b"], ["a", "c"]]
    df = spark.createDataFrame([(str(i), b, 0, -1) for i, b in enumerate(baskets)], SCHEMA + ", left_out int")
    stats = K.item_stats(df, "Items", 1)
    dense = np.array([[float(i in b) for i in "abc"] for b in baskets])
    scaled = dense / dense.std(axis=0, ddof=1)
    assert np.isclose(MD.kernel_gamma(stats), 1 / (3 * scaled.var()))
    assert MD.kernel_gamma(stats, "auto") == 1 / 3 and MD.kernel_gamma(stats, 0.25) == 0.25
    with pytest.raises(ValueError):
        MD.kernel_gamma(stats, "other")


def test_machines_together_equal_machines_alone(spark):
    """Three folds in one training reach the weights that each fold's own training reaches."""
    rows = noisy(900, 5, lambda held, rng: ("a" in held) + ("b" in held) - ("c" in held) + rng.gauss(0, 0.4) > 0.5)
    df = spark.createDataFrame([(*r, int(r[0]) % 3) for r in rows], SCHEMA + ", fold int").coalesce(2).cache()
    together = df.withColumn("left_out", F.col("fold"))
    stats = K.item_stats(together, "Items", 3)
    places = K.Positions({i: k for k, i in enumerate(stats.items)})
    fitted = K.train(together, "Items", places, stats, deviation=stats.deviation(), tol=1e-8, max_iter=300)
    shuffled = K.train(together, "Items", places, stats, deviation=stats.deviation(), tol=1e-8, max_iter=300, direct_cells=0)
    assert np.allclose(fitted.losses, shuffled.losses, rtol=1e-4)
    for k in range(3):
        alone = df.filter(F.col("fold") != k).withColumn("left_out", F.lit(-1))
        own = K.item_stats(alone, "Items", 1)
        one = K.train(alone, "Items", places, own, deviation=own.deviation(), tol=1e-8, max_iter=300)
        assert np.isclose(fitted.losses[k], one.losses[0], rtol=1e-3)
    predicted = MD.cv_svm(df, 3)
    by_fold = {r["fold"]: r["a"] for r in predicted.groupBy("fold").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).collect()}
    for k in range(3):
        single = accuracy(MD.fit_svm(df.filter(F.col("fold") != k)).predict_proba(df.filter(F.col("fold") == k)))
        assert abs(by_fold[k] - single) <= 0.01 and single > 0.8


def test_training_reaches_the_optimum(spark):
    """The objective against a plain subgradient-free reference: coordinate search on the same smooth loss."""
    rows = noisy(200, 9, lambda held, rng: ("a" in held) != (rng.random() < 0.1))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("left_out", F.lit(-1))
    stats = K.item_stats(df, "Items", 1)
    fitted = K.train(df, "Items", K.Positions({i: k for k, i in enumerate(stats.items)}), stats, deviation=stats.deviation(), tol=1e-9, max_iter=400)
    x = np.array([[float(i in r[1]) for i in stats.items] for r in rows]) / stats.deviation()[:, 0]
    y, n = np.array([2 * r[2] - 1 for r in rows]), len(rows)

    def objective(u, b):
        slack = 1 - y * (x @ u + b)
        bent = np.clip(slack / K.SMOOTH, 0, 1)
        return (bent * (slack - K.SMOOTH / 2 * bent)).mean() + u @ u / (2 * n)

    u, b = fitted.weights[:, 0] * stats.deviation()[:, 0], fitted.bias[0]
    assert np.isclose(objective(u, b), fitted.losses[0])
    rng = np.random.default_rng(1)
    for size in (1.0, 0.1, 0.01):
        for _ in range(400):
            assert objective(u + rng.normal(0, size, len(u)), b + rng.normal(0, size)) >= fitted.losses[0] - 1e-6


def test_platt_scaling_is_the_maximum_of_its_likelihood(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(0, 2, 3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.7 * m - 0.4)))).astype(int)
    a, b = K.calibrate(spark.createDataFrame(list(zip(m.tolist(), y.tolist())), "_margin double, label int"))
    assert abs(a - 1.7) < 0.15 and abs(b + 0.4) < 0.15
    a, b = K.calibrate(spark.createDataFrame([(2.0, 1), (3.0, 1), (-2.0, 0), (-4.0, 0)], "_margin double, label int"))
    assert 0 < a < 10 and np.isfinite(b)


def test_odd_rows_and_wrong_parameters(spark):
    df = spark.createDataFrame([("1", ["a", None], 1), ("2", [], 0), ("3", None, 0), ("4", ["a", "a"], 1)] * 5, SCHEMA)
    model = MD.fit_svm(df)
    assert accuracy(model.predict_proba(df.dropDuplicates(["InvoiceNo"]))) == 1.0
    assert accuracy(MD.fit_svm(df, kernel="rbf", n_components=64).predict_proba(df)) == 1.0
    with pytest.raises(ValueError):
        MD.fit_svm(df, kernel="cubic")
    with pytest.raises(ValueError):
        MD.fit_svm(df.filter("label = 1"))
    with pytest.raises(ValueError):
        K.item_stats(df.withColumn("left_out", F.lit(-1)), "Items", 2, max_cells=1)


@pytest.mark.parametrize("kernel", MD.KERNELS)
def test_saved_machines_score_the_same(spark, xor, tmp_path, kernel):
    from cartwise.sources.files import load_svm_model, save_svm_model
    model = MD.fit_svm(xor, kernel=kernel, n_components=64, max_iter=15)
    save_svm_model(model, str(tmp_path / kernel))
    again = load_svm_model(spark, str(tmp_path / kernel))
    scores = lambda m: {r["InvoiceNo"]: (r["p1"], r["prediction"]) for r in m.predict_proba(xor).collect()}
    want, got = scores(model), scores(again)
    assert all(np.isclose(want[k][0], got[k][0]) and want[k][1] == got[k][1] for k in want)


def test_saved_engine_has_models_bundles_and_time(spark, xor, tmp_path):
    from cartwise.operators.features import vocabulary
    from cartwise.sources.files import load_engine, save_engine
    models = MD.fit_all(xor, vocabulary(xor), ("nb", "svm"))
    bundles = spark.createDataFrame([(["a", "b"], 2)], "items array<string>, size int")
    save_engine(models, bundles, str(tmp_path / "engine"), "2024-05-01T10:00:00")
    again, kept, at = load_engine(spark, str(tmp_path / "engine"))
    assert set(again) == {"nb", "svm"} and kept.collect() == bundles.collect() and at == "2024-05-01T10:00:00"
    for n in again:
        a, b = (sorted((r["InvoiceNo"], round(r["p1"], 9)) for r in m.predict_proba(xor).collect()) for m in (models[n], again[n]))
        assert a == b


def test_svm_numbers_on_the_given_tables(spark):
    """L16S (made of L13S and L14S) and L17S (made of L09's fit) at sf0.01: bounds of accuracy, calibration and agreement."""
    from cartwise.plans import q_models as Q
    sf = "/root/testdata/sf0.01"
    both = {r["model"]: r for r in Q.l16s(spark, sf).collect()}
    assert set(both) == {"nb", "gnb", "svm"}
    assert both["svm"]["random_accuracy"] > 0.99 and both["svm"]["kfold_accuracy"] > 0.99 and both["svm"]["kfold_f1"] > 0.99
    for r in both.values():
        assert all(np.isclose(r[f"diff_{m}"], abs(r[f"random_{m}"] - r[f"kfold_{m}"]), atol=1e-6) for m in ("accuracy", "precision", "recall", "f1"))
    for m, r in {r["model"]: r for r in Q.l14(spark, sf).collect()}.items():        # the rows that SQL checks
        assert all(both[m][f"random_{x}"] == r[x] for x in ("accuracy", "precision", "recall", "f1"))
    plain = {r["request_id"]: r for r in Q.l17(spark, sf).collect()}
    marks = {r["InvoiceNo"]: r["label"] for r in Q.split(spark, sf).filter("is_test").collect()}
    rows = Q.l17s(spark, sf).collect()
    assert len(rows) == len(plain) == len(marks)
    for r in rows:
        assert (r["nb"], r["gnb"]) == (plain[r["request_id"]]["nb"], plain[r["request_id"]]["gnb"])
        assert abs(r["ensemble"] - (r["nb"] + r["svm"]) / 2) < 1e-6
    p, y = np.array([r["svm"] for r in rows]), np.array([marks[r["request_id"]] for r in rows])
    assert ((p > 0.5) == y).mean() > 0.99
    bins = np.minimum((p * 5).astype(int), 4)
    assert sum(abs(p[bins == k].mean() - y[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins)) < 0.02
