"""Kernel machines' passes: raw features by rows and positions, feature maps applied to weights, refused steps together."""

import random

import numpy as np
import pytest

from cartwise.operators import machines as K
from cartwise.operators import models as MD


def exact(features, baskets):
    """The features' defining formulas, row by row."""
    out = []
    for b in baskets:
        held = {i for i in (b or ()) if features.scale.get(i)}
        if isinstance(features, K.FourierMap):
            angles = sum((features._normals(f"item|{i}").standard_normal(features.size) * np.sqrt(2 * features.gamma) * features.scale[i] for i in held),
                         features._normals("shift").uniform(0, 2 * np.pi, features.size))
            out.append(np.sqrt(2 / features.size) * np.cos(angles))
        else:
            dots = np.array([sum(features.scale[i] ** 2 for i in held & set(x)) for x in features.landmarks])
            inner = features.gamma * dots + features.coef0
            out.append((inner ** features.degree if features.kind == "poly" else np.tanh(inner)) @ features.root)
    return np.array(out)


@pytest.mark.parametrize("kept", [1 << 20, 3 * 48 * 16])       # all items' vectors are kept, or few
def test_passes_equal_the_features_formulas(monkeypatch, kept):
    monkeypatch.setattr(K, "VECTOR_BYTES", kept)
    monkeypatch.setattr(K, "DENSE_ROWS", 16)
    rng = random.Random(5)
    baskets = [[f"i{k}" for k in range(15) if rng.random() < 0.2] * 2 + [None, "unknown"] for _ in range(90)] + [None, [], ["unknown"]]
    scale = {f"i{k}": 0.5 + rng.random() for k in range(15)}
    maps = [K.FourierMap(scale, 0.3, 48), *[K.LandmarkMap(scale, 0.3, 0, kind, degree, coef0, baskets[:30]) for kind, degree, coef0 in (
        ("poly", 3, 0.0), ("poly", 2, 1.0), ("sigmoid", 3, 0.0), ("sigmoid", 3, -0.4))]]
    for features in maps:
        want, block = exact(features, baskets), features.encode(K.listed(baskets))
        for machines in (1, 5):
            weights, d = (np.random.default_rng(1).normal(size=(n, machines)) for n in (features.size, len(baskets)))
            margins, slopes = np.zeros(d.shape), 0
            for rows, part, add in features.pieces(block, features.lift(weights)):
                margins[rows] = part
                slopes = slopes + add(d[rows])
            assert np.allclose(margins, want @ weights, rtol=1e-5, atol=1e-5)
            assert np.allclose(features.lower(slopes), want.T @ d, rtol=1e-5, atol=1e-4)
        assert np.allclose(features.features(baskets), want, rtol=1e-5, atol=1e-6)
        assert np.allclose(features.margins(K.listed(baskets), np.arange(features.size)), want @ np.arange(features.size), rtol=1e-4, atol=1e-3)


def test_rows_never_meet_the_landmarks_root():
    """A pass has kernels with the landmarks alone; the root meets weights and gradients."""
    features = K.LandmarkMap({"a": 1.0, "b": 2.0, "c": 1.0}, 0.5, 0, "poly", 2, 1.0, [["a"], ["b"], ["a", "b"]])
    block = features.encode(K.listed([["a"], ["b", "c"]]))
    lifted = features.lift(np.ones((features.size, 1)))
    features.root = None
    assert sum(len(rows) for rows, _, _ in features.pieces(block, lifted)) == 2 and "c" not in features.index


def test_refused_steps_are_evaluated_together():
    """The points of a descent are those of one step at a time, in fewer passes."""
    def run(ahead):
        descent, points, passes = K.Descent(1, 1e-9), [], 0
        while not descent.done and descent.steps < 30:
            begun, passes = descent.steps, passes + 1
            for point in descent.trials(ahead):
                if descent.awaits(point):
                    x = point[0]
                    points.append(x)
                    descent.feed(1e6 * abs(x - 1) ** 1.5 + x, np.array([1.5e6 * abs(x - 1) ** 0.5 * np.sign(x - 1) + 1]))
            descent.refused += descent.steps == begun
        return points, passes

    (alone, many), (together, few) = run(0), run(K.AHEAD)
    assert alone == together and few < many == len(alone)


def test_no_second_machine_without_its_use(spark, monkeypatch):
    """Keys that all hash below the cut leave nothing to calibrate on: the second machine's fit would be thrown away."""
    from cartwise.operators.features import random_split
    rng = random.Random(2)
    rows = [(str(i), [x for x in "abcd" if rng.random() < 0.5] + ["e"], i % 2) for i in range(150)]
    df = random_split(spark.createDataFrame(rows, "InvoiceNo string, Items array<string>, label int").coalesce(2)).filter("not is_test")
    fitted, train = [], MD.train_machines
    monkeypatch.setattr(MD, "train_machines", lambda *a: fitted.append(train(*a)) or fitted[-1])
    for kernel in MD.KERNELS:
        assert MD.fit_svm(df, kernel=kernel, n_components=16, max_iter=3).predict_proba(df).count() == df.count()
    assert [f.weights.shape[1] for f in fitted] == [1] * 4
