"""Bundle classifiers: native Naive Bayes (L06, L07), SVM (L09–L11), cross-validation and
fitting of all models (L13, L14), prediction (L15).

Naive Bayes is fitted from aggregates into a small parameter table
(class × item, bounded by the catalogue) and scored with joins, so its
probabilities match scikit-learn's (empirical priors, alpha = 1), which Spark
ML's ``NaiveBayes`` does not (it smooths the prior).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cartwise.operators.features import basket_items, random_split
from cartwise.operators.machines import MAX_CELLS, Block, FourierMap, ItemStats, KernelMap, LandmarkMap, Positions, calibrate, item_stats
from cartwise.operators.machines import train as train_machines
from cartwise.operators.mining import hash_sample


def item_sums(names: list, weights: np.ndarray):
    """Per basket the sums of its known items' weights, one for each column, as a function of its items.

    ``weights`` of three dimensions are items x folds x columns: a basket then takes those of its fold, the
    function's second argument.  The table is bounded by the catalogue, as the machines' coefficients are.
    """
    places, folds = Positions({item: k for k, item in enumerate(names)}), weights.shape[1] if weights.ndim == 3 else 1
    flat = weights.reshape(len(names) * folds, weights.shape[-1])

    def sums(held: pa.Array, fold: pa.Array | None) -> pa.Array:
        block = places.encode(held)
        if fold is not None:
            block = Block(block.idx * folds + np.repeat(fold.to_numpy(zero_copy_only=False), np.diff(block.ptr)), block.ptr)
        out = np.empty((block.n, flat.shape[1]))
        for rows, margins, _ in places.pieces(block, flat):
            out[rows] = margins
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.reshape(-1))

    @F.arrow_udf("array<double>")
    def of_all(held: pa.Array) -> pa.Array:
        return sums(held, None)

    @F.arrow_udf("array<double>")
    def of_fold(held: pa.Array, fold: pa.Array) -> pa.Array:
        return sums(held, fold)

    return of_all if weights.ndim == 2 else of_fold


def _summed(key: str, items: str, names: list, weights: np.ndarray, fold: str | None = None):
    """``item_sums`` as a column; a null key has no items, as in the joins by key, nor has a basket of no such fold."""
    known = F.col(key).isNotNull()
    if fold is None:
        return item_sums(names, weights)(F.when(known, F.col(items)))
    known = known & F.col(fold).between(0, weights.shape[1] - 1)
    return item_sums(names, weights)(F.when(known, F.col(items)), F.when(known, F.col(fold)).otherwise(0).cast("int"))


def _collected(params: DataFrame, columns: list) -> tuple[list, np.ndarray]:
    table = params.select("item", *columns).toArrow()
    return table.column("item").to_pylist(), np.stack([table.column(c).to_numpy() for c in columns], axis=1).astype(np.float64)


@dataclass
class NBModel:
    kind: str                  # "multinomial" | "gaussian"
    params: DataFrame          # item, w0, w1 (per-item additive log-terms for classes 0 / 1)
    base: DataFrame            # one row: b0, b1 (class log-prior + per-class constants)
    classes: list

    def predict_proba(self, baskets: DataFrame, key: str = "InvoiceNo", items: str = "Items", one_row_a_key: bool = False) -> DataFrame:
        """``p1`` = P(label = 1) and ``prediction`` per basket.  ``one_row_a_key`` as in ``label_baskets``: a basket is scored where it lies."""
        if one_row_a_key and self.params.count() <= MAX_CELLS // 2:
            names, weights = _collected(self.params, ["w0", "w1"])
            scored = baskets.withColumn("_s", _summed(key, items, names, weights)).select(
                *baskets.columns, F.get("_s", F.lit(0)).alias("s0"), F.get("_s", F.lit(1)).alias("s1"))
        else:
            sums = (basket_items(baskets, key, items).join(self.params, "item")
                    .groupBy(key).agg(F.sum("w0").alias("s0"), F.sum("w1").alias("s1")))
            scored = baskets.join(sums, key, "left")
        b = self.base.first()
        j0 = F.lit(b["b0"]) + F.coalesce(F.col("s0"), F.lit(0.0))
        j1 = F.lit(b["b1"]) + F.coalesce(F.col("s1"), F.lit(0.0))
        scored = scored.withColumn("_d", j0 - j1)
        if self.classes == [0, 1]:
            p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_d")))
            pred = F.when(j1 > j0, 1).otherwise(0)
        else:  # one class seen: P(1) is 1 or 0
            p1 = F.lit(float(self.classes[0]))
            pred = F.lit(self.classes[0])
        return scored.withColumn("p1", p1).withColumn("prediction", pred).drop("s0", "s1", "_d")


def _class_counts(train: DataFrame):
    cc = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # <= 2 rows
    counts = {int(r["label"]): int(r["n"]) for r in cc}
    if not counts:
        raise ValueError("empty training set")
    return counts


def _items_with(data: DataFrame, cols: list, key: str, items: str, one_row_a_key: bool) -> DataFrame:
    """Key, ``cols``, item of each basket.  Where no key comes twice a basket's own columns go with its items; else they are joined by key."""
    if not one_row_a_key:
        return basket_items(data, key, items).join(data.select(key, *cols), key)
    return (data.filter(F.col(key).isNotNull()).select(key, *cols, F.explode(F.array_distinct(items)).alias("item"))
            .filter(F.col("item").isNotNull()))


def fit_multinomial_nb(train: DataFrame, vocab: DataFrame, alpha: float = 1.0,
                       key: str = "InvoiceNo", items: str = "Items", one_row_a_key: bool = False) -> NBModel:
    """theta = log((cnt + alpha) / (tot + alpha·V)), empirical log priors.

    ``one_row_a_key`` as in ``label_baskets``: no basket is then joined to itself.
    """
    counts = _class_counts(train)
    n = sum(counts.values())
    v = vocab.count()
    ci = (_items_with(train, ["label"], key, items, one_row_a_key)
          .groupBy("item").agg(F.count_if(F.col("label") == 0).alias("c0"),
                               F.count_if(F.col("label") == 1).alias("c1")))
    full = vocab.select("item").join(ci, "item", "left").fillna(0, ["c0", "c1"])
    tot = full.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1")).first()
    t0, t1 = float(tot["t0"] or 0), float(tot["t1"] or 0)
    params = full.select("item",
                         F.log((F.col("c0") + alpha) / (t0 + alpha * v)).alias("w0"),
                         F.log((F.col("c1") + alpha) / (t1 + alpha * v)).alias("w1"))
    lp = lambda c: math.log(counts[c] / n) if counts.get(c) else float("-inf")
    base = train.sparkSession.createDataFrame([(lp(0), lp(1))], "b0 double, b1 double")
    return NBModel("multinomial", params, base, sorted(counts))


def fit_gaussian_nb(train: DataFrame, vocab: DataFrame, var_smoothing: float = 1e-9,
                    key: str = "InvoiceNo", items: str = "Items", one_row_a_key: bool = False) -> NBModel:
    """Per class/item Bernoulli mean and variance p(1-p) + eps, eps = 1e-9·max feature variance.

    log N(x) for binary x: the x = 0 terms summed over the whole vocabulary go into the
    class constant; each present item adds ll(1) - ll(0).  Where no feature varies, the class
    priors decide.
    """
    counts = _class_counts(train)
    n = sum(counts.values())
    ci = (_items_with(train, ["label"], key, items, one_row_a_key)
          .groupBy("item").agg(F.count_if(F.col("label") == 0).alias("c0"),
                               F.count_if(F.col("label") == 1).alias("c1")))
    full = vocab.select("item").join(ci, "item", "left").fillna(0, ["c0", "c1"])
    p_all = (F.col("c0") + F.col("c1")) / F.lit(float(n))
    eps = var_smoothing * (full.agg(F.max(p_all * (1 - p_all))).first()[0] or 0.0)
    if eps == 0.0:      # every feature is constant: the prior is all there is to know
        full = full.filter(F.lit(False))
    cols = []
    for c in (0, 1):
        nc = float(counts.get(c, 0))
        mu = (F.col(f"c{c}") / F.lit(nc)) if nc else F.lit(0.0)
        var = mu * (1 - mu) + F.lit(eps)
        ll0 = -0.5 * F.log(2 * math.pi * var) - 0.5 * (mu * mu) / var
        ll1 = -0.5 * F.log(2 * math.pi * var) - 0.5 * ((1 - mu) * (1 - mu)) / var
        cols += [ll0.alias(f"z{c}"), (ll1 - ll0).alias(f"w{c}")]
    table = full.select("item", *cols)
    z = table.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("z0", "z1")]).first()
    lp = lambda c: math.log(counts[c] / n) if counts.get(c) else float("-inf")
    base = train.sparkSession.createDataFrame([(lp(0) + z["z0"], lp(1) + z["z1"])], "b0 double, b1 double")
    return NBModel("gaussian", table.select("item", "w0", "w1"), base, sorted(counts))


# SVM ----------------------------------------------------------------------------------
def _platt(margin, a: float, b: float):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin * a + b)))


class _Margins:
    """What the linear and the kernel machine share: ``prediction`` by the margin's sign, ``p1`` by Platt scaling of it."""

    def predict_proba(self, baskets: DataFrame, key: str = "InvoiceNo", items: str = "Items", one_row_a_key: bool = False) -> DataFrame:
        scored = self.margins(baskets, key, items, one_row_a_key)
        return (scored.withColumn("p1", _platt(F.col("_margin"), self.a, self.b))
                .withColumn("prediction", F.when(F.col("_margin") > 0, 1).otherwise(0)).drop("_margin"))


@dataclass
class SVMModel(_Margins):
    """L09 + L10: ``weights`` (item, w) of the unscaled 0/1 items."""
    weights: DataFrame
    intercept: float
    a: float
    b: float
    classes: list
    passes: int = 0
    known: tuple | None = None  # (items, weights): the same for tasks that score baskets where they lie

    def margins(self, baskets: DataFrame, key: str = "InvoiceNo", items: str = "Items", one_row_a_key: bool = False) -> DataFrame:
        """``_margin`` beside the columns of ``baskets``; unknown items weigh nothing.  ``one_row_a_key`` as with ``NBModel``."""
        if one_row_a_key and self.known is not None:
            return baskets.withColumn("_margin", F.get(_summed(key, items, self.known[0], self.known[1][:, None]), F.lit(0)) + F.lit(self.intercept))
        sums = basket_items(baskets, key, items).join(self.weights, "item").groupBy(key).agg(F.sum("w").alias("_margin"))
        return baskets.join(sums, key, "left").withColumn("_margin", F.coalesce("_margin", F.lit(0.0)) + F.lit(self.intercept))


@dataclass
class KernelSVMModel(_Margins):
    """A linear machine on approximate kernel features; scored in Arrow batches."""
    features: KernelMap
    weights: object             # numpy, one per feature
    intercept: float
    a: float
    b: float
    classes: list
    passes: int = 0

    def margins(self, baskets: DataFrame, key: str = "InvoiceNo", items: str = "Items", one_row_a_key: bool = False) -> DataFrame:
        features, weights, intercept = self.features, self.weights, self.intercept

        @F.arrow_udf("double")
        def margin(held: pa.Array) -> pa.Array:
            return pa.array(features.margins(held, weights) + intercept)

        return baskets.withColumn("_margin", margin(items))


KERNELS = ("linear", "rbf", "poly", "sigmoid")


def kernel_gamma(stats: ItemStats, gamma: float | str = "scale") -> float:
    """'scale': 1 / (items x variance of all entries of the scaled matrix); 'auto': 1 / items; or the number given."""
    if not isinstance(gamma, str):
        return float(gamma)
    v = max(len(stats.items), 1)
    if gamma == "auto":
        return 1.0 / v
    if gamma != "scale":
        raise ValueError(f"gamma is 'scale', 'auto' or a number, not {gamma!r}")
    p, sd = stats.held[:, 0] / max(stats.n[0], 1), stats.deviation()[:, 0]
    scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    variance = (p * scale ** 2).sum() / v - ((p * scale).sum() / v) ** 2
    return float(1.0 / (v * variance)) if variance > 0 else 1.0


def kernel_map(train: DataFrame, stats: ItemStats, kernel: str, gamma: float | str = "scale", degree: int = 3, coef0: float = 0.0,
               n_components: int = 512, seed: int = 42, key: str = "InvoiceNo", items: str = "Items") -> KernelMap:
    """The feature map of a kernel; poly and sigmoid take the ``n_components`` baskets first in hash order as landmarks."""
    sd = stats.deviation()[:, 0]
    scale = {item: float(1.0 / s) for item, s in zip(stats.items, sd, strict=True) if s > 0}
    gamma = kernel_gamma(stats, gamma)
    if kernel == "rbf":
        return FourierMap(scale, gamma, n_components, seed)
    # Equal baskets would give equal landmarks: one of each set of items.
    distinct = train.select(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("_items")).distinct()
    distinct = distinct.withColumn("_key", F.to_json("_items"))
    chosen = hash_sample(distinct, "_key", n_components, seed).collect()      # at most n_components baskets
    return LandmarkMap(scale, gamma, 0, kernel, degree, coef0, sorted(list(r["_items"]) for r in chosen))


def fit_svm(train: DataFrame, C: float = 1.0, key: str = "InvoiceNo", items: str = "Items",
            kernel: str = "linear", calibration: float = 0.2, seed: int = 42, gamma: float | str = "scale", degree: int = 3,
            coef0: float = 0.0, n_components: int = 512, max_iter: int = 100, one_row_a_key: bool = False) -> SVMModel | KernelSVMModel:
    """Items scaled to unit deviation, a soft-margin machine (hinge with a rounded corner), Platt scaling.

    The machine is fitted on all rows.  Platt scaling sees margins of rows that their
    machine was not fitted on: a second machine, trained in the same passes, leaves out
    ``calibration`` of the rows (by key hash) and scores them.  Where one of the two parts
    lacks a class (tiny data), the margins of the training rows serve.  ``kernel`` other
    than linear goes through ``n_components`` approximate kernel features (see machines).
    ``one_row_a_key`` as in ``label_baskets``: baskets are scored where they lie.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel is one of {', '.join(KERNELS)}, not {kernel!r}")
    parts = random_split(train, calibration, seed, key)
    rows = parts.select(key, items, "label", "is_test", F.when(F.col("is_test"), 1).otherwise(-1).alias("left_out")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = item_stats(rows, items, 2)
        if not stats.rows[:, 0].all():
            raise ValueError("an SVM needs rows of both classes")
        calibrates = bool(stats.rows[:, 1].all() and (stats.rows[:, 0] > stats.rows[:, 1]).all())
        stats = stats.first(2 if calibrates else 1)     # no margins are asked of a second machine else
        if kernel == "linear":
            fitted = train_machines(rows, items, Positions({i: k for k, i in enumerate(stats.items)}), stats, C, stats.deviation(), max_iter)
        else:
            features = kernel_map(train, stats, kernel, gamma, degree, coef0, n_components, seed, key, items)
            fitted = train_machines(rows, items, features, stats, C, None, max_iter)

        def model(j: int, a: float = 1.0, b: float = 0.0):
            if kernel == "linear":
                return SVMModel(weight_table(train.sparkSession, stats.items, fitted.weights[:, j]), float(fitted.bias[j]), a, b, [0, 1], fitted.passes,
                                (stats.items, fitted.weights[:, j]))
            return KernelSVMModel(features, fitted.weights[:, j], float(fitted.bias[j]), a, b, [0, 1], fitted.passes)

        seen = (model(1).margins(rows.filter("is_test"), key, items, one_row_a_key) if calibrates
                else model(0).margins(rows, key, items, one_row_a_key))
        seen = seen.select("_margin", "label").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return model(0, *calibrate(seen))
        finally:
            seen.unpersist()
    finally:
        rows.unpersist()


def weight_table(spark, names: list, weights) -> DataFrame:
    """(item, w) as a table; ``w`` an array where there are several machines."""
    kind = "double" if weights.ndim == 1 else "array<double>"
    return spark.createDataFrame(list(zip(names, weights.tolist(), strict=True)), f"item string, w {kind}")


def _has_both(df: DataFrame) -> bool:
    seen = df.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).first()
    return seen["n0"] > 0 and seen["n1"] > 0


# L14 ----------------------------------------------------------------------------------
FITTERS = {
    "nb": lambda train, vocab, one_row_a_key: fit_multinomial_nb(train, vocab, one_row_a_key=one_row_a_key),
    "gnb": lambda train, vocab, one_row_a_key: fit_gaussian_nb(train, vocab, one_row_a_key=one_row_a_key),
    "svm": lambda train, vocab, one_row_a_key: fit_svm(train, one_row_a_key=one_row_a_key),
}


def fit_all(train: DataFrame, vocab: DataFrame, names=("nb", "gnb", "svm"), one_row_a_key: bool = False) -> dict:
    """One fitted model per name.  An SVM is left out where the labels have one class."""
    both = _has_both(train)
    return {n: FITTERS[n](train, vocab, one_row_a_key) for n in names if both or n != "svm"}


def fit_all_with_random_split(data: DataFrame, vocab: DataFrame, names=("nb", "gnb", "svm"), one_row_a_key: bool = False):
    """Fit on the rows without ``is_test``, score the others: (models, metrics by model)."""
    from cartwise.operators.metrics import grouped_metrics

    models = fit_all(data.filter(~F.col("is_test")), vocab, names, one_row_a_key)
    test, scored = data.filter("is_test"), None
    for n, m in models.items():
        rows = m.predict_proba(test, one_row_a_key=one_row_a_key).select(F.lit(n).alias("model"), "label", "prediction")
        scored = rows if scored is None else scored.unionByName(rows)
    return models, grouped_metrics(scored, ["model"])


def cross_validate(data: DataFrame, vocab: DataFrame, n_splits: int = 10, names=("nb", "gnb"), one_row_a_key: bool = False) -> DataFrame:
    """Mean and deviation of each metric over the folds, for the models in ``names``.

    All folds are one pass per Naive Bayes model and one fit for the SVM; ``data`` (with
    ``label`` and ``fold``) is read more than once and is best persisted by the caller.
    """
    from cartwise.operators.metrics import cv_summary, grouped_metrics

    scored = None
    for n in names:
        rows = CROSS_VALIDATORS[n](data, vocab, n_splits, one_row_a_key).select(F.lit(n).alias("model"), "fold", "label", "prediction")
        scored = rows if scored is None else scored.unionByName(rows)
    return cv_summary(grouped_metrics(scored, ["model", "fold"]))


def fit_all_with_kfold(data: DataFrame, vocab: DataFrame, n_splits: int = 10, names=("nb", "gnb"), one_row_a_key: bool = False):
    """The models of the last fold (fitted on the other folds), which the job keeps, and ``cross_validate``."""
    return (fit_all(data.filter(F.col("fold") != n_splits - 1), vocab, names, one_row_a_key),
            cross_validate(data, vocab, n_splits, names, one_row_a_key))


# L13 ----------------------------------------------------------------------------------
def _fold_counts(data: DataFrame, vocab: DataFrame, n_splits: int, key: str, items: str, one_row_a_key: bool):
    """(long rows, per fold and item the class counts of the other folds, per fold their class sizes)."""
    long = _items_with(data, ["label", "fold"], key, items, one_row_a_key)
    fc = long.groupBy("fold", "item").agg(F.count_if(F.col("label") == 0).alias("f0"),
                                          F.count_if(F.col("label") == 1).alias("f1"))
    allc = fc.groupBy("item").agg(F.sum("f0").alias("a0"), F.sum("f1").alias("a1"))
    grid = (vocab.select("item").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
            .join(allc, "item", "left").join(fc, ["fold", "item"], "left").fillna(0, ["a0", "a1", "f0", "f1"])
            .select("fold", "item", (F.col("a0") - F.col("f0")).alias("c0"), (F.col("a1") - F.col("f1")).alias("c1")))
    own = data.groupBy("fold").agg(F.count_if(F.col("label") == 0).alias("n0"),
                                   F.count_if(F.col("label") == 1).alias("n1"))
    n0_all = data.agg(F.count_if(F.col("label") == 0)).scalar()   # scalar subqueries
    n1_all = data.agg(F.count_if(F.col("label") == 1)).scalar()
    rest = own.select("fold", (n0_all - F.col("n0")).alias("r0"), (n1_all - F.col("n1")).alias("r1"))
    return long, grid, rest


def _score_folds(data: DataFrame, long: DataFrame, params: DataFrame, base: DataFrame, key: str, items: str, n_splits: int, one_row_a_key: bool) -> DataFrame:
    """key, fold, label, p1, prediction; a training set of one class says that class.  ``one_row_a_key`` as with ``NBModel``."""
    if one_row_a_key and params.count() <= MAX_CELLS // 2:
        table = params.select("fold", "item", "w0", "w1").toArrow()
        at = table.column("item").combine_chunks().dictionary_encode()
        weights = np.zeros((len(at.dictionary), n_splits, 2))
        weights[at.indices.to_numpy(), table.column("fold").to_numpy()] = np.stack([table.column(c).to_numpy() for c in ("w0", "w1")], axis=1)
        scored = (data.select(key, "fold", "label", _summed(key, items, at.dictionary.to_pylist(), weights, "fold").alias("_s"))
                  .select(key, "fold", "label", F.get("_s", F.lit(0)).alias("s0"), F.get("_s", F.lit(1)).alias("s1"))
                  .join(F.broadcast(base), "fold"))       # a row for each fold
    else:
        sums = (long.join(params, ["fold", "item"]).groupBy(key).agg(F.sum("w0").alias("s0"), F.sum("w1").alias("s1")))
        scored = data.select(key, "fold", "label").join(sums, key, "left").join(base, "fold")
    j0 = F.col("b0") + F.coalesce(F.col("s0"), F.lit(0.0))
    j1 = F.col("b1") + F.coalesce(F.col("s1"), F.lit(0.0))
    no0, no1 = F.col("r0") == 0, F.col("r1") == 0
    p1 = F.when(no0, 1.0).when(no1, 0.0).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(j0 - j1)))
    prediction = F.when(no0, 1).when(no1, 0).when(j1 > j0, 1).otherwise(0)
    return scored.select(key, "fold", "label", p1.alias("p1"), prediction.alias("prediction"))


def cv_multinomial_nb(data: DataFrame, vocab: DataFrame, n_splits: int, alpha: float = 1.0,
                      key: str = "InvoiceNo", items: str = "Items", one_row_a_key: bool = False) -> DataFrame:
    """L13 in one pass: every row scored by the model trained on the other folds.

    Per-fold counts (fold × item × class) are subtracted from the totals, so the k
    training sets are never materialised; the parameter grid is k × vocabulary.
    ``data`` needs ``label`` and ``fold``.  Returns key, fold, label, p1, prediction.
    """
    v = vocab.count()
    long, grid, rest = _fold_counts(data, vocab, n_splits, key, items, one_row_a_key)
    tot = grid.groupBy("fold").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
    params = grid.join(tot, "fold").select(
        "fold", "item", F.log((F.col("c0") + alpha) / (F.col("t0") + alpha * v)).alias("w0"),
        F.log((F.col("c1") + alpha) / (F.col("t1") + alpha * v)).alias("w1"))
    n = F.col("r0") + F.col("r1")
    base = rest.select("fold", "r0", "r1", F.log(F.col("r0") / n).alias("b0"), F.log(F.col("r1") / n).alias("b1"))
    return _score_folds(data, long, params, base, key, items, n_splits, one_row_a_key)


def cv_gaussian_nb(data: DataFrame, vocab: DataFrame, n_splits: int, var_smoothing: float = 1e-9,
                   key: str = "InvoiceNo", items: str = "Items", one_row_a_key: bool = False) -> DataFrame:
    """L13 for the Gaussian model, from the same per-fold counts; result as ``cv_multinomial_nb``.

    Where no feature of a training set varies, its class priors decide.
    """
    long, grid, rest = _fold_counts(data, vocab, n_splits, key, items, one_row_a_key)
    counted = grid.join(rest, "fold")
    p_all = (F.col("c0") + F.col("c1")) / (F.col("r0") + F.col("r1"))
    eps = counted.groupBy("fold").agg((var_smoothing * F.max(p_all * (1 - p_all))).alias("eps"))
    counted = counted.join(eps.filter("eps > 0"), "fold")
    cols = []
    for c in (0, 1):
        mu = F.when(F.col(f"r{c}") > 0, F.col(f"c{c}") / F.col(f"r{c}")).otherwise(0.0)
        var = mu * (1 - mu) + F.col("eps")
        ll0 = -0.5 * F.log(2 * math.pi * var) - 0.5 * (mu * mu) / var
        ll1 = -0.5 * F.log(2 * math.pi * var) - 0.5 * ((1 - mu) * (1 - mu)) / var
        cols += [ll0.alias(f"z{c}"), (ll1 - ll0).alias(f"w{c}")]
    params = counted.select("fold", "item", *cols)
    absent = params.groupBy("fold").agg(F.sum("z0").alias("z0"), F.sum("z1").alias("z1"))
    n = F.col("r0") + F.col("r1")
    prior = lambda c: F.log(F.col(f"r{c}") / n) + F.coalesce(F.col(f"z{c}"), F.lit(0.0))
    base = rest.join(absent, "fold", "left").select("fold", "r0", "r1", prior(0).alias("b0"), prior(1).alias("b1"))
    return _score_folds(data, long, params.select("fold", "item", "w0", "w1"), base, key, items, n_splits, one_row_a_key)


def cv_svm(data: DataFrame, n_splits: int, C: float = 1.0, key: str = "InvoiceNo", items: str = "Items", max_iter: int = 100,
           one_row_a_key: bool = False) -> DataFrame:
    """L13 for the SVM: all folds' machines in the same passes; key, fold, label, prediction.

    Machine k is fitted on all rows of the other folds.  The margins of all machines are
    columns of one sum per basket, of which the basket's own fold takes its own.  The class
    is the sign of the margin, so no Platt scaling is fitted.  A training set of one class
    says that class.  ``one_row_a_key`` as in ``label_baskets``: a basket is scored where it lies.
    """
    stats = item_stats(data.withColumn("left_out", F.col("fold")), items, n_splits)
    if not stats.n.any():
        raise ValueError("no fold has rows to fit on and rows to score")
    fitted = train_machines(data.withColumn("left_out", F.col("fold")), items, Positions({i: k for k, i in enumerate(stats.items)}),
                            stats, C, stats.deviation(), max_iter)
    spark = data.sparkSession
    known = [(k, float(fitted.bias[k]), bool(stats.rows[:, k].all()), int(stats.rows[1, k] > 0))
             for k in range(n_splits) if stats.n[k]]
    folds = spark.createDataFrame(known, "fold int, _bias double, _both boolean, _only int")
    margin = F.coalesce("_margin", F.lit(0.0)) + F.col("_bias")
    prediction = F.when(~F.col("_both"), F.col("_only")).otherwise(F.when(margin > 0, 1).otherwise(0))
    if one_row_a_key:
        own = F.get(_summed(key, items, stats.items, fitted.weights[:, :, None], "fold"), F.lit(0))
        scored = data.select(key, "fold", "label", own.alias("_margin")).join(F.broadcast(folds), "fold")
    else:
        long = basket_items(data.filter(F.col("fold").between(0, n_splits - 1)), key, items).join(data.select(key, "fold"), key)
        sums = (long.join(weight_table(spark, stats.items, fitted.weights), "item").groupBy(key)
                .agg(F.sum(F.get("w", F.col("fold"))).alias("_margin")))
        scored = data.select(key, "fold", "label").join(folds, "fold").join(sums, key, "left")
    return scored.select(key, "fold", "label", prediction.alias("prediction"))


CROSS_VALIDATORS = {
    "nb": lambda data, vocab, n_splits, one_row_a_key: cv_multinomial_nb(data, vocab, n_splits, one_row_a_key=one_row_a_key),
    "gnb": lambda data, vocab, n_splits, one_row_a_key: cv_gaussian_nb(data, vocab, n_splits, one_row_a_key=one_row_a_key),
    "svm": lambda data, vocab, n_splits, one_row_a_key: cv_svm(data, n_splits, one_row_a_key=one_row_a_key),
}
