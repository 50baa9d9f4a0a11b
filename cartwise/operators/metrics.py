"""Evaluation (L12, L13) and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class; zero_division = 0.

    One aggregate of tp / fp / fn / tn (optionally per group via ``groupBy`` on the input).
    """
    return _metrics(pred.agg(*_counts(label, prediction)))


def _counts(label, prediction):
    y, p = F.col(label), F.col(prediction)
    return [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn")]


def _metrics(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    acc = F.when(tp + fp + fn + tn > 0, (tp + tn) / (tp + fp + fn + tn)).otherwise(0.0)
    keep = [c_ for c_ in c.columns if c_ not in ("tp", "fp", "fn", "tn")]
    return c.select(*keep, F.round(acc, 9).alias("accuracy"), F.round(prec, 9).alias("precision"),
                    F.round(rec, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def grouped_metrics(pred: DataFrame, by, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _metrics(pred.groupBy(*by).agg(*_counts(label, prediction)))


def cv_summary(fold_metrics: DataFrame, by=("model",)) -> DataFrame:
    """Mean and population std per metric over folds, and the number of folds."""
    ms = ("accuracy", "precision", "recall", "f1")
    aggs = []
    for m in ms:
        aggs += [F.round(F.avg(m), 9).alias(m), F.round(F.stddev_pop(m), 9).alias(f"std_{m}")]
    return fold_metrics.groupBy(*by).agg(*aggs, F.count(F.lit(1)).cast("int").alias("n_splits"))


def compare(random_metrics: DataFrame, kfold_metrics: DataFrame, key: str = "model") -> DataFrame:
    """Random-split vs k-fold metrics side by side with |difference|."""
    ms = ("accuracy", "precision", "recall", "f1")
    a = random_metrics.select(key, *[F.col(m).alias(f"random_{m}") for m in ms])
    b = kfold_metrics.select(key, *[F.col(m).alias(f"kfold_{m}") for m in ms])
    j = a.join(b, key, "full")
    return j.select("*", *[F.round(F.abs(F.col(f"random_{m}") - F.col(f"kfold_{m}")), 9).alias(f"diff_{m}") for m in ms])


def side_by_side(scores: DataFrame, request: str = "request_id", model: str = "model", value: str = "confidence",
                 models=None, ensemble=()) -> DataFrame:
    """One row per request, one confidence column per model (pivot with a fixed model list).

    With ``ensemble``, a column of that name has the mean over those of its models that answered.
    """
    g = scores.groupBy(request)
    out = (g.pivot(model, list(models)) if models else g.pivot(model)).agg(F.first(value))
    if not ensemble:
        return out
    answered = F.array_compact(F.array(*[F.col(m) for m in ensemble]))
    mean = F.aggregate(answered, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(answered), F.lit(0))
    return out.withColumn("ensemble", F.round(mean, 6))
