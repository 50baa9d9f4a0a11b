"""IQR outlier flags (A11), heuristic anomaly labels (A12) and record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.quantiles import iqr_fences
from cartwise.functions.text import record_key

# The fields a record key is made of, in order.
RECORD_KEY_FIELDS = ["InvoiceNo", "StockCode", "CustomerID", "InvoiceDate", "Quantity",
                     "UnitPrice", "TransactionValue"]


def iqr_bounds(df: DataFrame, fields, multiplier: float = 1.5, approximate: bool = False) -> DataFrame:
    """A11 bounds, one row per field.

    Quantiles are exact and linearly interpolated (pandas ``quantile``); nulls are ignored
    and an all-null field gets (-inf, +inf).  ``approximate`` takes them from sketches.
    """
    fences = iqr_fences(df, fields, multiplier, approximate)
    rows = [(i, f, float("-inf") if fences[f][0] is None else fences[f][0],
             float("inf") if fences[f][1] is None else fences[f][1]) for i, f in enumerate(fields)]
    return df.sparkSession.createDataFrame(rows, "pos int, field string, lower double, upper double")


def flag_anomalies(df: DataFrame, params=None, fields=None, multiplier=None, approximate: bool = False) -> DataFrame:
    """A11 + A12: ``check_anomaly``, ``anomaly_type``, ``anomaly_reason``.

    The quartiles are computed at once (exactly, or from sketches) and the bounds enter the plan as
    literals, so the line table is never joined with anything.
    """
    from cartwise.schema import JobParams

    params = params or JobParams(outlier_enabled=True)
    fields = [f for f in (fields or params.outlier_fields) if f in df.columns]
    multiplier = params.iqr_multiplier if multiplier is None else multiplier
    if not params.outlier_enabled or not fields:
        return (df.withColumn("check_anomaly", F.lit(False))
                  .withColumn("anomaly_type", F.lit(None).cast("string"))
                  .withColumn("anomaly_reason", F.lit(None).cast("string")))
    parts = []
    for f, (low, high) in iqr_fences(df, fields, multiplier, approximate).items():
        v = F.col(f).cast("double")
        parts.append(F.when((v < F.lit(low)) | (v > F.lit(high)), F.lit(f"IQR outlier in {f}")))
    reasons = F.concat_ws(", ", *parts)  # skips NULLs: the flagged fields in field order
    flagged = df.withColumn("_reasons", reasons)
    return (flagged
            .withColumn("check_anomaly", F.col("_reasons") != "")
            .withColumn("anomaly_type", F.when(F.col("check_anomaly"), heuristic_label(F.col("_reasons"))))
            .withColumn("anomaly_reason", F.when(F.col("check_anomaly"), F.col("_reasons")))
            .drop("_reasons"))


def heuristic_label(reasons: Column) -> Column:
    """Quantity → bot-like; UnitPrice / TransactionValue → mispriced; else invalid."""
    return (F.when(reasons.contains("Quantity"), "bot-like")
             .when(reasons.contains("UnitPrice") | reasons.contains("TransactionValue"), "mispriced")
             .otherwise("invalid"))


def with_record_key(df: DataFrame, name: str = "record_key") -> DataFrame:
    """P07 over the fields that exist (missing fields render as '')."""
    cols = [F.col(c) if c in df.columns else F.lit("") for c in RECORD_KEY_FIELDS]
    return df.withColumn(name, record_key(*cols))
