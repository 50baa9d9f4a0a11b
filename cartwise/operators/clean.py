"""Cleaning chain F01–F07 and line features P01–P05.

Each step is ``DataFrame -> DataFrame``; ``reject_*`` functions return the rows a
step removes, tagged with a ``reason`` so that all side outputs form one
DataFrame (S03) written in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.functions.dates import day_of_week, parse_invoice_date, season
from cartwise.functions.text import lower_strip
from cartwise.schema import ROW_ORDER

DUP_KEYS = ("InvoiceNo", "StockCode")


# F01 ----------------------------------------------------------------------------------
def flag_cancellations(df: DataFrame) -> DataFrame:
    """``IsCancellation`` = InvoiceNo starts with 'C' (null invoice → false)."""
    return df.withColumn("IsCancellation", F.coalesce(F.col("InvoiceNo").startswith("C"), F.lit(False)))


def handle_cancellations(df: DataFrame) -> DataFrame:
    return flag_cancellations(df).filter(~F.col("IsCancellation"))


def reject_cancellations(df: DataFrame) -> DataFrame:
    return flag_cancellations(df).filter(F.col("IsCancellation"))


# F02 ----------------------------------------------------------------------------------
def remove_missing_customers(df: DataFrame) -> DataFrame:
    """Drop null CustomerID, then coerce to a number (unparsable → NULL, kept)."""
    return df.filter(F.col("CustomerID").isNotNull()).withColumn(
        "CustomerID", F.col("CustomerID").try_cast(T.DoubleType()))


def reject_missing_customers(df: DataFrame) -> DataFrame:
    return df.filter(F.col("CustomerID").isNull())


# F03 / F04 ----------------------------------------------------------------------------
def drop_missing_descriptions(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Description").isNotNull())


def keep_positive_amounts(df: DataFrame) -> DataFrame:
    return df.filter((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))


# F05 / F06 ----------------------------------------------------------------------------
def duplicate_lines(df: DataFrame, keys=DUP_KEYS) -> DataFrame:
    """every member of a group with more than one line on ``keys``.

    Group sizes come from a partial (map-side) count, so a hot key costs one
    row per map task; the semi join back is eligible for AQE skew splitting.
    """
    dup_keys = df.groupBy(*keys).count().filter(F.col("count") > 1).drop("count")
    cond = [df[k].eqNullSafe(dup_keys[k]) for k in keys]  # pandas groups NaN keys too
    return df.join(dup_keys, on=cond, how="left_semi")


def dedup_first(df: DataFrame, keys=DUP_KEYS, order: str = ROW_ORDER, placed_by: str | None = None) -> DataFrame:
    """keep the first line (by ``order``) of every key group.

    ``placed_by`` names a column that ``keys`` determine.  Where the input is partitioned by
    it (a join on it), the groups are formed in place, and so are later groups by it.

    ``min_by`` is a declarative aggregate with a partial phase: a key holding a
    third of the data is reduced map-side before the shuffle, unlike a
    ``row_number`` window that would sort the whole group in one task.
    """
    cols = df.columns
    placed = [placed_by] if placed_by else []
    rest = [c for c in cols if c not in (*keys, *placed)]
    agg = df.groupBy(*placed, *keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return agg.select(*placed, *keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*cols)


# P01 ----------------------------------------------------------------------------------
def normalize_descriptions(df: DataFrame) -> DataFrame:
    return df.withColumn("Description", lower_strip("Description"))


# P02–P05 ------------------------------------------------------------------------------
def engineer_features(df: DataFrame) -> DataFrame:
    ts = parse_invoice_date("InvoiceDate", df.schema["InvoiceDate"].dataType)
    return (df.withColumn("InvoiceDate", ts)
              .withColumn("InvoiceSeason", season(F.col("InvoiceDate")))
              .withColumn("InvoiceDayOfWeek", day_of_week(F.col("InvoiceDate")))
              .withColumn("TransactionValue", F.col("Quantity") * F.col("UnitPrice")))


# F07 ----------------------------------------------------------------------------------
def clean_lines(raw: DataFrame, placed_by: str | None = None) -> DataFrame:
    """F01→F06 (no text normalization yet); ``placed_by`` as in ``dedup_first``."""
    return (raw.transform(handle_cancellations)
               .transform(remove_missing_customers)
               .transform(drop_missing_descriptions)
               .transform(keep_positive_amounts)
               .transform(dedup_first, placed_by=placed_by))


def preprocess(raw: DataFrame, params=None, enrich=None, anomalies=True, placed_by: str | None = None) -> DataFrame:
    """cancellations → customers → descriptions → amounts → dedup →
    P01 → (E01/E02 when a scorer is given) → P02–P05 → A11/A12."""
    from cartwise.operators.anomaly import flag_anomalies
    from cartwise.schema import JobParams

    params = params or JobParams()
    df = clean_lines(raw, placed_by).transform(normalize_descriptions)
    if enrich is not None:
        df = enrich(df)
    df = df.transform(engineer_features)
    if anomalies:
        df = flag_anomalies(df, params)
    return df


def rejects(raw: DataFrame, params=None) -> DataFrame:
    """All side outputs of the chain as one frame tagged by ``reason``.

    Reasons and their order are the reference's file names (fixed values):
    Cancellations, no_CustomerID, Duplicate_transactions, suspicious_transactions.  The last
    holds the lines that ``params`` flags as outliers, with their features and labels
    (null for the other reasons); none without ``params.outlier_enabled``.
    """
    flagged = flag_cancellations(raw)
    reason = (F.when(F.col("IsCancellation"), "Cancellations")
               .when(F.col("CustomerID").isNull(), "no_CustomerID"))
    early = flagged.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    valid = raw.transform(handle_cancellations).transform(remove_missing_customers)
    valid = valid.transform(drop_missing_descriptions).transform(keep_positive_amounts)
    out = early.unionByName(duplicate_lines(valid).withColumn("reason", F.lit("Duplicate_transactions")))
    if params is not None and params.outlier_enabled:
        suspicious = preprocess(raw, params).filter("check_anomaly").withColumn("reason", F.lit("suspicious_transactions"))
        out = out.unionByName(suspicious, allowMissingColumns=True)
    return out


# P11 ----------------------------------------------------------------------------------
def apply_aliases(df: DataFrame, aliases: DataFrame, col: str = "Description") -> DataFrame:
    """Canonicalize ``col`` through an alias map (alias → canonical); unknown values stay.

    The map is keyed by alias (one row each); Catalyst broadcasts it when its measured
    size is under the broadcast threshold and shuffles otherwise.
    """
    a = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canon"))
    return (df.join(a, F.col(col) == F.col("_alias"), "left")
              .withColumn(col, F.coalesce(F.col("_canon"), F.col(col))).drop("_alias", "_canon"))
