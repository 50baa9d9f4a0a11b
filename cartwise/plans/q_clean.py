"""Registered queries: cleaning chain, line features, rejects, baskets (F*, P01–P05, S03, A19)."""

from pyspark.sql import functions as F

from cartwise.operators import clean as C
from cartwise.operators.anomaly import flag_anomalies
from cartwise.operators.baskets import create_baskets
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import (OUTLIER_MULTIPLIER, TS_SQL, baskets, cleaned, lines, out_lines, processed, register,
                                    show_ts, sql_lines)
from cartwise.schema import JobParams


@register("F01", S.with_ctes(S.LINES, body=sql_lines(
    "lines", "coalesce(starts_with(InvoiceNo, 'C'), false) AS IsCancellation")))
def f01(spark, sf):
    return out_lines(C.flag_cancellations(lines(spark, sf)))


@register("F02", S.with_ctes(S.LINES, S.CLEAN, body=sql_lines("c2", "IsCancellation")))
def f02(spark, sf):
    return out_lines(lines(spark, sf).transform(C.handle_cancellations).transform(C.remove_missing_customers))


@register("F03", S.with_ctes(S.LINES, S.CLEAN, body=sql_lines("c2 WHERE Description IS NOT NULL", "IsCancellation")))
def f03(spark, sf):
    return out_lines(lines(spark, sf).transform(C.handle_cancellations).transform(C.remove_missing_customers)
                     .transform(C.drop_missing_descriptions))


@register("F04", S.with_ctes(S.LINES, S.CLEAN, body=sql_lines("c3", "IsCancellation")))
def f04(spark, sf):
    return out_lines(lines(spark, sf).transform(C.handle_cancellations).transform(C.remove_missing_customers)
                     .transform(C.drop_missing_descriptions).transform(C.keep_positive_amounts))


@register("F05", S.with_ctes(S.LINES, S.CLEAN, body=sql_lines(
    "(SELECT *, count(*) OVER (PARTITION BY InvoiceNo, StockCode) AS k FROM c3) WHERE k > 1", "IsCancellation")))
def f05(spark, sf):
    valid = (lines(spark, sf).transform(C.handle_cancellations).transform(C.remove_missing_customers)
             .transform(C.drop_missing_descriptions).transform(C.keep_positive_amounts))
    return out_lines(C.duplicate_lines(valid))


@register("F06", S.with_ctes(S.LINES, S.CLEAN, body=sql_lines("dd", "IsCancellation")))
def f06(spark, sf):
    return out_lines(cleaned(spark, sf))


_ANOMALY_CTE = f"""
q AS (SELECT quantile_cont(Quantity, 0.25) AS q1q, quantile_cont(Quantity, 0.75) AS q3q,
             quantile_cont(UnitPrice, 0.25) AS q1p, quantile_cont(UnitPrice, 0.75) AS q3p,
             quantile_cont(TransactionValue, 0.25) AS q1v, quantile_cont(TransactionValue, 0.75) AS q3v FROM feat),
r AS (SELECT feat.*, concat_ws(', ',
        CASE WHEN Quantity < q1q - {OUTLIER_MULTIPLIER} * (q3q - q1q) OR Quantity > q3q + {OUTLIER_MULTIPLIER} * (q3q - q1q) THEN 'IQR outlier in Quantity' END,
        CASE WHEN UnitPrice < q1p - {OUTLIER_MULTIPLIER} * (q3p - q1p) OR UnitPrice > q3p + {OUTLIER_MULTIPLIER} * (q3p - q1p) THEN 'IQR outlier in UnitPrice' END,
        CASE WHEN TransactionValue < q1v - {OUTLIER_MULTIPLIER} * (q3v - q1v) OR TransactionValue > q3v + {OUTLIER_MULTIPLIER} * (q3v - q1v)
             THEN 'IQR outlier in TransactionValue' END) AS reasons
      FROM feat, q),
flagged AS (SELECT *, reasons <> '' AS check_anomaly,
  CASE WHEN reasons = '' THEN NULL WHEN reasons LIKE '%Quantity%' THEN 'bot-like'
       WHEN reasons LIKE '%UnitPrice%' OR reasons LIKE '%TransactionValue%' THEN 'mispriced' ELSE 'invalid' END AS anomaly_type,
  CASE WHEN reasons = '' THEN NULL ELSE reasons END AS anomaly_reason FROM r)
"""
_F07_SQL = S.with_ctes(S.LINES, S.CLEAN, _ANOMALY_CTE, body=sql_lines(
    "flagged", "IsCancellation, InvoiceSeason, InvoiceDayOfWeek, TransactionValue, check_anomaly, anomaly_type, anomaly_reason"))


@register("F07", _F07_SQL)
def f07(spark, sf):
    return out_lines(processed(spark, sf, outliers=True))


@register("P01", S.with_ctes(S.LINES, S.CLEAN, body="SELECT InvoiceNo, StockCode, Description FROM proc"))
def p01(spark, sf):
    return C.normalize_descriptions(cleaned(spark, sf)).select("InvoiceNo", "StockCode", "Description")


@register("P02", S.with_ctes(S.LINES, S.CLEAN, body=f"SELECT InvoiceNo, StockCode, {TS_SQL} FROM feat"))
def p02(spark, sf):
    return processed(spark, sf, outliers=False).select("InvoiceNo", "StockCode", show_ts())


@register("P03", S.with_ctes(S.LINES, S.CLEAN, body="SELECT InvoiceNo, StockCode, InvoiceSeason FROM feat"))
def p03(spark, sf):
    return processed(spark, sf, outliers=False).select("InvoiceNo", "StockCode", "InvoiceSeason")


@register("P04", S.with_ctes(S.LINES, S.CLEAN, body="SELECT InvoiceNo, StockCode, InvoiceDayOfWeek FROM feat"))
def p04(spark, sf):
    return processed(spark, sf, outliers=False).select("InvoiceNo", "StockCode", "InvoiceDayOfWeek")


@register("P05", S.with_ctes(S.LINES, S.CLEAN, body="SELECT InvoiceNo, StockCode, TransactionValue FROM feat"))
def p05(spark, sf):
    return processed(spark, sf, outliers=False).select("InvoiceNo", "StockCode", "TransactionValue")


@register("S03", S.with_ctes(S.LINES, S.CLEAN, _ANOMALY_CTE, body="""
SELECT reason, count(*) AS n_rows FROM (
  SELECT 'Cancellations' AS reason FROM lines WHERE coalesce(starts_with(InvoiceNo, 'C'), false)
  UNION ALL SELECT 'no_CustomerID' FROM c1 WHERE CustomerID IS NULL
  UNION ALL SELECT 'Duplicate_transactions' FROM
     (SELECT count(*) OVER (PARTITION BY InvoiceNo, StockCode) AS k FROM c3) WHERE k > 1
  UNION ALL SELECT 'suspicious_transactions' FROM flagged WHERE check_anomaly)
GROUP BY reason"""))
def s03(spark, sf):
    return C.rejects(lines(spark, sf), JobParams(outlier_enabled=True, iqr_multiplier=OUTLIER_MULTIPLIER)).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


@register("A11", S.with_ctes(S.LINES, S.CLEAN, body=f"""
SELECT 0 AS pos, 'Quantity' AS field, quantile_cont(Quantity, 0.25) - {OUTLIER_MULTIPLIER} * (quantile_cont(Quantity, 0.75) - quantile_cont(Quantity, 0.25)) AS lower,
       quantile_cont(Quantity, 0.75) + {OUTLIER_MULTIPLIER} * (quantile_cont(Quantity, 0.75) - quantile_cont(Quantity, 0.25)) AS upper FROM feat
UNION ALL
SELECT 1, 'UnitPrice', quantile_cont(UnitPrice, 0.25) - {OUTLIER_MULTIPLIER} * (quantile_cont(UnitPrice, 0.75) - quantile_cont(UnitPrice, 0.25)),
       quantile_cont(UnitPrice, 0.75) + {OUTLIER_MULTIPLIER} * (quantile_cont(UnitPrice, 0.75) - quantile_cont(UnitPrice, 0.25)) FROM feat
UNION ALL
SELECT 2, 'TransactionValue', quantile_cont(TransactionValue, 0.25) - {OUTLIER_MULTIPLIER} * (quantile_cont(TransactionValue, 0.75) - quantile_cont(TransactionValue, 0.25)),
       quantile_cont(TransactionValue, 0.75) + {OUTLIER_MULTIPLIER} * (quantile_cont(TransactionValue, 0.75) - quantile_cont(TransactionValue, 0.25)) FROM feat"""))
def a11(spark, sf):
    from cartwise.operators.anomaly import iqr_bounds
    return iqr_bounds(processed(spark, sf, outliers=False), ["Quantity", "UnitPrice", "TransactionValue"],
                      OUTLIER_MULTIPLIER)


@register("A12", S.with_ctes(S.LINES, S.CLEAN, _ANOMALY_CTE, body="""
SELECT check_anomaly, anomaly_type, anomaly_reason, count(*) AS n_rows FROM flagged
GROUP BY check_anomaly, anomaly_type, anomaly_reason"""))
def a12(spark, sf):
    return (processed(spark, sf, outliers=True).groupBy("check_anomaly", "anomaly_type", "anomaly_reason")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("A19", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, body="""
SELECT InvoiceNo, array_to_string(item_list, '|') AS Items, CustomerID,
       strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
       round(TransactionValue, 6) AS TransactionValue, Quantity FROM baskets"""))
def a19(spark, sf):
    b = baskets(spark, sf)
    return b.select("InvoiceNo", F.array_join("Items", "|").alias("Items"), "CustomerID", show_ts(),
                    F.round("TransactionValue", 6).alias("TransactionValue"), "Quantity")
