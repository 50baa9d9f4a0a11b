"""Registered queries: cache-first enrichment with the deterministic rule scorer."""

import json

import pandas as pd
from pyspark.sql import functions as F

from cartwise.operators import enrich as EN
from cartwise.operators.clean import normalize_descriptions
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import cleaned, lines, processed, register
from cartwise.plans.q_clean import _ANOMALY_CTE


def _lines(spark, sf):
    return normalize_descriptions(cleaned(spark, sf))


@register("E01", S.with_ctes(S.LINES, S.CLEAN, body="""SELECT InvoiceNo, StockCode, Description,
  CASE WHEN list_contains(string_split(Description, ' '), 'bolt') THEN NULL ELSE string_split(Description, ' ')[-1] END AS category,
  CAST(NULL AS VARCHAR) AS material,
  CASE WHEN list_contains(string_split(Description, ' '), 'bolt') THEN NULL ELSE CAST(len(string_split(Description, ' ')) AS VARCHAR) END AS size,
  CASE WHEN list_contains(string_split(Description, ' '), 'bolt') THEN NULL ELSE string_split(Description, ' ')[1] END AS theme
FROM proc"""))
def e01(spark, sf):
    out, _ = EN.enrich_categories(_lines(spark, sf), EN.rule_category_scorer)
    return out.select("InvoiceNo", "StockCode", "Description", "category", "material", "size", "theme")


_BOLT = "list_contains(string_split(Description, ' '), 'bolt')"


def context_scorer(pdf):
    """Stand-in: each word is a context, surer the longer it is; for 'bolt' a confidence that is out of range."""
    def reply(text):
        words = text.split(" ")
        top = 2.0 if "bolt" in words else 1.0
        return json.dumps([{"context": w, "confidence": top * min(len(w), 10) / 10 if top == 1.0 else top} for w in words])
    return pd.DataFrame({"key": pdf["key"], "raw": [reply(t) for t in pdf["text"]]})


@register("E02", S.with_ctes(S.LINES, S.CLEAN, body=f"""SELECT InvoiceNo, StockCode, Description,
  CASE WHEN {_BOLT} THEN '' ELSE array_to_string(list_filter(string_split(Description, ' ')[1:3], lambda w: length(w) >= 6), ', ') END AS contexts
FROM proc"""))
def e02(spark, sf):
    out, _ = EN.extract_contexts(_lines(spark, sf), context_scorer)
    return out.select("InvoiceNo", "StockCode", "Description", "contexts")


def anomaly_scorer(pdf):
    """Stand-in: odd quantities are invalid, those divisible by four get a label that is not allowed."""
    def reply(text):
        q = json.loads(text)["Quantity"]
        if q % 4 == 0:
            return json.dumps({"anomaly_type": "weird", "anomaly_reason": "no such label"})
        return json.dumps({"anomaly_type": "invalid" if q % 2 else "none", "anomaly_reason": f"quantity {q}"})
    return pd.DataFrame({"key": pdf["key"], "raw": [reply(t) for t in pdf["text"]]})


@register("E03", S.with_ctes(S.LINES, S.CLEAN, _ANOMALY_CTE, body="""SELECT InvoiceNo, StockCode, check_anomaly,
  CASE WHEN NOT check_anomaly THEN NULL WHEN Quantity % 4 = 0 THEN anomaly_type WHEN Quantity % 2 = 1 THEN 'invalid' ELSE 'none' END AS anomaly_type,
  CASE WHEN NOT check_anomaly THEN NULL WHEN Quantity % 4 = 0 THEN anomaly_reason ELSE 'quantity ' || CAST(Quantity AS BIGINT) END AS anomaly_reason
FROM flagged"""))
def e03(spark, sf):
    out, _ = EN.label_anomalies(processed(spark, sf, outliers=True), anomaly_scorer)
    return out.select("InvoiceNo", "StockCode", "check_anomaly", "anomaly_type", "anomaly_reason")


def upper_scorer(pdf):
    """Stand-in: upper-cased text; texts with 'bolt' fail."""
    bad = [("bolt" in t.split(" ")) for t in pdf["text"]]
    return pd.DataFrame({"key": pdf["key"], "raw": [json.dumps({"normalized": t.upper()}) for t in pdf["text"]],
                         "status": ["error" if b else "ok" for b in bad]})


@register("E05", S.with_ctes(S.LINES, S.CLEAN, body=f"""SELECT InvoiceNo, StockCode,
  CASE WHEN {_BOLT} THEN Description ELSE upper(Description) END AS Description FROM proc"""))
def e05(spark, sf):
    out, _ = EN.normalize_with_scorer(_lines(spark, sf), upper_scorer)
    return out.select("InvoiceNo", "StockCode", "Description")


def quota_scorer(pdf):
    """Stand-in whose quota is spent at once."""
    return pd.DataFrame({"key": pdf["key"], "raw": None, "status": "quota"})


@register("E06", S.with_ctes(S.LINES, S.CLEAN, body="""SELECT DISTINCT Description AS key, 'quota' AS status,
  CAST(NULL AS VARCHAR) AS raw FROM proc"""))
def e06(spark, sf):
    keys = _lines(spark, sf).select(F.col("Description").alias("key"), F.col("Description").alias("text"))
    _, _, quarantine = EN.cached_lookup(keys, None, quota_scorer, EN.CATEGORY_SCHEMA)
    return quarantine.select("key", "status", "raw")


@register("E08", S.with_ctes(S.LINES, S.CLEAN, body=f"""SELECT DISTINCT Description AS key, NOT {_BOLT} AS valid,
  CASE WHEN NOT {_BOLT} THEN string_split(Description, ' ')[-1] END AS category,
  CASE WHEN NOT {_BOLT} THEN string_split(Description, ' ')[1] END AS theme,
  CASE WHEN NOT {_BOLT} THEN CAST(len(string_split(Description, ' ')) AS VARCHAR) END AS size,
  CASE WHEN {_BOLT} THEN 'not json' END AS raw FROM proc"""))
def e08(spark, sf):
    keys = _lines(spark, sf).select(F.col("Description").alias("key"), F.col("Description").alias("text")).distinct()
    replies = EN.keep_replies(EN.run_scorer(keys, EN.rule_category_scorer))
    valid, quarantine = EN.ingest(replies, EN.CATEGORY_SCHEMA)
    good = valid.select("key", F.lit(True).alias("valid"), *[F.col("value")[f].alias(f) for f in ("category", "theme", "size")],
                        F.lit(None).cast("string").alias("raw"))
    return good.unionByName(quarantine.select("key", F.lit(False).alias("valid"), "raw"), allowMissingColumns=True)
