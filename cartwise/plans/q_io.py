"""Registered queries: file round trips (S01, S02, S04, S05, S07, S08, S10), text inputs of P02 / F02 / F08, and E04.

Files go to a new folder under the shared checkpoint folder and are read back by the loaders.
"""

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from cartwise.functions.dates import parse_invoice_date
from cartwise.operators import clean as C
from cartwise.operators import enrich as EN
from cartwise.operators import features as X
from cartwise.operators import models as MD
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import (BUNDLE_SUPPORT, MAX_BUNDLE_SIZE, ORACLES, baskets, lines, register, show_ts)
from cartwise.plans.q_models import split, vocab_of
from cartwise.plans.q_stock import INV_SQL, alias_map, inventory, norm_sql
from cartwise.schema import LINE_COLUMNS, ROW_ORDER, JobParams
from cartwise.session import checkpoint_dir
from cartwise.sources import files as FS
from cartwise.sources.tables import PLACED_BY, retail_lines, table


def scratch(spark):
    return f"{checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"


def raw_csv(spark, sf):
    """The invoice-line view as a raw file: Latin-1 CSV with text dates; returns its path."""
    path = scratch(spark)
    d = lines(spark, sf).withColumn("InvoiceDate", F.date_format("InvoiceDate", "M/d/yyyy H:mm"))
    d.select(*LINE_COLUMNS).write.options(**{**FS.PLAIN, "sep": ","}, encoding="ISO-8859-1").csv(path)
    return path


RAW_SQL = S.with_ctes(S.LINES, body="""SELECT InvoiceNo, StockCode, Description, Quantity, UnitPrice, CustomerID, Country,
  strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate FROM lines""")


def _parsed(df):
    return df.withColumn("InvoiceDate", parse_invoice_date("InvoiceDate")).select(
        *[show_ts() if c == "InvoiceDate" else c for c in LINE_COLUMNS])


@register("S01", RAW_SQL)
def s01(spark, sf):
    return _parsed(FS.load_raw_csv(spark, raw_csv(spark, sf)))


@register("S02", RAW_SQL)
def s02(spark, sf):
    out = scratch(spark)
    FS.csv_to_tsv(FS.load_raw_csv(spark, raw_csv(spark, sf)), out)
    return _parsed(spark.read.schema(FS.RAW_LINES).options(**FS.PLAIN).csv(out))


SNAPSHOT_SQL = S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, S.bundles_cte(BUNDLE_SUPPORT, MAX_BUNDLE_SIZE), body="""
SELECT 'basket' AS kind, InvoiceNo AS name, array_to_string(item_list, '|') AS items, Quantity AS n FROM baskets
UNION ALL SELECT 'bundle', bundle, bundle, support_count FROM bundles
UNION ALL SELECT 'line', InvoiceNo, StockCode, CAST(Quantity AS BIGINT) FROM feat""")


def _tables(saved):
    return (saved["baskets"].select(F.lit("basket").alias("kind"), F.col("InvoiceNo").alias("name"),
                                    F.array_join("Items", "|").alias("items"), F.col("Quantity").alias("n"))
            .unionByName(saved["bundles"].select(F.lit("bundle").alias("kind"), F.col("bundle").alias("name"),
                                                 F.col("bundle").alias("items"), F.col("support_count").alias("n")))
            .unionByName(saved["lines"].select(F.lit("line").alias("kind"), F.col("InvoiceNo").alias("name"),
                                               F.col("StockCode").alias("items"), F.col("Quantity").cast("long").alias("n"))))


def _params():
    return JobParams(min_support=BUNDLE_SUPPORT, max_bundle_size=MAX_BUNDLE_SIZE)


@register("S04", SNAPSHOT_SQL)
def s04(spark, sf):
    from cartwise.jobs import prepare
    return _tables(prepare(spark, scratch(spark), lambda: retail_lines(spark, sf, placed=True), _params(), placed_by=PLACED_BY))


@register("S05", SNAPSHOT_SQL)
def s05(spark, sf):
    """A snapshot with other bundles, reused, its bundles then made anew from the saved lines alone."""
    from cartwise.jobs import prepare, regenerate_bundles
    out = scratch(spark)
    prepare(spark, out, lambda: retail_lines(spark, sf, placed=True), JobParams(min_support=0.1), placed_by=PLACED_BY)
    regenerate_bundles(spark, out, _params())

    def not_again():
        raise AssertionError("the snapshot is there")
    return _tables(prepare(spark, out, not_again, _params()))


@register("S07", """SELECT lower(p_name) || '#' || p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END AS value
FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0""")
def s07(spark, sf):
    path, schema = scratch(spark), "key string, value string"
    p = table(spark, sf, "part").withColumn("key", F.concat(F.lower("p_name"), F.lit("#"), "p_partkey"))
    FS.save_kv_cache(p.filter("p_size % 3 = 0").select("key", F.lit("old").alias("value")), path)
    new = p.filter("p_size % 2 = 0").select("key", F.lit("new").alias("value"))
    FS.save_kv_cache(EN.merge_cache(FS.load_kv_cache(spark, path, schema), new), path)
    return FS.load_kv_cache(spark, path, schema)


@register("S08", f"""WITH al AS (SELECT DISTINCT {norm_sql('p_name')} AS alias FROM part),
cn AS (SELECT string_split(alias, ' ')[-1] AS w, min(alias) AS canonical FROM al GROUP BY 1)
SELECT al.alias, cn.canonical FROM al JOIN cn ON string_split(al.alias, ' ')[-1] = cn.w""")
def s08(spark, sf):
    """One JSON object per alias hash bucket, each a file; aliases in capitals, to be normalized by the loader."""
    path = scratch(spark)
    entry = F.struct(F.upper("alias").alias("key"), F.concat(F.lit(" "), "canonical").alias("value"))
    maps = alias_map(spark, sf).groupBy(F.pmod(F.xxhash64("alias"), F.lit(64)).alias("bucket")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    maps.repartition("bucket").write.partitionBy("bucket").text(path)
    return FS.load_alias_map(spark, path)


@register("S10", ORACLES["L06"])
def s10(spark, sf):
    data, path = split(spark, sf), scratch(spark)
    FS.save_nb_model(MD.fit_multinomial_nb(data.filter(~F.col("is_test")), vocab_of(spark, sf)), path)
    return FS.load_nb_model(spark, path).predict_proba(data.filter("is_test")).select(
        "InvoiceNo", "label", F.round("p1", 6).alias("p1"), "prediction")


# ---------------------------------------------------------------- text inputs ----
@register("P02T", S.with_ctes(S.LINES, body="""SELECT InvoiceNo, StockCode, ord2 AS line,
  CASE WHEN ord1 % 7 = 5 OR ord1 % 7 = 6 THEN NULL ELSE strftime(date_trunc('day', InvoiceDate), '%Y-%m-%d')
    || CASE ord1 % 7 WHEN 4 THEN ' 00:00:00' WHEN 0 THEN ' 08:26:00' WHEN 3 THEN ' 08:26:00' ELSE ' 08:26:07' END END AS parsed FROM lines"""))
def p02t(spark, sf):
    """Each of the five accepted text formats, a text that is no date, and null."""
    at = F.date_trunc("day", "InvoiceDate") + F.expr("INTERVAL '08:26:07' HOUR TO SECOND")
    kind = F.col(f"{ROW_ORDER}.ord1") % 7
    formats = ["M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
    text = F.coalesce(*[F.when(kind == i, F.date_format(at, f)) for i, f in enumerate(formats)], F.when(kind == 5, F.lit("13/45/2010 x")))
    return lines(spark, sf).select("InvoiceNo", "StockCode", F.col(f"{ROW_ORDER}.ord2").alias("line"),
                                   F.date_format(parse_invoice_date(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("F02T", S.with_ctes(S.LINES, body="""SELECT InvoiceNo, StockCode, ord2 AS line,
  CASE WHEN ord1 % 3 = 0 THEN NULL ELSE CustomerID END AS CustomerID FROM lines WHERE CustomerID IS NOT NULL"""))
def f02t(spark, sf):
    """Customer ids as text, a third of them no numbers: those rows stay with a null id."""
    ident = F.col("CustomerID").cast("long").cast("string")
    text = F.when(F.col(f"{ROW_ORDER}.ord1") % 3 == 0, F.concat(F.lit("id "), ident)).otherwise(ident)
    return C.remove_missing_customers(lines(spark, sf).withColumn("CustomerID", text)).select(
        "InvoiceNo", "StockCode", F.col(f"{ROW_ORDER}.ord2").alias("line"), "CustomerID")


@register("F08T", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, body="""SELECT InvoiceNo,
  CAST(InvoiceNo AS BIGINT) % 4 = 3 AS valid FROM baskets"""))
def f08t(spark, sf):
    """Baskets whose list is null, empty, or holds a null, and whole ones."""
    kind = F.col("InvoiceNo").cast("long") % 4
    items = F.when(kind == 1, F.array().cast("array<string>")).when(kind == 2, F.array_append("Items", F.lit(None).cast("string"))) \
        .when(kind == 3, F.col("Items"))
    return baskets(spark, sf).withColumn("Items", items).select("InvoiceNo", X.validate_transaction("Items").alias("valid"))


# ---------------------------------------------------------------- E04 ----
def alternative_scorer(pdf):
    """Stand-in: offers the first three candidates, the third best and the first least; fails for 'bolt'."""
    raws, status = [], []
    for text in pdf["text"]:
        asked = json.loads(text)
        status.append("error" if "bolt" in asked["missing_item"].split() else "ok")
        raws.append(json.dumps([{"item": c, "score": s, "reason": "offered"} for c, s in zip(asked["candidates"], (0.4, 0.8, 1.0))]))
    return pd.DataFrame({"key": pdf["key"], "raw": raws, "status": status})


@register("E04", S.with_ctes(INV_SQL, f"""
tk AS (SELECT DISTINCT p_brand, inv.item, inv.in_stock,
         list_distinct(list_filter(string_split({norm_sql('inv.item')}, ' '), lambda t: t <> '')) AS t
       FROM part JOIN inv ON inv.item = lower(trim(p_name))),
cand AS (SELECT p_brand, item, t, row_number() OVER (PARTITION BY p_brand ORDER BY item) AS n FROM tk WHERE in_stock),
offer AS (SELECT p_brand, max(item) AS item, CASE WHEN count(*) = 2 THEN 0.8 ELSE 0.4 END AS score FROM cand WHERE n <= 2 GROUP BY p_brand),
heur AS (SELECT m.p_brand, m.item, c.item AS alternative,
                len(list_intersect(m.t, c.t)) / (len(m.t) + len(c.t) - len(list_intersect(m.t, c.t))) AS score
         FROM tk m JOIN cand c USING (p_brand) WHERE NOT m.in_stock)""", body="""
SELECT tk.p_brand, tk.item, offer.item AS alternative, CAST(offer.score AS DOUBLE) AS score, 'offered' AS reason
FROM tk JOIN offer USING (p_brand) WHERE NOT in_stock AND NOT list_contains(string_split(tk.item, ' '), 'bolt')
UNION ALL SELECT p_brand, item, alternative, score, 'token-overlap' FROM
  (SELECT *, row_number() OVER (PARTITION BY p_brand, item ORDER BY score DESC, alternative) AS r FROM heur WHERE score > 0)
WHERE r = 1 AND list_contains(string_split(item, ' '), 'bolt')"""))
def e04(spark, sf):
    stock = table(spark, sf, "part").select("p_brand", F.lower(F.trim("p_name")).alias("item")).distinct().join(inventory(spark, sf), "item")
    out, _ = EN.select_alternatives(stock.filter(~F.col("in_stock")), stock.filter("in_stock"), alternative_scorer, "p_brand", max_alternatives=2)
    return out
