"""Registered queries: text functions, inventory and stock repair."""

from pyspark.sql import functions as F

from cartwise.operators.anomaly import with_record_key
from cartwise.functions.text import candidate_hash, normalize_basic
from cartwise.operators import stock as ST
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import baskets, cleaned, lines, processed, register
from cartwise.plans.q_recommend import APPL, BREQ, MODEL_CTES, basket_recommendations, req_scores_sql
from cartwise.sources.tables import table

_W = "[\\pL\\pN_]"
_NW = "[^\\pL\\pN_]"
_UNITS = [("inches|inch", "in\\.", "in"), ("centimeters|centimetres", "cm\\.", "cm"),
          ("grams|gram", "g\\.", "g"), ("kilograms|kilogram", "kg\\.", "kg")]


def norm_sql(x):
    """P06 in DuckDB.  RE2's \\b is ASCII-only while Python's is Unicode-aware, so word
    boundaries are spelled out with Unicode classes (each rule applied twice, because
    a match consumes the separator the next match needs)."""
    e = f"regexp_replace(lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')"
    for words, dotted, unit in _UNITS:
        for _ in range(2):
            e = f"regexp_replace({e}, '(^|{_NW})({words})({_NW}|$)', '\\1{unit}\\3', 'g')"
            e = f"regexp_replace({e}, '(^|{_NW}){dotted}({_W})', '\\1{unit}\\2', 'g')"
    return e


@register("P06", f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def p06(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize_basic("text").alias("normalized"))


@register("P07", S.with_ctes(S.LINES, S.CLEAN, body="""SELECT InvoiceNo, StockCode,
  concat_ws('|', InvoiceNo, StockCode, coalesce(CAST(CAST(CustomerID AS BIGINT) AS VARCHAR), ''), strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S'),
            CAST(Quantity AS VARCHAR), CAST(CAST(UnitPrice AS DECIMAL(18, 4)) AS VARCHAR),
            CAST(CAST(TransactionValue AS DECIMAL(18, 4)) AS VARCHAR)) AS record_key FROM feat"""))
def p07(spark, sf):
    d = processed(spark, sf, outliers=False).select(
        "InvoiceNo", "StockCode", F.col("CustomerID").cast("bigint").alias("CustomerID"),
        F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"), "Quantity",
        *[F.col(c).cast("decimal(18,4)").alias(c) for c in ("UnitPrice", "TransactionValue")])
    return with_record_key(d).select("InvoiceNo", "StockCode", "record_key")


@register("P08", S.with_ctes(S.LINES, S.CLEAN, S.BASKETS, body="""SELECT InvoiceNo,
  sha256(array_to_string(list_sort(item_list), '|')) AS candidate_hash FROM baskets"""))
def p08(spark, sf):
    return baskets(spark, sf).select("InvoiceNo", candidate_hash("Items").alias("candidate_hash"))


def alias_map(spark, sf):
    """Alias map derived from part: every product name maps to the smallest name that
    shares its last word (both sides normalized as in the loader)."""
    p = table(spark, sf, "part").select(normalize_basic("p_name").alias("alias"))
    last = F.element_at(F.split("alias", " "), -1)
    canon = p.groupBy(last.alias("_w")).agg(F.min("alias").alias("canonical"))
    return p.distinct().join(canon, last == F.col("_w")).select("alias", "canonical")


@register("P11", S.with_ctes(S.LINES, S.CLEAN, f"""
al AS (SELECT DISTINCT {norm_sql('p_name')} AS alias FROM part),
cn AS (SELECT string_split(alias, ' ')[-1] AS w, min(alias) AS canonical FROM al GROUP BY 1),
amap AS (SELECT al.alias, cn.canonical FROM al JOIN cn ON string_split(al.alias, ' ')[-1] = cn.w)""", body="""
SELECT p.InvoiceNo, p.StockCode, coalesce(a.canonical, p.Description) AS Description FROM proc p
LEFT JOIN amap a ON a.alias = p.Description"""))
def p11(spark, sf):
    from cartwise.operators.clean import apply_aliases, normalize_descriptions
    d = normalize_descriptions(cleaned(spark, sf))
    return apply_aliases(d, alias_map(spark, sf)).select("InvoiceNo", "StockCode", "Description")


def inventory(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("Product"),
                                        F.when(F.col("p_size") % 5 != 0, "Yes").otherwise("no").alias("In_Stock"),
                                        "p_partkey")
    return ST.inventory_from_frame(p, order="p_partkey")


INV_SQL = """inv AS (SELECT lower(trim(p_name)) AS item, last(p_size % 5 <> 0 ORDER BY p_partkey) AS in_stock FROM part GROUP BY 1)"""


@register("S06", S.with_ctes(INV_SQL, body="SELECT item, in_stock FROM inv"))
def s06(spark, sf):
    return inventory(spark, sf)


# Stock given as text of many kinds: numbers other than 1 are not in stock, blanks and case do not count.
_STOCK_TEXT = "CASE p_size % 7 WHEN 0 THEN '2' WHEN 1 THEN ' YES ' WHEN 2 THEN '1' WHEN 3 THEN '1.0' WHEN 4 THEN 'available' WHEN 5 THEN NULL ELSE '-1' END"


@register("S06T", f"""SELECT item, last(coalesce(shown IN ('true', 'yes', 'y', 'in_stock', 'available') OR try_cast(shown AS DOUBLE) = 1, false) ORDER BY p_partkey) AS in_stock
FROM (SELECT lower(trim(p_name)) AS item, lower(trim({_STOCK_TEXT})) AS shown, p_partkey FROM part) GROUP BY item""")
def s06t(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("ITEM"), F.expr(_STOCK_TEXT).alias("Stock"), "p_partkey")
    return ST.inventory_from_frame(p, order="p_partkey")


@register("R04", S.with_ctes(INV_SQL, f"""
tk AS (SELECT item, in_stock, list_distinct(list_filter(string_split({norm_sql('item')}, ' '), lambda t: t <> '')) AS t FROM inv),
pr AS (SELECT m.item, c.item AS alternative, len(list_intersect(m.t, c.t)) / (len(m.t) + len(c.t) - len(list_intersect(m.t, c.t))) AS score
       FROM tk m, tk c WHERE NOT m.in_stock AND c.in_stock AND len(m.t) > 0 AND len(c.t) > 0)""", body="""
SELECT item, alternative, score, 'token-overlap' AS reason FROM
  (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, alternative) AS r FROM pr WHERE score > 0) WHERE r = 1"""))
def r04(spark, sf):
    inv = inventory(spark, sf)
    return ST.best_alternatives(inv.filter(~F.col("in_stock")), inv.filter("in_stock"))


@register("R03", S.with_ctes(*MODEL_CTES, BREQ, req_scores_sql("breq"),
                             "ens AS (SELECT request_id, avg(confidence) AS confidence FROM rs GROUP BY request_id)",
                             APPL.replace("REQ", "breq").replace("TOPN", "5"), INV_SQL, f"""
rec AS (SELECT a.request_id, a.rank, a.bundle, string_split(a.bundle, '|') AS parts FROM appl a
        JOIN ens e ON a.request_id = e.request_id WHERE e.confidence >= 0.5),
pos AS (SELECT request_id, rank, bundle, unnest(parts) AS item, generate_subscripts(parts, 1) AS pos FROM rec),
key AS (SELECT {norm_sql('item')} AS k, bool_and(in_stock) AS in_stock FROM inv GROUP BY 1),
st AS (SELECT pos.*, coalesce(NOT key.in_stock, false) AS oos FROM pos LEFT JOIN key ON {norm_sql('pos.item')} = key.k),
tks AS (SELECT DISTINCT request_id, item, oos, list_distinct(list_filter(string_split({norm_sql('item')}, ' '), lambda t: t <> '')) AS t FROM st),
alt AS (SELECT m.request_id, m.item, c.item AS alternative,
               len(list_intersect(m.t, c.t)) / (len(m.t) + len(c.t) - len(list_intersect(m.t, c.t))) AS score
        FROM tks m JOIN tks c ON m.request_id = c.request_id WHERE m.oos AND NOT c.oos),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, item ORDER BY score DESC, alternative) AS r
                        FROM alt WHERE score > 0) WHERE r = 1 AND score >= 0.3)""", body="""
SELECT st.request_id, st.rank, st.bundle, string_agg(coalesce(best.alternative, st.item), '|' ORDER BY st.pos) AS resolved_bundle,
       CAST(count(best.alternative) AS INTEGER) AS n_substitutions
FROM st LEFT JOIN best ON st.request_id = best.request_id AND st.item = best.item GROUP BY st.request_id, st.rank, st.bundle"""))
def r03(spark, sf):
    recs = basket_recommendations(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))
    out = ST.repair_bundles(recs, inventory(spark, sf), 0.3)
    return out.select("request_id", "rank", "bundle", "resolved_bundle", F.size("substitutions").alias("n_substitutions"))
