"""Registered queries: exploration and column profiling."""

from pyspark.sql import functions as F

from cartwise.functions.quantiles import exact_quantiles
from cartwise.operators import profile as P
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import OUTLIER_MULTIPLIER, lines, processed, register
from cartwise.sources.tables import table

RAW8 = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]


def raw8(spark, sf):
    return lines(spark, sf).select(*RAW8)


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@register("A01", S.with_ctes(S.LINES, body=_union(
    [f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
     f"count(*) FILTER (WHERE {c} IS NULL) = count(*) AND count(*) > 0 AS fully_null FROM lines" for c in RAW8])))
def a01(spark, sf):
    return P.null_counts(raw8(spark, sf))


@register("A02", S.with_ctes(S.LINES, body="""SELECT strftime(min(InvoiceDate), '%Y-%m-%d %H:%M:%S') AS min_date,
  strftime(max(InvoiceDate), '%Y-%m-%d %H:%M:%S') AS max_date FROM lines"""))
def a02(spark, sf):
    d = lines(spark, sf)
    return d.agg(F.date_format(F.min("InvoiceDate"), "yyyy-MM-dd HH:mm:ss").alias("min_date"),
                  F.date_format(F.max("InvoiceDate"), "yyyy-MM-dd HH:mm:ss").alias("max_date"))


@register("A03", S.with_ctes(S.LINES, body="""SELECT count(DISTINCT CustomerID) AS unique_customers,
  count(DISTINCT Description) AS unique_descriptions FROM lines"""))
def a03(spark, sf):
    return lines(spark, sf).agg(F.countDistinct("CustomerID").alias("unique_customers"),
                                F.countDistinct("Description").alias("unique_descriptions"))


@register("A04", S.with_ctes(S.LINES, S.CLEAN, body=_union(
    [f"SELECT '{c}' AS field, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
     f"round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median FROM feat"
     for c in ("TransactionValue", "Quantity")])))
def a04(spark, sf):
    d, cols = processed(spark, sf, outliers=False), ("TransactionValue", "Quantity")
    medians = exact_quantiles(d, cols, (0.5,))
    agg = d.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in cols
                  for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return agg.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("field"), F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max"),
        F.round(f"{c}_mean", 6).alias("mean"), F.round(F.lit(medians[c][0]).cast("double"), 6).alias("median")) for c in cols])))


@register("A06", S.with_ctes(S.LINES, body="""SELECT count(*) AS total_rows, 8 AS total_columns,
  (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM lines GROUP BY ALL_COLS)) AS duplicate_rows,
  0 AS fully_null_columns FROM lines""".replace("ALL_COLS", ", ".join(RAW8))))
def a06(spark, sf):
    return P.overview(raw8(spark, sf))


@register("A07", S.with_ctes(S.LINES, body=_union(
    [f"SELECT '{c}' AS column, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, "
     f"round((count(*) - count({c})) * 10000.0 / count(*)) / 100 AS null_percentage, count(DISTINCT {c}) AS unique_count FROM lines"
     for c in RAW8])))
def a07(spark, sf):
    return P.column_stats(raw8(spark, sf))


NUM_COLS = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("A08", _union(
    [f"""SELECT '{c}' AS column, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1,
  round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(skewness({c}), 6) AS skewness,
  round(kurtosis({c}), 6) AS kurtosis FROM customer""" for c in NUM_COLS]))
def a08(spark, sf):
    return P.numeric_profile(table(spark, sf, "customer"), NUM_COLS)


def _bounds_sql(t, c):
    return (f"(SELECT quantile_cont({c}, 0.25) - {OUTLIER_MULTIPLIER} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
            f"quantile_cont({c}, 0.75) + {OUTLIER_MULTIPLIER} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})")


@register("A09", _union([f"""SELECT '{c}' AS column, round(b.lo, 6) AS lower_bound, round(b.hi, 6) AS upper_bound,
  count(*) FILTER (WHERE {c} < b.lo OR {c} > b.hi) AS outlier_count,
  round(count(*) FILTER (WHERE {c} < b.lo OR {c} > b.hi) * 10000.0 / count({c})) / 100 AS outlier_percentage
FROM orders, {_bounds_sql('orders', c)} b GROUP BY b.lo, b.hi""" for c in ("o_totalprice",)]))
def a09(spark, sf):
    return P.numeric_outliers(table(spark, sf, "orders"), ["o_totalprice"], OUTLIER_MULTIPLIER)


@register("A09S", f"""SELECT 'o_totalprice' AS column, o_orderkey AS position, o_totalprice AS value
FROM orders, {_bounds_sql('orders', 'o_totalprice')} b WHERE o_totalprice < b.lo OR o_totalprice > b.hi
ORDER BY o_orderkey LIMIT 10""")
def a09s(spark, sf):
    return P.outlier_samples(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", multiplier=OUTLIER_MULTIPLIER)


@register("A10", """SELECT 'c_acctbal' AS column, count(*) FILTER (WHERE c_acctbal < 0) AS negative_values,
  count(*) FILTER (WHERE c_acctbal = 0) AS zero_values,
  count(*) FILTER (WHERE s.sd > 0 AND abs((c_acctbal - s.m) / s.sd) > 5) AS extreme_values
FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer) s""")
def a10(spark, sf):
    return P.numeric_errors(table(spark, sf, "customer"), ["c_acctbal"])


@register("A10S", """SELECT 'c_acctbal' AS column, c_custkey AS position, c_acctbal AS value FROM customer
WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 5""")
def a10s(spark, sf):
    return P.negative_samples(table(spark, sf, "customer"), "c_acctbal", "c_custkey")


@register("A10X", """SELECT 'o_totalprice' AS column, o_orderkey AS position, CAST(o_totalprice AS DOUBLE) AS value FROM orders,
  (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders) s
WHERE s.sd > 0 AND abs((o_totalprice - s.m) / s.sd) > 1.5 ORDER BY o_orderkey LIMIT 5""")
def a10x(spark, sf):
    return P.extreme_samples(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", z=1.5)


@register("A15L", """SELECT 'text' AS column, doc_id AS position, CAST(length(text) AS INTEGER) AS length, text AS value
FROM documents WHERE length(text) > 200 ORDER BY doc_id LIMIT 3""")
def a15l(spark, sf):
    return P.long_samples(table(spark, sf, "documents"), "text", "doc_id")


@register("A01D", S.with_ctes(S.LINES, body=f"""SELECT count(*) AS total_rows,
  (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM lines GROUP BY {', '.join(RAW8)})) AS duplicate_rows,
  'InvoiceNo:string, StockCode:string, Description:string, Quantity:int, InvoiceDate:timestamp_ntz, UnitPrice:double, CustomerID:double, Country:string' AS types
FROM lines"""))
def a01d(spark, sf):
    d = raw8(spark, sf)
    return P.overview(d).select("total_rows", "duplicate_rows", F.lit(", ".join(f"{c}:{t}" for c, t in d.dtypes)).alias("types"))


TEXT_COLS = ["text", "lang", "source"]


def _text_sql(c):
    cleaned = f"regexp_replace(lower({c}), '[^a-z\\s]', '', 'g')"
    return f"""SELECT '{c}' AS column, min(length({c})) AS min_length, max(length({c})) AS max_length,
  round(avg(length({c})), 6) AS mean_length, count(*) FILTER (WHERE length({c}) = 0) AS empty_strings,
  count(*) FILTER (WHERE lower({c}) <> {cleaned}) AS rows_with_non_alphanumeric,
  round(count(*) FILTER (WHERE lower({c}) <> {cleaned}) * 10000.0 / count({c})) / 100 AS non_alphanumeric_percentage,
  count(DISTINCT {c}) AS case_sensitive_unique, count(DISTINCT {cleaned}) AS case_insensitive_unique,
  count(DISTINCT {c}) - count(DISTINCT {cleaned}) AS unique_count_reduction,
  count(*) FILTER (WHERE length({c}) > 200) AS very_long_values,
  count(*) FILTER (WHERE regexp_matches({c}, 'http|www')) AS contains_urls,
  count(*) FILTER (WHERE regexp_matches({c}, '[\\pL\\pN_]+@[\\pL\\pN_]+')) AS contains_emails,
  count(*) FILTER (WHERE regexp_matches({c}, '\\pN')) AS contains_numbers,
  count(*) FILTER (WHERE regexp_replace({c}, '^\\s+|\\s+$', '', 'g') = '') AS all_whitespace
FROM documents WHERE {c} IS NOT NULL"""


@register("A13", _union([_text_sql(c) for c in TEXT_COLS]))
def a13(spark, sf):
    return P.text_profile(table(spark, sf, "documents"), TEXT_COLS)


@register("A15S", """SELECT source, min(doc_id) AS first_seen FROM documents WHERE source IS NOT NULL
GROUP BY source ORDER BY first_seen LIMIT 20""")
def a15s(spark, sf):
    return P.first_distinct_values(table(spark, sf, "documents"), "source", "doc_id")


@register("A16", """SELECT 'o_orderdate' AS column, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_date,
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_date,
  CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) AS INTEGER) AS date_range_days
FROM orders
UNION ALL
SELECT 'ts', strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S'),
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS INTEGER) FROM events""")
def a16(spark, sf):
    return P.datetime_profile(table(spark, sf, "orders"), ["o_orderdate"]).unionByName(
        P.datetime_profile(table(spark, sf, "events"), ["ts"]))


@register("S11", S.with_ctes(S.LINES, body="""SELECT Country AS value, count(*) AS count,
  round(count(*) * 10000.0 / (SELECT count(Country) FROM lines)) / 100 AS percent,
  row_number() OVER (ORDER BY count(*) DESC, Country) AS rank
FROM lines WHERE Country IS NOT NULL GROUP BY Country"""))
def s11(spark, sf):
    return P.value_frequencies(lines(spark, sf), "Country")
