"""Registered queries: ad-hoc queries over the raw lines (Q01–Q15)."""

from cartwise.operators import query as Q
from cartwise.plans import sqlparts as S
from cartwise.plans.catalog import lines, out_lines, register, sql_lines
from cartwise.sources.tables import ORDER_SQL

ORDER_DESC = ", ".join(f"{c} DESC" for c in ORDER_SQL.split(", "))


def _q(body):
    return S.with_ctes(S.LINES, body=body)


@register("Q01", _q(sql_lines(f"(SELECT * FROM lines ORDER BY {ORDER_SQL} LIMIT 10)")))
def q01(spark, sf):
    return out_lines(Q.head(lines(spark, sf), 10))


@register("Q02", _q(sql_lines(f"(SELECT * FROM lines ORDER BY {ORDER_DESC} LIMIT 10)")))
def q02(spark, sf):
    return out_lines(Q.tail(lines(spark, sf), 10))


@register("Q03", _q("SELECT count(*) AS n_rows FROM lines"))
def q03(spark, sf):
    return Q.count_rows(lines(spark, sf))


@register("Q05", _q(sql_lines("lines WHERE CustomerID = 899")))
def q05(spark, sf):
    return out_lines(Q.by_customer(lines(spark, sf), 899))


@register("Q06", _q(sql_lines("lines WHERE contains(Country, 'ON_1')")))
def q06(spark, sf):
    return out_lines(Q.by_country(lines(spark, sf), "ON_1"))


@register("Q07", _q(sql_lines("lines WHERE InvoiceNo = '2'")))
def q07(spark, sf):
    return out_lines(Q.by_invoice(lines(spark, sf), "2"))


@register("Q08", _q(sql_lines("lines WHERE StockCode = '1616'")))
def q08(spark, sf):
    return out_lines(Q.by_product(lines(spark, sf), "1616"))


@register("Q09", _q(sql_lines("lines WHERE contains(lower(Description), 'widget')")))
def q09(spark, sf):
    return out_lines(Q.search(lines(spark, sf), "WIDGET"))


@register("Q10", _q(sql_lines("lines WHERE CAST(InvoiceDate AS DATE) = DATE '1997-05-28'")))
def q10(spark, sf):
    return out_lines(Q.by_date(lines(spark, sf), "1997-05-28"))


@register("Q11", _q("""SELECT count(*) AS total_records, count(DISTINCT CustomerID) AS unique_customers,
  count(DISTINCT StockCode) AS unique_products, count(DISTINCT Country) AS unique_countries,
  count(DISTINCT InvoiceNo) AS unique_invoices FROM lines"""))
def q11(spark, sf):
    return Q.stats(lines(spark, sf))


@register("Q12", _q("SELECT DISTINCT Country FROM lines"))
def q12(spark, sf):
    return Q.unique_values(lines(spark, sf), "Country")


@register("Q13", _q(f"""SELECT StockCode, CAST(sum(Quantity) AS BIGINT) AS total_quantity,
  last(Description ORDER BY {ORDER_SQL}) AS Description
FROM lines GROUP BY StockCode ORDER BY total_quantity DESC, StockCode LIMIT 10"""))
def q13(spark, sf):
    return Q.top_products(lines(spark, sf), 10)


@register("Q14", _q("""SELECT CustomerID, count(*) AS n_transactions FROM lines GROUP BY CustomerID
ORDER BY n_transactions DESC, CustomerID ASC NULLS FIRST LIMIT 10"""))
def q14(spark, sf):
    return Q.top_counts(lines(spark, sf), "CustomerID", 10)


@register("Q15", _q("""SELECT Country, count(*) AS n_transactions FROM lines GROUP BY Country
ORDER BY n_transactions DESC, Country ASC NULLS FIRST LIMIT 10"""))
def q15(spark, sf):
    return Q.top_counts(lines(spark, sf), "Country", 10)
