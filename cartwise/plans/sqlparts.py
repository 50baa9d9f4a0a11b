"""Oracle SQL building blocks (DuckDB dialect) mirroring the Spark operators.

Each constant is a list of CTEs; queries in the catalog prepend what they need.
The invoice-line view text itself is shared with Spark (sources.tables).
"""

from cartwise.sources.tables import ORDER_SQL, retail_view_sql_duckdb

LINES = f"lines AS ({retail_view_sql_duckdb()})"

CLEAN = f"""
c1 AS (SELECT *, false AS IsCancellation FROM lines WHERE NOT coalesce(starts_with(InvoiceNo, 'C'), false)),
c2 AS (SELECT * FROM c1 WHERE CustomerID IS NOT NULL),
c3 AS (SELECT * FROM c2 WHERE Description IS NOT NULL AND Quantity > 0 AND UnitPrice > 0),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY InvoiceNo, StockCode ORDER BY {ORDER_SQL}) AS rn FROM c3) WHERE rn = 1),
proc AS (SELECT * REPLACE (lower(regexp_replace(Description, '^\\s+|\\s+$', '', 'g')) AS Description) FROM dd),
feat AS (SELECT *, CAST(month(InvoiceDate) % 12 // 3 + 1 AS INTEGER) AS InvoiceSeason,
                CAST(isodow(InvoiceDate) AS INTEGER) AS InvoiceDayOfWeek,
                Quantity * UnitPrice AS TransactionValue FROM proc)
"""

BASKETS = f"""
b0 AS (SELECT InvoiceNo,
              list(Description ORDER BY {ORDER_SQL}) AS item_list,
              first(CustomerID ORDER BY {ORDER_SQL}) FILTER (WHERE CustomerID IS NOT NULL) AS CustomerID,
              first(InvoiceDate ORDER BY {ORDER_SQL}) FILTER (WHERE InvoiceDate IS NOT NULL) AS InvoiceDate,
              sum(TransactionValue) AS TransactionValue,
              CAST(sum(Quantity) AS BIGINT) AS Quantity
       FROM feat WHERE InvoiceNo IS NOT NULL GROUP BY InvoiceNo),
baskets AS (SELECT * FROM b0 WHERE (SELECT coalesce(max(len(item_list)), 0) FROM b0) > 1),
nb AS (SELECT count(*) AS n FROM baskets),
bi AS (SELECT DISTINCT InvoiceNo, unnest(item_list) AS item FROM baskets)
"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(p.strip().strip(",") for p in parts) + "\n" + body


def itemsets_sql(min_support: float, max_size: int) -> str:
    """Brute-force itemsets of size 2..max_size: every k items of a basket, counted."""
    def level(k):
        a = [f"x{i}" for i in range(k)]
        joins = "".join(f" JOIN bi {t} ON x0.InvoiceNo = {t}.InvoiceNo AND {p}.item < {t}.item" for p, t in zip(a, a[1:]))
        return (f"SELECT {" || '|' || ".join(f'{t}.item' for t in a)} AS bundle, {k} AS size, count(*) AS support_count "
                f"FROM bi x0{joins} GROUP BY {', '.join(f'{t}.item' for t in a)}")
    return "(" + " UNION ALL ".join(level(k) for k in range(2, max_size + 1)) + ")"


def bundles_cte(min_support: float, max_size: int) -> str:
    return f"""bundles AS (
SELECT s.bundle, s.size, s.support_count, round(s.support_count / nb.n, 9) AS support,
       string_split(s.bundle, '|') AS items
FROM {itemsets_sql(min_support, max_size)} s, nb
WHERE s.support_count >= {min_support} * nb.n)"""
