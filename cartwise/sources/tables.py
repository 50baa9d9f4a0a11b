"""Driver tables (Parquet) and the invoice-line view derived from them."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.schema import ROW_ORDER

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet keeps column pruning and filter pushdown."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Invoice lines over lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation, one row per
# line item.  The expressions inject the defects the cleaning steps look for
# (cancelled invoices, missing customers and descriptions, non-positive amounts)
# and are written in the common subset of Spark SQL and DuckDB, so that the same
# text defines the Spark input and the oracle's input.  ``{name}`` placeholders
# are table references.
RETAIL_VIEW_SQL = """
SELECT
  CASE WHEN o.o_orderstatus = 'P' THEN 'C' ELSE '' END || CAST(o.o_orderkey AS STRING) AS InvoiceNo,
  CAST(l.l_partkey AS STRING) AS StockCode,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE '  ' || UPPER(p.p_name) || ' ' END AS Description,
  CAST(CASE WHEN l.l_tax = 0.08 THEN -l.l_quantity ELSE l.l_quantity END AS INT) AS Quantity,
  o.o_orderdate AS InvoiceDate,
  CASE WHEN l.l_discount = 0.1 THEN CAST(0 AS DOUBLE) ELSE p.p_retailprice END AS UnitPrice,
  CASE WHEN o.o_custkey % 10 = 0 THEN NULL ELSE CAST(o.o_custkey AS DOUBLE) END AS CustomerID,
  n.n_name AS Country,
  l.l_orderkey AS ord1, l.l_linenumber AS ord2, l.l_partkey AS ord3, l.l_suppkey AS ord4,
  l.l_extendedprice AS ord5
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

# The same rows for Spark: lines meet parts and orders meet customers first, so that lines
# move by part and then by order, in which they stay.  Column names differ from table to table,
# so their qualifiers can go.
_SELECTED = re.sub(r"\b[lopcn]\.(?=[lopcn]_)", "", RETAIL_VIEW_SQL.split("FROM {lineitem} l")[0])
LINES_WITH_PARTS = "SELECT * FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
RETAIL_VIEW_SPARK = _SELECTED + """FROM {lines}
JOIN ({orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey)
ON l_orderkey = o_orderkey
"""

# Lines that a task is meant for.  Sorts and groups hold a line at ten times and more of what it takes
# in a shuffle, by whose size Spark would put partitions together.
LINES_A_TASK = 250_000

# Unique, stable line order of the view (file order stand-in).
ORDER_COLUMNS = ("ord1", "ord2", "ord3", "ord4", "ord5")
ORDER_SQL = ", ".join(ORDER_COLUMNS)
# The order key as a column of its own: an invoice number has one, and lines lie together by it.
PLACED_BY = "_place"


def retail_view_sql_duckdb() -> str:
    """The view text with plain table names (DuckDB's pre-registered views)."""
    return RETAIL_VIEW_SQL.format(lineitem="lineitem", orders="orders", part="part",
                                  customer="customer", nation="nation")


def _line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the lines by order, or 0 where Spark's own number is enough (one for each core, if it has as many partitions)."""
    tasks = math.ceil(table(spark, sf_dir, "lineitem").count() / LINES_A_TASK)
    own = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tasks if tasks > own else 0


def retail_lines(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Raw invoice lines (FIXTURES §3) with a struct ``row_order``.

    The joins are planned by Catalyst: nation (25 rows) and, at small scale, part and
    customer fall under ``autoBroadcastJoinThreshold`` (a size check on real
    statistics); lineitem ⋈ part and then ⋈ orders are shuffle joins, the last on the order
    key.  ``placed`` adds that key as ``PLACED_BY``, so that steps by invoice that are told
    of it move no line again.  As all those steps then run in the tasks of that join, these
    are as many as the lines need (``LINES_A_TASK``), unless Spark makes that many by itself.
    """
    tabs = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "customer", "nation")}
    lines = spark.sql(LINES_WITH_PARTS, lineitem=tabs.pop("lineitem"), part=tabs.pop("part"))
    tasks = _line_tasks(spark, sf_dir) if placed else 0
    if tasks:
        lines = lines.repartition(tasks, "l_orderkey")
    df = spark.sql(RETAIL_VIEW_SPARK, lines=lines, **tabs)
    return df.select(
        "InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
        "CustomerID", "Country",
        F.struct(*[F.col(c).alias(c) for c in ORDER_COLUMNS]).alias(ROW_ORDER),
        *([F.col("ord1").alias(PLACED_BY)] if placed else []),
    )
