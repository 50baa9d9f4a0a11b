"""Ad-hoc queries over the raw invoice lines (Q01–Q15).

True column semantics (no comma splitting); NULL is its own group in the top-N
counts and is not counted as a distinct value.  Every top-N breaks ties
lexically on its key, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.sketches import approximate_distinct
from cartwise.schema import LINE_COLUMNS, ROW_ORDER


def head(df: DataFrame, n: int = 10) -> DataFrame:
    """Q01: first n lines in file order (top-k, the limit is the feature)."""
    return df.orderBy(ROW_ORDER).limit(n)


def tail(df: DataFrame, n: int = 10) -> DataFrame:
    """Q02: last n lines in file order."""
    return df.orderBy(F.col(ROW_ORDER).desc()).limit(n)


def count_rows(df: DataFrame) -> DataFrame:
    """Q03."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def by_customer(df: DataFrame, customer_id: float) -> DataFrame:
    """Q05."""
    return df.filter(F.col("CustomerID") == F.lit(float(customer_id)))


def by_country(df: DataFrame, name: str) -> DataFrame:
    """Q06: substring match on Country."""
    return df.filter(F.col("Country").contains(name))


def by_invoice(df: DataFrame, invoice_no: str) -> DataFrame:
    """Q07."""
    return df.filter(F.col("InvoiceNo") == invoice_no)


def by_product(df: DataFrame, stock_code: str) -> DataFrame:
    """Q08."""
    return df.filter(F.col("StockCode") == stock_code)


def search(df: DataFrame, text: str) -> DataFrame:
    """Q09: case-insensitive substring search in Description."""
    return df.filter(F.lower(F.col("Description")).contains(text.lower()))


def by_date(df: DataFrame, day: str) -> DataFrame:
    """Q10: calendar-date equality (``day`` as yyyy-MM-dd)."""
    return df.filter(F.to_date(F.col("InvoiceDate")) == F.to_date(F.lit(day)))


def stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Q11: rows and distinct customers, products, countries, invoices (nulls excluded).

    ``approximate`` counts by sketches in one pass, without copying rows per column.
    """
    count = (lambda c: approximate_distinct(F.col(c))) if approximate else F.countDistinct
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  count("CustomerID").alias("unique_customers"),
                  count("StockCode").alias("unique_products"),
                  count("Country").alias("unique_countries"),
                  count("InvoiceNo").alias("unique_invoices"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Q12: sorted distinct values of one of the line columns; others are rejected."""
    if column not in LINE_COLUMNS:
        raise ValueError(f"Invalid column name: {column}; available: {', '.join(LINE_COLUMNS)}")
    return df.select(column).distinct().orderBy(column)


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """Q13: total quantity per stock code with its last-seen description."""
    g = df.groupBy("StockCode").agg(F.sum("Quantity").alias("total_quantity"),
                                    F.max_by("Description", ROW_ORDER).alias("Description"))
    return g.orderBy(F.desc("total_quantity"), "StockCode").limit(n)


def top_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Q14 / Q15: line count per value (NULL is a group)."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n_transactions"))
    return g.orderBy(F.desc("n_transactions"), F.col(column).asc_nulls_first()).limit(n)
