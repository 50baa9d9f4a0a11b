"""Basket assembly (A19) and bundle / engine statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.schema import ROW_ORDER


def create_baskets(lines: DataFrame, order: str = ROW_ORDER, placed_by: str | None = None,
                   keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per invoice.

    ``Items`` are the descriptions in line order; ``CustomerID`` / ``InvoiceDate`` the
    first non-null values; value and quantity are sums.  After F06 an invoice has
    at most one line per stock code, so ``Items`` is bounded by the catalogue, not by
    the data volume; the sums combine map-side.  If no basket has more than one
    item the result is empty (otherwise single-item baskets are kept).  ``placed_by``: a
    column that the invoice determines; lines that lie together by it stay there.

    ``keep`` persists the baskets: whether any has more than one item is then looked up at once, in
    what is kept, up to the first such basket.  Without it that question is a second
    run over the lines.
    """
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    baskets = (lines.filter(F.col("InvoiceNo").isNotNull())
               .groupBy("InvoiceNo", *([placed_by] if placed_by else []))
               .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                      F.col("Description").alias("d")))),
                                lambda s: s["d"]).alias("Items"),
                    first("CustomerID").alias("CustomerID"),
                    first("InvoiceDate").alias("InvoiceDate"),
                    F.sum("TransactionValue").alias("TransactionValue"),
                    F.sum("Quantity").cast("bigint").alias("Quantity"))
               .drop(placed_by or ""))
    if keep is not None:
        kept = keep(baskets)
        return kept.filter(F.lit(False)) if kept.filter(F.size("Items") > 1).isEmpty() else kept
    gate = baskets.agg(F.max(F.size("Items"))).scalar()
    return baskets.filter(F.coalesce(gate, F.lit(0)) > 1)


def basket_count(baskets: DataFrame) -> DataFrame:
    """Number of baskets (engine statistics)."""
    return baskets.agg(F.count(F.lit(1)).alias("n_baskets"))


def bundle_statistics(bundles: DataFrame) -> DataFrame:
    """Total, min / max / mean size (one row)."""
    return bundles.agg(F.count(F.lit(1)).alias("total_bundles"),
                       F.min("size").alias("min_size"), F.max("size").alias("max_size"),
                       F.round(F.avg("size"), 6).alias("avg_size"))


def bundle_size_distribution(bundles: DataFrame) -> DataFrame:
    """Bundles per size."""
    return bundles.groupBy("size").agg(F.count(F.lit(1)).alias("n_bundles"))


def top_bundles(bundles: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` bundles in bundle order (a top-k: the limit is the feature)."""
    return bundles.orderBy("size", F.desc("support_count"), "bundle").limit(n)
