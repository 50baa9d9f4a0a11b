"""Streaming invoice lines: the stateless cleaning steps plus watermark dedup.

The batch chain's filters (F01–F04) are stateless and run unchanged on a stream;
duplicate (invoice, stock code) lines are dropped within the event-time watermark
(``dropDuplicatesWithinWatermark``), so state stays bounded.  Used with
``foreachBatch`` the batch operators (baskets, enrichment) apply per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cartwise.operators.clean import (drop_missing_descriptions, handle_cancellations, keep_positive_amounts,
                                      normalize_descriptions, remove_missing_customers)


def clean_stream(lines: DataFrame, watermark: str = "1 day", event_time: str = "InvoiceDate") -> DataFrame:
    return (lines.transform(handle_cancellations).transform(remove_missing_customers)
                 .transform(drop_missing_descriptions).transform(keep_positive_amounts)
                 .withWatermark(event_time, watermark)
                 .dropDuplicatesWithinWatermark(["InvoiceNo", "StockCode"])
                 .transform(normalize_descriptions))
