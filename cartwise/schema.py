"""Schemas and job parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Raw invoice-line file: keys are text (leading zeros and the 'C' prefix matter),
# the date is text in the file and parsed later.
RAW_LINES = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.StringType()),
    T.StructField("UnitPrice", T.DoubleType()),
    T.StructField("CustomerID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])

LINE_COLUMNS = [f.name for f in RAW_LINES.fields]

# Name of the ordering column every "first / top / sample" operator uses.
ROW_ORDER = "row_order"

BASKET_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType()),
    T.StructField("Items", T.ArrayType(T.StringType())),
    T.StructField("CustomerID", T.DoubleType()),
    T.StructField("InvoiceDate", T.TimestampNTZType()),
    T.StructField("TransactionValue", T.DoubleType()),
    T.StructField("Quantity", T.LongType()),
])


@dataclass(frozen=True)
class JobParams:
    """All tunables of the prepare / train / recommend jobs, range-checked."""

    min_support: float = 0.02
    min_confidence: float = 0.5
    max_bundle_size: int = 5
    train_fraction: float = 0.8
    random_state: int = 42
    iqr_multiplier: float = 1.5
    outlier_enabled: bool = False
    outlier_fields: tuple = ("Quantity", "UnitPrice", "TransactionValue")
    confidence_threshold: float = 0.5
    max_recommendations: int = 5
    oos_min_score: float = 0.3
    oos_max_alternatives: int = 1
    context_max_contexts: int = 3
    context_min_confidence: float = 0.6
    enrichment_fields: tuple = ("category", "material", "size", "theme")
    enrichment_batch_size: int = 10
    outlier_batch_size: int = 50
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 0.0 < self.min_support < 1.0:
            raise ValueError(f"min_support must be between 0 and 1, got {self.min_support}")
        if not 0.0 < self.min_confidence < 1.0:
            raise ValueError(f"min_confidence must be between 0 and 1, got {self.min_confidence}")
        if self.max_bundle_size < 2:
            raise ValueError(f"max_bundle_size must be at least 2, got {self.max_bundle_size}")
        if not 0.0 < self.train_fraction < 1.0:
            raise ValueError(f"train_fraction must be between 0 and 1, got {self.train_fraction}")
        if self.iqr_multiplier <= 0:
            raise ValueError(f"iqr_multiplier must be positive, got {self.iqr_multiplier}")
        if not 0.0 <= self.oos_min_score <= 1.0:
            raise ValueError(f"oos_min_score must be in [0, 1], got {self.oos_min_score}")
        if not 0.0 <= self.confidence_threshold <= 1.0:
            raise ValueError(f"confidence_threshold must be in [0, 1], got {self.confidence_threshold}")
        if self.max_recommendations < 1:
            raise ValueError("max_recommendations must be >= 1")
        if not 0.0 <= self.context_min_confidence <= 1.0:
            raise ValueError("context_min_confidence must be in [0, 1]")
