"""Helpers the operators of this package share.

Operators pick the columns they need under names of their own, or carry the whole
input row in one struct, so extra columns of any name pass or are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cartwise.session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda would else recompute it per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words in order: runs of anything but the six ASCII blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row by id and whole text; null ids and null texts have keys too."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(F.xxhash64(text)),
                       F.hex(F.xxhash64(F.lit(1), text)), text.isNull().cast("string"))


def salt_of(*columns: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), *columns), F.lit(salts)).cast("int")


def fan_out(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` (with a ``salt`` column) to ``table`` (one row per key) without a hot key.

    The table first goes to the (key, salt) pairs that occur, at most ``salts`` for a
    key; the rows then join on key and salt, so a key that holds a third of the rows is
    spread over ``salts`` tasks.
    """
    spread = rows.select(*keys, "salt").distinct().join(table, keys)
    return rows.join(spread, [*keys, "salt"], how)


def keep_rows(df: DataFrame, key: Column, winners: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is in ``winners`` (column ``key``, unique), one row per key.

    Of rows repeated under one key the one with the smallest hash of all its columns
    stays, so reruns agree.
    """
    rows = df.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = rows.join(winners.select("key"), "key").groupBy("key").agg(
        F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Running totals over the total order ``order``, without a window over all rows.

    ``sums`` maps new long columns to the long columns they add up, own row included.
    Rows are range-partitioned and sorted, each task adds up its own partition, and
    the totals of the earlier partitions (one row per partition) are added.  The
    locally summed rows are checkpointed first: a recomputed task must not draw
    other range bounds.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [*df.schema.fields, *[T.StructField(c, T.LongType()) for c in sums], T.StructField("_part", T.IntegerType())]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = dict.fromkeys(sums, 0)
        for batch in batches:
            if len(batch):
                out = batch.assign(_part=TaskContext.get().partitionId())
                for new, old in sums.items():
                    out[new] = before[new] + batch[old].to_numpy(np.int64).cumsum()
                    before[new] = int(out[new].iloc[-1])
                yield out[[f.name for f in fields]]

    local = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                        .mapInPandas(add, T.StructType(fields)))
    totals = local.groupBy("_part").agg(*[F.max(c).alias(f"_all_{c}") for c in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_at_{c}") for c in sums])
    joined = local.join(F.broadcast(offsets), "_part")  # one row per shuffle partition
    return joined.select(*df.columns, *[(F.col(c) + F.col(f"_at_{c}")).alias(c) for c in sums])
