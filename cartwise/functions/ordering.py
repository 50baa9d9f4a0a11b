"""Global ranks without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task.  Here
rows are range-partitioned on the order, sorted inside each partition, numbered
locally by ``monotonically_increasing_id`` (consecutive inside a partition), and
shifted by the row counts of the preceding partitions (a table with one row per
partition, broadcast).  Requires a total order (unique order keys).

Range bounds come from sampling, and the sample depends on the order in which
shuffle blocks arrive, so the numbered rows are materialised once with a
reliable checkpoint (shared ``spark.checkpoint.dir``) before the counts and the
offsets are taken from them.  Callers pass narrow frames (keys + order columns).

Where the order begins with a digest no bounds need to be sampled, and nothing is written:
see ``digest_row_number``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.session import cut_lineage


def global_row_number(df: DataFrame, order, name: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order`` (list of Columns/names)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = (ordered.withColumn("_mid", F.monotonically_increasing_id())
                       .withColumn("_pid", F.shiftright("_mid", 33))
                       .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)))
    numbered = cut_lineage(numbered.drop("_mid"))
    sizes = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (numbered.join(F.broadcast(offsets), "_pid")
                    .withColumn(name, F.col("_off") + F.col("_local") + 1)
                    .drop("_pid", "_local", "_off"))


DIGITS = 3      # a range: the digests that share their first hexadecimal digits


def digest_row_number(df: DataFrame, digest, ties, name: str = "rank") -> DataFrame:
    """1-based position of each row in the total order (``digest``, ``ties``), ``digest`` a hexadecimal text of the row.

    Distinct inputs of a digest spread evenly over its first digits, so these are the ranges.  They depend
    on the row alone: a recomputation gives the same numbers without a checkpoint.  A row moves once, and
    its digest is made again where it arrives instead of moving with it.
    """
    ranges = df.withColumn("_range", F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("int"))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_range").orderBy(digest, *ties)
    return (ranges.repartition("_range").withColumn("_local", F.row_number().over(within))
                  .join(F.broadcast(offsets), "_range")
                  .withColumn(name, F.col("_off") + F.col("_local"))
                  .drop("_range", "_local", "_off"))
