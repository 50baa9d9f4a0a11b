"""Exact quantiles of whole columns without a task that holds a column.

``percentile`` as a global aggregate keeps every distinct value of a column in one
task's map.  Here the values are counted by a group-by (a hot value is combined before
the shuffle), the counts are range-partitioned, each partition adds up its own counts,
and the totals of the partitions (one number per partition and column) tell which
partitions hold the wanted ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.functions.sketches import quantile_sketches, sketched_quantiles
from cartwise.session import cut_lineage


def exact_quantiles(df: DataFrame, cols, probs) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, as pandas ``quantile`` gives them.

    Nulls and NaN are ignored; a column without values gives None for each quantile.
    Runs its jobs at once: what comes back is ``len(cols) * len(probs)`` numbers, and the
    driver sees one total per column and shuffle partition and two values per quantile.
    """
    cols, spark = list(cols), df.sparkSession
    if not cols:
        return {}
    pairs = [F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)]
    counts = (df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull() & ~F.isnan("value"))
              .groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are drawn from a sample: what is numbered must not be drawn again.
    ranged = cut_lineage(counts.repartitionByRange(parts, "col", "value").withColumn("part", F.spark_partition_id()))
    totals: dict[int, list[tuple[int, int]]] = {}
    for r in ranged.groupBy("col", "part").agg(F.sum("n").alias("n")).collect():
        totals.setdefault(r["col"], []).append((r["part"], r["n"]))

    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}   # (column, partition): (rank, rank inside)
    for col, sizes in totals.items():
        last = sum(n for _, n in sizes) - 1
        ranks = sorted({f(p * last) for p in probs for f in (math.floor, math.ceil)})
        before = 0
        for part, n in sorted(sizes):
            if inside := [(k, k - before) for k in ranks if before <= k < before + n]:
                wanted[col, part] = inside
            before += n
    found: dict[tuple[int, int], float] = {}
    if wanted:
        asked = spark.createDataFrame([(c, p, k, i) for (c, p), ks in wanted.items() for k, i in ks],
                                      "col int, part int, rank long, inside long")
        upto = Window.partitionBy("col", "part").orderBy("value")
        held = ranged.join(F.broadcast(asked.select("col", "part").distinct()), ["col", "part"], "left_semi")
        held = held.withColumn("upto", F.sum("n").over(upto))
        hits = held.join(F.broadcast(asked), ["col", "part"]).filter(
            (F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
        found = {(r["col"], r["rank"]): r["value"] for r in hits.select("col", "rank", "value").collect()}

    def at(col: int, p: float) -> float | None:
        if col not in totals:
            return None
        h = p * (sum(n for _, n in totals[col]) - 1)
        low, high = math.floor(h), math.ceil(h)
        return found[col, low] if low == high else (high - h) * found[col, low] + (h - low) * found[col, high]
    return {c: [at(i, p) for p in probs] for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols, probs, approximate: bool = False) -> dict[str, list[float | None]]:
    """``exact_quantiles``, or with ``approximate`` sketched ones: one scan, no range partitioning."""
    if approximate:
        return sketched_quantiles(quantile_sketches(df, cols), cols, probs) if cols else {}
    return exact_quantiles(df, cols, probs)


def iqr_fences(df: DataFrame, cols, multiplier: float, approximate: bool = False) -> dict[str, tuple[float | None, float | None]]:
    """(lower, upper) per column: quartiles minus and plus ``multiplier`` times their distance."""
    quartiles = quantiles(df, cols, (0.25, 0.75), approximate)
    return {c: (None, None) if q1 is None else (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
            for c, (q1, q3) in quartiles.items()}
