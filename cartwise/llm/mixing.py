"""Mixing sources to target weights by weighted fair queueing.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share all
words; a target stops at ``max_passes`` times its source's size and the excess is reshared
by weight until none is above.  That limit is the water level L with
sum(min(cap, L * weight)) = total, found from running totals in the order of cap / weight.

Queue: each source's documents stand in a shuffled order, once per pass, and a document
finishes at (words of its source up to and with it) / target.  All (document, pass) rows
are range-sorted by finish time and taken while their running total is within the
budget.  Running totals come from range partitions and their offsets, so neither a hot
source nor the whole order meets in one task.

Defined results: a null text has size 0 and is never taken, nor is an empty one; a null
source is a source of its own, last; rows that repeat id, source and text queue as one
document of their joint size and are taken together; an empty table gives an empty
result; other columns are not read (``mix_rows`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import WORD, prefix_sums, row_key, text_of
from cartwise.session import cut_lineage

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
SEED = "mix"


def targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES, weight_of: dict | None = None) -> DataFrame:
    """``sizes`` (source, source_size) with rank, weight and target.  ``weight_of`` names weights by source instead."""
    one = sizes.withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(one, [F.col("source").isNull(), "source"], {"rank": "one"})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    if weight_of:
        named = F.create_map(*[F.lit(x) for pair in weight_of.items() for x in pair])
        weight = F.coalesce(F.element_at(named, F.col("source")).cast("long"), weight)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_passes)
    # Filled sources first: those whose cap is reached at the lowest level.
    levels = prefix_sums(ranked, [F.col("cap") / F.col("weight"), "rank"], {"caps": "cap", "heft": "weight"})
    all_of = levels.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("heft"))
    total, heft = all_of.select("total").scalar(), all_of.select("heft").scalar()
    # The level if exactly the sources before this one are full; the first that does not pass its own cap holds.
    level = (total - (F.col("caps") - F.col("cap"))).cast("double") / (heft - (F.col("heft") - F.col("weight")))
    levels = levels.withColumn("level", level)
    fits = levels.where(F.col("level") <= F.col("cap") / F.col("weight")).agg(F.min_by("level", F.struct(F.col("cap") / F.col("weight"), "rank")).alias("level"))
    water = fits.scalar()
    filled = F.least(F.col("cap").cast("double"), water * F.col("weight"))
    return levels.select("source", "rank", "weight", "source_size", F.coalesce(filled, F.lit(0.0)).alias("target"))


def _key(doc_id, text, source):
    return F.concat_ws(":", row_key(doc_id, text), source.isNull().cast("string"), source.cast("string"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_passes: int = MAX_PASSES, seed: str = SEED, weight_of: dict | None = None) -> DataFrame:
    """One row per input row: key, doc_id, size, source, source_size, target, passes, taken."""
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    size = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    # Words are counted once; rows that repeat become one unit with ``copies``.
    units = cut_lineage(df.select(_key(doc_id, text, F.col(f"`{source_col}`")).alias("key"), doc_id.alias("doc_id"),
                                  F.col(f"`{source_col}`").alias("source"), size.alias("size"))
                        .groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    sources = cut_lineage(targets(sizes, weights, max_passes, weight_of))
    # One row per source: AQE broadcasts it where its measured size allows, and splits a hot source else.
    at = sources.select(F.col("source").alias("s"), "rank", "source_size", "target")
    units = units.join(at, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    shuffled = [F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))), "key"]
    queue = units.select("*", (F.col("size") * F.col("copies")).alias("words"), shuffled[0].alias("place"))
    queue = prefix_sums(queue, ["rank", "place", "key"], {"upto": "words"})
    # Running totals run on over sources; each source starts where the sizes of the lower ranks end.
    starts = prefix_sums(sources.select("rank", "source_size"), ["rank"], {"ends": "source_size"}).select(
        F.col("rank").alias("r"), (F.col("ends") - F.col("source_size")).alias("start"))
    queue = queue.join(starts, F.col("rank") == F.col("r")).withColumn("upto", F.col("upto") - F.col("start"))
    # A document can be reached in a pass that starts below the target.
    turns = queue.where("words > 0").select("key", "words", "rank", "place", "target", "source_size", "upto", F.explode(
        F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("turn")).where(
        F.col("turn") * F.col("source_size") < F.col("target"))
    finish = (F.col("turn") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    line = turns.select(finish.alias("finish"), "rank", "place", "turn", "key", "words")
    line = prefix_sums(line, ["finish", "rank", "place", "turn", "key"], {"total": "words"})
    budget = sources.agg(F.sum("source_size")).scalar()
    passes = line.where(F.col("total") <= budget).groupBy("key").agg(F.count(F.lit(1)).alias("passes"))
    out = units.join(passes, "key", "left").withColumn("passes", F.coalesce("passes", F.lit(0)).cast("int"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("key", "doc_id", "size", "source", "source_size", "target", "passes",
                      (F.col("passes") * F.col("size")).alias("taken"))


def mix_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The mixed table: each row as often as the mix takes it, whole."""
    passes = mix(df, id_col, text_col, source_col, **parameters).where("passes > 0").select("key", "passes").distinct()
    rows = df.select(_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`")).alias("key"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.join(passes, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*")
