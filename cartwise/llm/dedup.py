"""Exact dedup by skew-safe combining.

Texts are equal when identical after lower-casing A-Z; of equal texts the row with the
largest id stays.  Three levels, each keyed by the whole text beside its digest, so the
content is compared at every level: tasks combine their own rows (the map side of the
first aggregation), salted groups of a digest are merged, and the salt winners, at
most ``salts`` per digest, are combined globally.  Verdicts return to the rows over
(digest, salt), so a text that holds a third of the rows never meets in one task.

Defined results: a null text equals an empty one; null ids rank below all others (a
group of null ids has ``keep_id`` null and keeps one row); of rows that repeat both id
and text one stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import ascii_lower, fan_out, keep_rows, salt_of, text_of

SALTS = 64


def keyed(df: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), ascii_lower(text_of(F.col(f"`{text_col}`"))).alias("norm"))
    return rows.select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"),
                       salt_of(F.col("doc_id"), salts=salts).alias("salt"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size."""
    rows = keyed(df, id_col, text_col, salts)
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # Dealt by digest alone: the texts of a digest meet, and the check below needs no further shuffle.
    whole = salted.repartition("digest").groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    one = whole.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
                                      F.count(F.lit(1)).alias("texts"))
    return one.select("digest", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two different texts have one SHA-256 digest"))).alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = keyed(df, id_col, text_col, salts).groupBy("digest", "salt", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    found = fan_out(rows, groups(df, id_col, text_col, salts), ["digest"])
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("doc_id", "keep_id", "group_size",
                        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def _key(digest, doc_id):
    return F.concat_ws(":", F.hex(digest), F.coalesce(doc_id.cast("string"), F.lit("null")))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, whole."""
    digest = F.unhex(F.sha2(ascii_lower(text_of(F.col(f"`{text_col}`"))), 256))
    winners = groups(df, id_col, text_col, salts).select(_key(F.col("digest"), F.col("keep_id")).alias("key"))
    return keep_rows(df, _key(digest, F.col(f"`{id_col}`")), winners)
