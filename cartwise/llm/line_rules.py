"""Quality rules (native): base rules, then the cross-document line frequency.

Lines are normalised (lower case, blanks cut at both ends) and hashed; per host the distinct
documents that hold a line are counted; lines in at least ``min_docs`` of them and either in
over ``max_share_percent`` of the host's or in ``max_docs`` are removed, and a document that loses more than ``max_lost_percent`` of its words is depleted.

A copied document must not make its own lines look like boilerplate, so documents are
told apart by the hash of all their normalised lines in order: exact copies count once,
documents that differ in any line count each.

Defined results: a null or empty text has no words (base rule fails); a null host is a
host of its own; repeated rows get the same verdict each; an empty table gives an empty
result; other columns of any name pass through ``with_verdict`` unless they are named
like one of its own result columns (in any case), which then replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import let, salt_of, text_of, words
from cartwise.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20            # a line in fewer distinct documents of its host is never removed
MAX_SHARE_PERCENT = 2    # nor, below MAX_DOCS, one in at most this share of the host's distinct documents
MAX_DOCS = 1000          # a line in so many distinct documents of its host is removed whatever its share
MAX_LOST_PERCENT = 50
MAX_BROADCAST_LINES = 200_000
SALTS = 64

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")


def normal_lines(text: Column) -> Column:
    """Normalised lines with a word, in order, repeats included."""
    return F.filter(F.transform(F.split(F.lower(text), "\n"), trimmed), lambda x: x != "")


def repeat_words(word_list: Column) -> Column:
    """Words in 3-word windows that occur twice or more, found within the row.

    A text whose window hashes are all distinct has none; else (hash, place) pairs are
    sorted, and the places whose neighbour has the same hash are the repeated ones.
    """
    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(s):
        return F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))

    def covered(r):
        return F.size(F.array_distinct(F.flatten(F.transform(r, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda s: covered(repeated(s))))

    return F.when(F.size(word_list) < 4, F.lit(0)).otherwise(let(hashes(word_list), count))


def base_metrics(text: Column) -> Column:
    """Struct of the five base counts (long)."""
    return let(words(text), lambda w: let(lines_with_words(text), lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).cast("long").alias("n_repeat_words"))))


def frequent_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS,
                   max_share_percent: float = MAX_SHARE_PERCENT, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line hash, n_docs) of the lines above the limits."""
    found = let(F.transform(normal_lines(text_of(text_col)), lambda y: F.xxhash64(y)), lambda h: F.struct(
        F.xxhash64(h).alias("doc"), F.array_distinct(h).alias("lines")))
    docs = df.select(F.col(f"`{host_col}`").alias("host"), found.alias("found")).select("host", "found.*")
    docs = docs.where(F.size("lines") > 0)
    sizes = docs.groupBy("host", "doc").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = (docs.select("host", "doc", F.explode("lines").alias("line")).groupBy("host", "doc", "line").agg(F.lit(1))
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs))
    hosts = sizes.select(F.col("host").alias("of_host"), "host_docs")
    above = (F.col("n_docs") * 100 > F.col("host_docs") * max_share_percent) | (F.col("n_docs") >= max_docs)
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where(above).select("host", "line", "n_docs")


def removed_sets(frequent: DataFrame, slot: int = 8) -> DataFrame:
    """One hash table per host: an array of arrays, a line in that at hash mod size, about ``slot`` lines to each."""
    host = ["host_key", "host_null"]
    lines = frequent.select(F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host_key"), F.col("host").isNull().alias("host_null"), "line")
    sizes = lines.groupBy(*host).agg(F.ceil(F.count(F.lit(1)) / slot).cast("int").alias("n"))
    slots = lines.join(sizes, host).select(*host, F.pmod("line", "n").cast("int").alias("slot"), "line").union(
        sizes.select(*host, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"), F.lit(None).cast("long")))
    slots = slots.groupBy(*host, "slot").agg(F.collect_list("line").alias("lines"))
    return slots.groupBy(*host).agg(F.sort_array(F.collect_list(F.struct("slot", "lines")))["lines"].alias("removed"))


def with_verdict(df: DataFrame, host_col: str = "source", text_col: str = "text", min_words: int = MIN_WORDS,
                 max_repeat_percent: int = MAX_REPEAT_PERCENT, min_docs: int = MIN_DOCS,
                 max_share_percent: float = MAX_SHARE_PERCENT, max_lost_percent: float = MAX_LOST_PERCENT,
                 max_broadcast_lines: int = MAX_BROADCAST_LINES, salts: int = SALTS, max_docs: int = MAX_DOCS) -> DataFrame:
    """Each row of ``df`` with the base counts, ``base_failed``, ``lost_words``, ``clean_text`` and ``kept``.

    The removed lines are few: each is in over ``max_share_percent`` of its host or in ``max_docs``.  Their
    table is written once and counted; up to ``max_broadcast_lines`` it is broadcast as one
    set per host, so no document moves; beyond, documents and sets meet by (host, salt).
    """
    frequent = cut_lineage(frequent_lines(df, host_col, text_col, min_docs, max_share_percent, max_docs))
    sets = removed_sets(frequent)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text_of(text_col).alias("text"),
                     F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host_key"),
                     F.col(f"`{host_col}`").isNull().alias("host_null"))
    if frequent.count() <= max_broadcast_lines:
        rows = rows.join(F.broadcast(sets), ["host_key", "host_null"], "left")
    else:
        salted = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", salt_of(F.col("text"), salts=salts)).join(
            salted, ["host_key", "host_null", "salt"], "left")

    def gone(line):
        h = F.xxhash64(trimmed(F.lower(line)))
        return F.array_contains(F.get("removed", F.pmod(h, F.size("removed")).cast("int")), h)

    def cut(marked):
        return F.struct(
            F.aggregate(marked, F.lit(0), lambda n, x: F.when(x["gone"], n + F.size(words(x["line"]))).otherwise(n)).cast("long").alias("lost"),
            F.array_join(F.transform(F.filter(marked, lambda x: ~x["gone"]), lambda x: x["line"]), "\n").alias("clean"))

    left = F.when(F.col("removed").isNull(), F.struct(F.lit(0).cast("long").alias("lost"), F.col("text").alias("clean"))).otherwise(
        let(F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), gone(x).alias("gone"))), cut))
    own = {*METRICS, "base_failed", "lost_words", "clean_text", "kept"}
    failed = (F.col("v.m.n_words") < min_words) | (F.col("v.m.n_repeat_words") * 100 > F.col("v.m.n_words") * max_repeat_percent)
    depleted = F.col("v.left.lost") * 100 > F.col("v.m.n_words") * max_lost_percent
    # A generated row is computed once: Catalyst moves no filter on it below and copies none of its expressions.
    rows = rows.select("row", F.explode(F.array(F.struct(base_metrics(F.col("text")).alias("m"), left.alias("left")))).alias("v"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in own], "v.m.*",
                       F.col("v.left.lost").alias("lost_words"), F.col("v.left.clean").alias("clean_text"),
                       failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def drop_rejected(df: DataFrame, chars_col: str = "n_chars", **parameters) -> DataFrame:
    """The rows that stay, with their own columns alone and their text without the removed lines.

    Where a row loses a line, ``chars_col`` (if the table has it) becomes the length of the text left.
    """
    text_col = parameters.get("text_col", "text")
    verdict = with_verdict(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                                     F.col(f"`{parameters.get('host_col', 'source')}`").alias("host"),
                                     F.col(f"`{text_col}`").alias("text")),
                           **{**parameters, "host_col": "host", "text_col": "text"})
    left = {text_col: F.col("clean_text"), chars_col: F.char_length("clean_text")}

    def value(field):
        own = F.col("row").getField(field.name)
        if field.name not in left:
            return own.alias(field.name)
        return F.when(F.col("lost_words") > 0, left[field.name].cast(field.dataType)).otherwise(own).alias(field.name)

    return verdict.where("kept").select(*[value(f) for f in df.schema.fields])
