"""Filter interaction audit: what each filter removes, in every order of the filters.

Each document gets a mask, one bit for each filter that it fails.  The text filters are
column expressions.  The last filter, exact copies of a smaller id's text, comes from
radix tries (compressed tries, one edge per run of characters) of whole texts, which hold
at each terminal the smallest id and the rows that end there; a traversal flags the rows
above the smallest.  Three passes use the same trie:

1. Each input task builds tries of its own rows, flags copies at once and passes on each
   text once, with its smallest id.  A trie is emptied at ``FLUSH`` characters.
2. Texts whose copies are still heavy (see below) are combined by (text, salt), the salt
   being dealt by producing task, so that at most ``salts`` rows of a text go on.
3. The rest is range-partitioned by adaptive prefixes.  A prefix is 8 characters long and
   doubles while the texts under it weigh more than a quarter of a partition's share,
   up to the whole text.  Equal texts have equal prefixes and meet in one trie.

Heavy prefixes are at most four a partition and length, so broadcasting their hashes is
bounded (``MAX_RANGES``).  The range key is the first 64 characters of the prefix and its
hash, so that sampled bounds stay small.  What passes 1 and 2 have decided travels without
its text.  Masks are then counted by part (at most 2^k rows a part for k filters), and the
k! orders are worked out on the counts alone.

Defined results: a null text equals an empty one; a null id is smaller than none and has
none below it, so such rows are no copies and make none; rows that repeat id and text are
not copies of each other and count each; several labels of an id count as their maximum,
labels without a document not at all; a null part is the empty string; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import text_of, words
from cartwise.session import checkpoint_dir

FLUSH = 1 << 25             # characters a map-side trie takes before it is emptied
RANGE_CHARS = 1 << 26       # characters meant for one range partition
MAX_RANGES = 1 << 14        # partitions that the weight limit of a prefix reckons with
SALTS = 64
FIRST = 8                   # characters of the shortest prefix
KEY_CHARS = 64              # characters of the range key
OUT_ROWS = 512


class Node:
    __slots__ = ("edges", "label", "least", "members")

    def __init__(self, label: str = ""):
        self.label = label
        self.edges: dict[str, Node] = {}
        self.least = None
        self.members: dict | None = None


class RadixTrie:
    """A compressed trie of whole texts; terminals hold the smallest id and the members (id, tag) with counts."""

    def __init__(self):
        self.root, self.chars = Node(), 0

    def insert(self, text: str, doc_id: int, tag, copies: int = 1) -> None:
        node = self._terminal(text)
        if node.members is None:
            node.members = {}
            self.chars += len(text)
        node.least = doc_id if node.least is None else min(node.least, doc_id)
        node.members[doc_id, tag] = node.members.get((doc_id, tag), 0) + copies

    def _terminal(self, text: str) -> Node:
        node, at, n = self.root, 0, len(text)
        while at < n:
            child = node.edges.get(text[at])
            if child is None:
                leaf = node.edges[text[at]] = Node(text[at:])
                return leaf
            if not text.startswith(child.label, at):
                same, over = 1, min(len(child.label), n - at) + 1     # characters that agree: at least, less than
                while over - same > 1:
                    mid = (same + over) // 2
                    if text.startswith(child.label[same:mid], at + same):
                        same = mid
                    else:
                        over = mid
                fork = node.edges[text[at]] = Node(child.label[:same])
                child.label = child.label[same:]
                fork.edges[child.label[0]] = child
                child = fork
            node, at = child, at + len(child.label)
        return node

    def traverse(self) -> Iterator[tuple[str, int, dict]]:
        """Text, smallest id and members of each terminal."""
        stack = [(self.root, "")]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.members is not None:
                yield text, node.least, node.members
            stack.extend((child, text) for child in node.edges.values())


def _flagged(trie: RadixTrie, duplicate: int, last: bool) -> Iterator[tuple]:
    for text, least, members in trie.traverse():
        for (doc_id, (part, mask)), copies in members.items():
            above = doc_id > least
            yield doc_id, part, copies, mask | duplicate if above else mask, None if above or last else text, whole_level(len(text))


def whole_level(length: int) -> int:
    """Level of the shortest prefix length (8, 16, 32 ...) that covers a text."""
    return max(0, -(-length // FIRST) - 1).bit_length()


FIELDS = [("doc_id", pa.int64()), ("part", pa.string()), ("copies", pa.int64()), ("mask", pa.int32()), ("text", pa.string())]


def trie_pass(rows: DataFrame, duplicate: int, last: bool, flush: int | None = None) -> DataFrame:
    """Insert each partition's undecided rows (with id and text) in tries; flags go to the mask, decided rows lose their text."""
    fields = [*FIELDS, ("whole", pa.int32()), ("task", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, trie, out = TaskContext.get().partitionId(), RadixTrie(), []

        def packed(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) >= max(1, least):
                part = out[:OUT_ROWS]
                del out[:OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*part, strict=True), fields, strict=True)],
                                                 names=[n for n, _ in fields])

        def emptied(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
            for row in _flagged(trie, duplicate, last):
                out.append((*row, task))
                yield from packed(OUT_ROWS)

        for batch in batches:
            for doc_id, part, copies, mask, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if doc_id is None or text is None:
                    out.append((doc_id, part, copies, mask, None, None, task))
                else:
                    trie.insert(text, doc_id, (part, mask), copies)
            yield from packed(OUT_ROWS)
            if flush is not None and trie.chars > flush:
                yield from emptied(trie)
                trie = RadixTrie()
        yield from emptied(trie)
        yield from packed(1)

    return rows.select(*[n for n, _ in FIELDS]).mapInArrow(run, "doc_id bigint, part string, copies bigint, mask int, text string, whole int, task int")


def _length(level: Column | int) -> Column:
    return F.lit(FIRST) * F.pow(F.lit(2), level if isinstance(level, Column) else F.lit(level)).cast("int")


def _prefix_hash(level: Column | int) -> Column:
    return F.xxhash64(F.substring("text", F.lit(1), _length(level)))


def _ladder() -> Column:
    """Hashes of a text's prefixes, the shortest first, up to the whole text."""
    return F.transform(F.sequence(F.lit(0), F.col("whole")), lambda k: _prefix_hash(k))


def heavy_prefixes(undecided: DataFrame, limit: int) -> DataFrame:
    """Hashes of the prefixes whose texts weigh more than ``limit``: level, hash, whole (some text ends there), root (hash of the first level)."""
    ladder = undecided.select("whole", (F.char_length("text") + 1).alias("weight"), _prefix_hash(0).alias("root"), F.posexplode(_ladder()).alias("level", "hash"))
    return ladder.groupBy("level", "hash").agg(F.sum("weight").alias("weight"), F.max(F.col("level") == F.col("whole")).alias("whole"),
                                               F.min("root").alias("root")).where(F.col("weight") > limit)


def heavy_sets(heavy: DataFrame, slot: int = 8) -> DataFrame:
    """One hash table per heavy first prefix: an array of arrays, a deeper heavy hash in that at hash mod size.

    The levels are in it as well: a hash counts at its own level alone.
    """
    sizes = heavy.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / slot).cast("int").alias("n"))
    slots = heavy.join(sizes, "root").select("root", F.pmod("hash", "n").cast("int").alias("slot"), F.struct("level", "hash").alias("held")).union(
        sizes.select("root", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"), F.lit(None).cast("struct<level: int, hash: bigint>")))
    slots = slots.groupBy("root", "slot").agg(F.collect_list("held").alias("held"))
    return slots.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("slot", "held")))["held"].alias("table"))


def with_prefix(undecided: DataFrame, heavy: DataFrame, top: int) -> DataFrame:
    """Adds prefix_start, prefix_hash and hot (the whole text is heavy).  ``top``: the highest heavy level, -1 for none.

    One join on the first prefix, whatever the levels: a text goes as deep as it has heavy
    prefixes, which lie one in the other.
    """
    out = undecided.withColumn("depth", F.lit(0))
    if top >= 0:
        sets = F.broadcast(heavy_sets(heavy).withColumnRenamed("root", "at"))       # at most 4 * MAX_RANGES hashes a level

        def is_heavy(h, k):
            return F.array_contains(F.get("table", F.pmod(h, F.size("table")).cast("int")), F.struct(k.cast("int").alias("level"), h.alias("hash")))

        found = F.size(F.filter(F.transform(_ladder(), lambda h, k: is_heavy(h, k)), lambda x: x))
        out = undecided.join(sets, _prefix_hash(0) == F.col("at"), "left").withColumn("depth", F.when(F.col("at").isNull(), F.lit(0)).otherwise(found))
    prefix = F.substring("text", F.lit(1), _length(F.least("depth", "whole")))
    return out.select(*undecided.columns, (F.col("depth") > F.col("whole")).alias("hot"),
                      F.substring("text", F.lit(1), F.least(F.lit(KEY_CHARS), _length(F.least("depth", "whole")))).alias("prefix_start"),
                      F.xxhash64(prefix).alias("prefix_hash"))


def masks(docs: DataFrame, filters: list[Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          salts: int = SALTS, flush: int = FLUSH) -> DataFrame:
    """doc_id, part, mask, copies: the filters that rows fail (bit i: filter i; the bit after the last: a copy of a smaller id's text).

    ``filters`` are conditions on the columns ``text`` and ``words``.  The first pass is
    written to the checkpoint folder: the range bounds are drawn from it.
    """
    spark, duplicate = docs.sparkSession, 1 << len(filters)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{part_col}`").cast("string")).alias("part"),
                       F.lit(1).cast("long").alias("copies"), text_of(F.col(f"`{text_col}`")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)), F.lit(0)).cast("int")
    at = f"{checkpoint_dir(spark)}/filter-audit-{uuid.uuid4().hex}"
    trie_pass(rows.withColumn("mask", mask), duplicate, last=False, flush=flush).write.parquet(at)
    first = spark.read.parquet(at)
    undecided = first.where(F.col("text").isNotNull())
    chars = undecided.agg(F.sum(F.char_length("text") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / RANGE_CHARS))
    heavy_at = f"{at}-prefixes"
    heavy_prefixes(undecided, chars // (4 * min(parts, MAX_RANGES))).write.parquet(heavy_at)
    heavy = spark.read.parquet(heavy_at)
    top, any_hot = heavy.agg(F.coalesce(F.max("level"), F.lit(-1)), F.coalesce(F.max("whole"), F.lit(False))).first()
    keyed = with_prefix(undecided, heavy, top)
    last = keyed
    if any_hot:
        key = [F.col("prefix_hash"), F.pmod("task", F.lit(salts))]
        hot = trie_pass(keyed.where("hot").repartition(parts, *key), duplicate, last=False)
        # Rows that are decided go along without their text, spread by id.
        hot = hot.select(*first.columns, F.lit(True).alias("hot"), F.coalesce(F.substring("text", 1, KEY_CHARS), F.lit("")).alias("prefix_start"),
                         F.when(F.col("text").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")).alias("prefix_hash"))
        last = keyed.where(~F.col("hot")).unionByName(hot)
    ranged = trie_pass(last.repartitionByRange(parts, "prefix_start", "prefix_hash"), duplicate, last=True)
    out = ["doc_id", "part", "mask", "copies"]
    return first.where(F.col("text").isNull()).select(*out).unionByName(ranged.select(*out))


def interactions(counted: DataFrame, names: str, counts: dict[str, str]) -> DataFrame:
    """Every order and step from counts by part and mask.

    ``counted`` has part, mask, n and one column of each value of ``counts``; a result
    column named by its key sums that column over the removed.  Names are one character each.
    """
    k, bit = len(names), {c: 1 << i for i, c in enumerate(names)}
    steps = [{"filter_order": "".join(o), "step": i + 1, "own": bit[c], "earlier": sum(bit[x] for x in o[:i])}
             for o in permutations(names) for i, c in enumerate(o)]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, earlier: int>>")
    each = counted.select("*", F.inline(table))
    fails, before = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(condition: Column, value: Column | str = "n") -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("long")

    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        *[total(fails & ~before, c).alias(name) for name, c in counts.items()],
        # Among the filters that a document fails each comes first in an equal share of the orders.
        total(fails, F.expr(f"n * ({math.factorial(k)} div bit_count(mask))")).alias("shapley"))


def audit(docs: DataFrame, filters: dict[str, Column], duplicate: str, labels: DataFrame, marks: dict[str, Column],
          id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", salts: int = SALTS, flush: int = FLUSH) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, one column per mark, shapley.

    ``filters``: failure conditions on ``text`` and ``words`` by one-character name;
    ``duplicate``: the name of the copy filter; ``marks``: conditions on ``labels``, whose
    rows among the removed are counted.
    """
    names = "".join(filters) + duplicate
    if len(set(names)) != len(filters) + 1 or len(names) > 7:
        raise ValueError("names of filters are distinct single characters, 7 at most")
    failed = masks(docs, list(filters.values()), id_col, text_col, part_col, salts, flush)
    failed = failed.groupBy("doc_id", "part", "mask").agg(F.sum("copies").alias("n"))
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.coalesce(c, F.lit(False)).alias(f"mark{i}") for i, c in enumerate(marks.values())])
    marked = marked.groupBy("doc_id").agg(*[F.max(f"mark{i}").alias(f"mark{i}") for i in range(len(marks))])
    counted = failed.join(marked, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(f"mark{i}"), F.col("n")).otherwise(0)).alias(f"mark{i}") for i in range(len(marks))])
    return interactions(counted, names, {name: f"mark{i}" for i, name in enumerate(marks)})


def standard_filters() -> dict[str, Column]:
    """Failure conditions A to D: few words, few distinct words, many capitals, control signs."""
    text, w = F.col("text"), F.col("words")
    return {
        "A": F.size(w) < 200,
        "B": F.size(F.array_distinct(w)) * 100 < F.size(w) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }
