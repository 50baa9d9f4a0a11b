"""SimHash near-dedup with a bit-sliced comparison.

A fingerprint has one bit per bit of a 64-bit shingle hash: 1 where over half of the
shingles (repeats included) have it set.  Fingerprints link at ``max_bits`` or fewer
differing bits, and linked fingerprints form components.

Candidates: the 64 bits are cut into ``max_bits + 2`` blocks, and a key is any two of them.
Two fingerprints within the radius differ in at most ``max_bits`` blocks, so at least
two blocks agree and the pair shares a key (ten keys of 25 or 26 bits at radius 3).
Only distinct fingerprints are compared, so copies cost nothing.

Comparison: a task takes whole cells of fingerprints that share a key, about ``TILE``
rows at a time.  The tile is stored vertically, one bit vector per bit plane.  A group
of queries is xored with the planes of its own and the later lanes one after another; two
carry-save bit counters and a sticky overflow hold all distances at once, and a block (the
group against 64 lanes) is abandoned when every distance has passed the radius.  Within a tile links become a
spanning forest, so no more rows leave a task than enter it.

A key shared by more than ``CHUNK`` fingerprints is cut into chunks by hash, and each pair
of chunks is a cell of its own: every pair of fingerprints meets in some cell, none of
which grows with the key.

Components: alternating large-star and small-star rounds over the edges, checkpointed.

Defined results: a null text is empty; a text of fewer words than a shingle is one
shingle; without words the fingerprint is zero.  Null ids rank below all others and are
never a component's id unless all its ids are null.  Repeated rows share one result
each.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import fan_out, keep_rows, row_key, salt_of
from cartwise.session import cut_lineage

SHINGLE = 3
MAX_BITS = 3
SEED = 42
CHUNK = 1024
TILE = 1024
QUERIES_AT_ONCE = 256     # a multiple of 64
SALTS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one whole text."""
    found = (text or "").encode().lower().split()   # bytes: lowers A-Z only, splits at the six ASCII blanks only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    last = ends[-n:]
    set_bits, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, n, step):
        spans = zip(starts[at:at + step][:n - at].tolist(), last[at:at + step].tolist(), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """doc_id, key (of the row), fp (signed long); written once, as its texts are read by Python."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    return cut_lineage(df.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("key"), of(text).alias("fp")))


def block_masks(max_bits: int) -> list[int]:
    """Masks of the keys: every two of ``max_bits + 2`` blocks, as signed longs."""
    edges = [round(i * 64 / (max_bits + 2)) for i in range(max_bits + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (x | y for x, y in combinations(blocks, 2))]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row k holds bit k of all fingerprints, 64 of them to a word."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, max_bits: int, skip: np.ndarray | None = None,
           work: list[int] | None = None) -> np.ndarray:
    """Bit matrix (query, word of lanes): 1 where the distance is at most ``max_bits`` (which is below 4).

    Lanes set in ``skip`` (of the result's shape) are not asked for.  A block is the queries
    against one word of 64 lanes; it is abandoned once each lane asked for is beyond the radius.
    ``work`` gets the number of blocks still compared at each plane.
    """
    near = np.zeros((len(queries), planes.shape[1]), np.uint64)
    over = np.zeros_like(near) if skip is None else skip.copy()
    ones, twos, blocks = np.zeros_like(near), np.zeros_like(near), np.arange(planes.shape[1])
    for k in range(64):
        flip = -((queries >> np.uint64(k)) & np.uint64(1)).astype(np.int64)     # all ones where the query's bit is set
        x = planes[k][None, :] ^ flip.view(np.uint64)[:, None]
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if work is not None:
            work.append(len(blocks))
        if k % 8 == 7:
            open_blocks = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=0)
            if not open_blocks.all():
                planes, blocks = planes[:, open_blocks], blocks[open_blocks]
                ones, twos, over = ones[:, open_blocks], twos[:, open_blocks], over[:, open_blocks]
                if not len(blocks):
                    return near
    found = ~over
    for d in range(max_bits + 1, 4):               # counts that fit two bits but not the radius
        found &= ~((ones if d & 1 else ~ones) & (twos if d & 2 else ~twos))
    if skip is not None:
        found &= ~skip[:, blocks]
    near[:, blocks] = found
    return near


def earlier_lanes(queries: int, at: int, n: int) -> np.ndarray:
    """Bit matrix of the lanes from ``at`` on that query at + i need not meet: itself, those before it, those past ``n``."""
    lanes = np.arange(-(-(n - at) // 64) * 64)
    skip = (lanes[None, :] <= np.arange(queries)[:, None]) | (lanes >= n - at)[None, :]
    return np.packbits(skip, axis=1, bitorder="little").view(np.uint64)


def forest(fps: np.ndarray, max_bits: int, work: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Edges that join the fingerprints of a tile as its links do, at most one per fingerprint.

    Each group of queries meets itself and the later fingerprints alone.
    """
    n, planes, root = len(fps), planes_of(fps), np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, n, QUERIES_AT_ONCE):
        queries = fps[at:at + QUERIES_AT_ONCE]
        near = within(queries, planes[:, at // 64:], max_bits, earlier_lanes(len(queries), at, n), work)
        for i in np.flatnonzero(near.any(axis=1)):
            for j in np.flatnonzero(np.unpackbits(near[i].view(np.uint8), bitorder="little")[:n - at]):
                a, b = find(at + i), find(at + j)
                if a != b:
                    root[b] = a
                    yield at + i, at + j


def cell_edges(max_bits: int):
    """For mapInPandas over rows sorted by cell: whole cells in tiles, their forests out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def compared(cells, fps):
            out = []
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            start = 0
            for a, b in zip(cuts[1:], [*cuts[2:], None], strict=False):
                if b is None or b - start > TILE:      # the next cell would not fit
                    tile = np.unique(fps[start:a])
                    edges = list(forest(tile.view(np.uint64), max_bits))
                    if edges:
                        i, j = np.array(edges).T
                        out.append(pd.DataFrame({"u": tile[i], "v": tile[j]}))
                    start = a
            return out

        cells, fps = np.empty((0,), "int64"), np.empty((0,), "int64")
        for batch in batches:
            cells = np.concatenate([cells, batch["cell"].to_numpy("int64")])
            fps = np.concatenate([fps, batch["fp"].to_numpy("int64")])
            if len(cells) and (done := int(np.searchsorted(cells, cells[-1], "left"))):   # the last cell may go on
                yield from compared(cells[:done], fps[:done])
                cells, fps = cells[done:], fps[done:]
        if len(cells):
            yield from compared(cells, fps)
    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK, salts: int = SALTS) -> DataFrame:
    """Edges (u, v) that join the fingerprints in ``distinct`` (column fp) as all links do."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the two-bit counters hold a radius of at most 3")
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(block_masks(max_bits))])
    rows = distinct.select("fp", F.explode(masks).alias("x")).select(
        "fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = fan_out(rows.withColumn("salt", salt_of(F.col("fp"), salts=salts)), sizes, ["t", "key"])
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    rows = rows.select("fp", "t", "key", chunks.alias("chunks"), F.pmod(F.xxhash64(F.lit("chunk"), "fp"), chunks).cast("int").alias("mine"))
    # Chunk i meets chunk j in the cell (min, max); a key of one chunk is one cell.
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("mine")))
    rows = rows.withColumn("other", F.explode(others)).select(
        "fp", F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "cell").sortWithinPartitions("cell")
            .mapInPandas(cell_edges(max_bits), "u long, v long"))


def components(edges: DataFrame, salts: int = SALTS) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that have an edge."""
    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def both_ways(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both.withColumn("salt", salt_of(F.col("v"), salts=salts))

    edges = cut_lineage(edges.where("u <> v").distinct())
    seen = state(edges)
    while seen[0]:
        both = both_ways(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = fan_out(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        down = cut_lineage(down)
        salted = down.withColumn("salt", salt_of(F.col("v"), salts=salts))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = fan_out(salted, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut_lineage(small)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(
        F.min("root").alias("root"))


def classes(prints: DataFrame, max_bits: int = MAX_BITS, salts: int = SALTS) -> DataFrame:
    """``prints`` (doc_id, key, fp) with component_id, the smallest doc_id reachable."""
    prints = prints.withColumn("salt", salt_of(F.col("key"), salts=salts))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, max_bits, salts=salts), salts)
    nodes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")).withColumn("salt", salt_of(F.col("fp"), salts=salts))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = fan_out(nodes, least, ["root"]).select("fp", "component_id", "root")
    return fan_out(prints, of_fp, ["fp"]).select("doc_id", "key", "fp", "component_id", "root")


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    found = classes(fingerprints(df, id_col, text_col, shingle, seed), max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One whole row of each component: that with the smallest id (null ids last, ties by the key)."""
    found = classes(fingerprints(df, id_col, text_col, shingle, seed), max_bits)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    winners = found.groupBy("root").agg(F.min_by("key", order).alias("key")).select("key").distinct()
    return keep_rows(df, row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), winners)
