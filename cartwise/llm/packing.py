"""Best-fit packing of tokenized documents with a swap-based local search.

A document becomes its token ids and an end id.  One of more than ``capacity`` tokens is
cut into full pieces behind a first piece that holds the rest.  Full pieces are sequences
of their own; the others are dealt at random over shards of about ``SHARD_ITEMS`` pieces,
so a task's work is bounded at any input and each shard sees the same mix of sizes.

In a shard, best fit decreasing sets the start.  The local search then visits the bins
that are not full, fullest first, and lets each gain from a bin that is not fuller: a
move (a piece comes over), one for one (a larger piece for a smaller), one for two
(one piece for two smaller ones) or two for one (two pieces of one bin for one
smaller piece).  The step that fills the bin most is taken, from the emptiest bin that
allows it, so the emptiest run empty and are gone.  All sizes and pair sums of unfull bins
are indexed and kept up as bins change; nothing is left out.  Each accepted step raises
the sum of squared fills, and the search goes on until no bin can gain.

Tokenizing: the ids are those of the tokenizers library for the given JSON file.  Where that
file is a plain byte-level BPE whose ids follow the merge order, tiktoken computes the same
ids from the same vocabulary several times faster; other files, texts that hold a special
token's text and texts with huge blank runs (which overflow its pattern's stack) go
through tokenizers itself.

Defined results: a null text is empty and becomes one piece of the end id alone; null
ids stay null; repeated rows are packed each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import cut_lineage

try:
    import tiktoken
except ModuleNotFoundError:      # tokenizers alone does the same, slower
    tiktoken = None

CAPACITY = 2048
END_ID = 0
SHARD_ITEMS = 20_000
BLANK_BLOCK = 50_000

# Fixed value: the word pattern of the byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 signs stand for themselves, other bytes for signs from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks(tokenizer_json: str) -> dict[bytes, int] | None:
    """Token ids by bytes if they alone fix the merges; None for any other kind of tokenizer.

    They do when the vocabulary is the 256 bytes and one token per merge, in merge order.
    """
    spec = json.loads(tokenizer_json)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if spec["normalizer"] or spec["truncation"] or any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    signs, vocab = byte_signs(), model["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)) or len(vocab) != len(signs) + len(merged):
        return None
    if any(s not in vocab for s in signs) or max(vocab[s] for s in signs) > min(merged, default=len(vocab)):
        return None
    return {bytes(signs[c] for c in token): i for token, i in vocab.items()}


class TextEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark deals out the cores
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        by_bytes = ranks(tokenizer_json)
        self.fast = by_bytes and tiktoken and tiktoken.Encoding("by_bytes", pat_str=WORDS, mergeable_ranks=by_bytes, special_tokens={})

    def plain(self, text: str) -> bool:
        """No special token's text and no run of 2 * BLANK_BLOCK blanks (one would fill a block)."""
        return not any(s in text for s in self.specials) and not any(
            text[i:i + BLANK_BLOCK].isspace() for i in range(0, len(text) - BLANK_BLOCK + 1, BLANK_BLOCK))

    def __call__(self, text: str) -> bytes:
        if self.fast and self.plain(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, TextEncoder] = {}


def encoder(tokenizer_json: str) -> TextEncoder:
    """One encoder per worker process and tokenizer."""
    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = TextEncoder(tokenizer_json)
    return _encoders[name]


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: the first may be shorter, the others are full."""
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    ``tokenizer`` is the path of a tokenizers JSON file, read on the driver and sent to the tasks.
    """
    with open(tokenizer, encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text or "") + end
                for i, (start, length) in enumerate(spans(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, i, start, length, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype("int32")] if with_ids else [])))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype(object).where(out["doc_id"].notna(), None)
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if kind in ("tinyint", "smallint", "int", "bigint"):     # pandas would read integers with nulls as floats
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
        schema = schema.replace(f"doc_id {kind}", "doc_id string", 1)
    return rows.mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


class Givers:
    """Unfull bins by a size they can give, the emptiest first.

    A bin is listed again whenever it changes; entries of its earlier states are dropped when met.
    """

    def __init__(self, capacity: int, version: list[int]):
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.version = version
        self.mask = 0                    # bit s is set while some bin is listed under size s

    def add(self, size: int, fill: int, b: int) -> None:
        heapq.heappush(self.heaps[size], (fill, b, self.version[b]))
        self.mask |= 1 << size

    def emptiest(self, size: int, target: int) -> int | None:
        """The emptiest bin other than ``target`` that can give ``size``."""
        heap, own = self.heaps[size], None
        while heap and (self.version[heap[0][1]] != heap[0][2] or heap[0][1] == target):
            entry = heapq.heappop(heap)
            if self.version[entry[1]] == entry[2]:
                own = entry
        found = heap[0][1] if heap else None
        if own:
            heapq.heappush(heap, own)
        if not heap:
            self.mask &= ~(1 << size)
        return found


class Shard:
    """Bins of one shard: pieces by number, the fill of each bin, and what unfull bins can give."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.best_fit()
        self.version = [0] * len(self.bins)
        self.singles, self.pairs = Givers(capacity, self.version), Givers(capacity, self.version)

    def best_fit(self) -> None:
        rooms: list[list[int]] = [[] for _ in range(self.capacity + 1)]    # bins by room left
        open_rooms = 0                                                     # bit r is set while a bin has room r
        for i in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            size = self.sizes[i]
            tight = open_rooms >> size
            if tight:
                room = size + (tight & -tight).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    open_rooms ^= 1 << room
            else:
                b, room = len(self.bins), self.capacity
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(i)
            self.fill[b] += size
            rooms[room - size].append(b)
            open_rooms |= 1 << (room - size)

    def given(self, b: int) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
        """One piece of each size in the bin, and one pair of each sum (at most 2,016 at 2,048 tokens)."""
        of_size: dict[int, list[int]] = {}
        for i in self.bins[b]:
            of_size.setdefault(self.sizes[i], []).append(i)
        order = sorted(of_size)
        pairs = {}
        for k, x in enumerate(order):
            if len(of_size[x]) > 1:
                pairs.setdefault(2 * x, (of_size[x][0], of_size[x][1]))
            for y in order[k + 1:]:
                pairs.setdefault(x + y, (of_size[x][0], of_size[y][0]))
        return {x: (of_size[x][0],) for x in order}, pairs

    def enlist(self, b: int) -> None:
        self.version[b] += 1
        if 0 < self.fill[b] < self.capacity:
            singles, pairs = self.given(b)
            for size in singles:
                self.singles.add(size, self.fill[b], b)
            for size in pairs:
                self.pairs.add(size, self.fill[b], b)

    def giver(self, of: Givers, low: int, high: int, target: int) -> tuple[int, int] | None:
        """The largest size with low < size <= high, and the emptiest bin that gives it, if not fuller than ``target``."""
        window = of.mask & ((1 << (min(high, self.capacity) + 1)) - 1)
        while window:
            size = window.bit_length() - 1
            if size <= low:
                return None
            b = of.emptiest(size, target)
            if b is not None and self.fill[b] <= self.fill[target]:
                return size, b
            window ^= 1 << size
        return None

    def improve(self, target: int) -> bool:
        """Make the step that raises ``target``'s fill most; False if there is none."""
        room = self.capacity - self.fill[target]
        singles, pairs = self.given(target)
        best, step = 0, None
        for give, back, of in [(0, (), self.singles), *((x, i, self.singles) for x, i in singles.items()),
                               *((x, i, self.singles) for x, i in pairs.items()),
                               *((x, i, self.pairs) for x, i in singles.items())]:
            hit = self.giver(of, give + best, give + room, target)
            if hit:
                best, step = hit[0] - give, (of, *hit, back)
                if best == room:
                    break
        if step is None:
            return False
        of, size, other, back = step
        take = self.given(other)[of is self.pairs][size]
        for moved, was, to in ((take, other, target), (back, target, other)):
            for i in moved:
                self.bins[was].remove(i)
                self.bins[to].append(i)
        self.fill[target] += best
        self.fill[other] -= best
        self.enlist(target)
        self.enlist(other)
        return True

    def search(self, rounds: int | None = None) -> None:
        """Visit the unfull bins, fullest first, in ``rounds`` rounds; None: until no bin can gain."""
        unfull = [b for b in range(len(self.bins)) if self.fill[b] < self.capacity]
        for b in unfull if rounds != 0 else []:
            self.enlist(b)
        steps, done = True, 0
        while steps and done != rounds:
            steps, done = False, done + 1
            unfull = sorted((b for b in unfull if 0 < self.fill[b] < self.capacity), key=lambda b: -self.fill[b])
            for b in unfull:
                while 0 < self.fill[b] < self.capacity and self.improve(b):
                    steps = True


def pack_sizes(sizes: list[int], capacity: int = CAPACITY, rounds: int | None = None) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece."""
    shard = Shard(sizes, capacity)
    shard.search(rounds)
    number, offset, n = [0] * len(sizes), [0] * len(sizes), 0
    for items in shard.bins:
        at = 0
        for i in items:
            number[i], offset[i] = n, at
            at += sizes[i]
        n += bool(items)
    return number, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, rounds: int | None = None) -> DataFrame:
    """``cut`` (any columns with ``length`` up to ``capacity``) with sequence_id and offset."""
    cut = cut_lineage(cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")))
    full = cut.where(F.col("length") >= capacity).withColumn(
        "sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62))
    rest = cut.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_items))

    def one(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        number, offset = pack_sizes(shard["length"].tolist(), capacity, rounds)
        base = int(key[0]) << 32
        return shard.assign(sequence_id=[base + n for n in number], offset=offset)[names]

    names = cut.columns
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    dealt = rest.select(F.struct("*").alias("row"), shard).select("row.*", "shard")
    texts = [f for f in cut.schema.fields if f.name == "doc_id" and f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")]
    for f in texts:
        dealt = dealt.withColumn(f.name, F.col(f.name).cast("string"))
    schema = dealt.drop("shard").schema
    packed = dealt.groupBy("shard").applyInPandas(one, schema)
    for f in texts:
        packed = packed.withColumn(f.name, F.col(f.name).cast(f.dataType))
    return packed.unionByName(full)


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with ids: sequence_id, ids, n_tokens, documents."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.aggregate("parts.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
        F.size("parts").alias("documents"))
