"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table (an offset
and a step from digests of its name).  Shards take turns, each claiming the first free slot
of its order, until the table is full: shares differ by at most one slot, and when
a shard leaves few slots of the others change hands.  The table has ``prime`` rows,
whatever the data; it is broadcast, and a row's place is one lookup by key digest.

Defined results: a null key is placed as the empty key; equal keys share a shard; an
empty table gives an empty result; other columns pass through, unless they are named slot
or shard, which the results then replace.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def _digest(*parts: str) -> int:
    return int(hashlib.md5("|".join(parts).encode()).hexdigest(), 16)


def fill_table(shards, prime: int = PRIME) -> list[int]:
    """Number of the shard that owns each slot."""
    names = list(shards)
    if not names or len(set(names)) < len(names) or len(names) > prime:
        raise ValueError("shards must be distinct names, at least one and at most the table's size")
    if prime < 2 or any(prime % d == 0 for d in range(2, int(prime ** 0.5) + 1)):
        raise ValueError(f"table size {prime} is not prime")
    at = [_digest("offset", n) % prime for n in names]
    step = [_digest("step", n) % (prime - 1) + 1 if prime > 2 else 1 for n in names]
    table, left = [-1] * prime, prime
    while left:
        for i in range(len(names)):
            if not left:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % prime
            table[at[i]] = i
            left -= 1
    return table


def slot_of(key: Column, prime: int = PRIME) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the table's size."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(prime)).cast("int")


def place(df: DataFrame, key_col: str = "doc_id", shards=SHARDS, prime: int = PRIME) -> DataFrame:
    """Each row of ``df`` with its slot and shard."""
    names = list(shards)
    table = df.sparkSession.createDataFrame([(s, names[i]) for s, i in enumerate(fill_table(names, prime))], "at int, shard string")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), slot_of(F.col(f"`{key_col}`"), prime).alias("slot"))
    placed = rows.join(F.broadcast(table), F.col("slot") == F.col("at"))     # ``prime`` rows
    keep = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*keep, "slot", "shard")
