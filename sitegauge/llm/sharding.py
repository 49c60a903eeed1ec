"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table, given by an offset and a stride taken from
its name. Shards take turns and claim the first free slot of their order, so all get the same number of slots (give or
take one), and adding or removing a shard moves few slots. A row looks up the slot of its hashed key: one hash and one
probe of a broadcast table, and no row is shuffled.

Defined cases: a null key is hashed as a value of its own, equal keys go to one shard, an empty table gives an empty
table, an input column called ``slot`` or ``shard`` is replaced, no shards or a table smaller than the shards is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_table
from .common import key_text

MAX_TABLE = 1 << 20  # slots; the broadcast table stays below 16 MB


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and stride of a shard's walk over the slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def permutation_table(shards: list[str], size: int) -> list[int]:
    """Index of the owning shard for each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and distinct")
    if not is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_TABLE}")
    orders = [preference(s, size) for s in shards]
    owner, step, filled = [-1] * size, [0] * len(shards), 0
    while True:
        for shard, (offset, stride) in enumerate(orders):
            slot = (offset + step[shard] * stride) % size
            while owner[slot] >= 0:
                step[shard] += 1
                slot = (offset + step[shard] * stride) % size
            owner[slot] = shard
            step[shard] += 1
            filled += 1
            if filled == size:
                return owner


def slot_of(key: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(key_text(key)), 1, 15), 16, 10).cast("bigint") % size).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (the name) appended."""
    table = small_table(
        df.sparkSession, [(slot, shards[i]) for slot, i in enumerate(permutation_table(shards, size))], "slot int, shard string"
    )
    kept = df.drop("slot", "shard")
    keyed = kept.withColumn("slot", slot_of(F.col(key), size))
    return keyed.join(F.broadcast(table), "slot", "left").select(*[F.col(f"`{c}`") for c in kept.columns], "slot", "shard")
