"""Placement of keys on shards by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own, (offset + j * skip) mod size, with offset and skip hashed
from its name. The shards take turns: each claims the first slot of its order that is still free, until the table is full. So shards hold
almost equal numbers of slots, and when a shard leaves or joins, few slots change hands apart from its own.

The table has one row a slot. Its size is a parameter, whatever the data, so it is broadcast, and a key is placed by one hash and one
lookup, without a shuffle. A hot key or source is a matter of the keys chosen: ids spread it evenly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SIZE = 6421  # a prime, about a hundred slots a shard


def _number(name: str, part: int) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[8 * part:8 * part + 8], 16)


def fill(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> list[int]:
    """The shard number of each slot. Names must differ; the size must be a prime and at least the number of shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need different names, one at least")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the size must be a prime, and at least the number of shards")
    wish = [_number(name, 0) % size for name in shards]
    skip = [_number(name, 1) % (size - 1) + 1 for name in shards]
    table, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            while table[wish[shard]] >= 0:
                wish[shard] = (wish[shard] + skip[shard]) % size
            table[wish[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard): `size` rows."""
    return spark.createDataFrame([(slot, shards[shard]) for slot, shard in enumerate(fill(shards, size))], "slot long, shard string")


def slot_of(key: str, size: int = SIZE) -> str:
    """SQL text: the slot of a key, by its text. A null key is placed like an empty one."""
    return f"pmod(cast(conv(substr(md5(cast(coalesce(cast({key} as string), '') as binary)), 1, 8), 16, 10) as long), {size})"


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """(key, slot, shard) for every row of `rows`: repeated keys are placed alike, and no other column is read."""
    return (rows.selectExpr(f"`{key}`", f"{slot_of(f'`{key}`', size)} as slot")
            .join(F.broadcast(lookup_table(rows.sparkSession, shards, size)), "slot").select(key, "slot", "shard"))
