"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: from a
first slot on in steps, both hashes of its name.  Shards take turns; each claims its next
free slot until none is left.  So every shard owns the same number of slots, give or take
one, and a shard that comes or goes moves few other slots.  A key is placed by the slot its
hash falls on: one look into a table of fixed size, which is broadcast; no shuffle.

Defined results: a null key is placed by a hash of the row's other plain columns, so that
rows without a key spread; equal keys share a shard; an empty table gives an empty result.
Columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, some thousand times the number of shards.
TABLE_SIZE = 65_537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The number of the shard that owns each slot."""
    if not is_prime(size) or len(shards) > size or len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must have different names, and the table a prime size of at least their number")
    first = [_hash(x, "first") % size for x in shards]
    step = [_hash(x, "step") % (size - 1) + 1 for x in shards]
    owner = np.full(size, -1, np.int32)
    place = list(first)
    for turn in range(size):
        shard = turn % len(shards)
        while owner[place[shard]] >= 0:
            place[shard] = (place[shard] + step[shard]) % size
        owner[place[shard]] = shard
    return owner


def place(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """All columns, and ``slot`` and ``shard`` (the shard's name)."""
    owner = lookup_table(shards, size)
    table = df.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(owner.tolist())], "slot int, shard string")
    plain = [f"`{f.name}`" for f in df.schema if f.name not in ("slot", "shard", key) and f.dataType.typeName() not in ("map", "variant")]
    hashed = F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.lit(1), F.col(f"`{key}`"))).otherwise(F.xxhash64(F.lit(2), *plain))
    kept = [f"`{c}`" for c in df.columns if c not in ("slot", "shard")]
    slotted = df.withColumn("_slot", F.pmod(hashed, F.lit(size)).cast("int")).select(*kept, F.col("_slot").alias("slot"))
    return slotted.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def write(df: DataFrame, path: str) -> None:
    """One folder a shard."""
    df.write.partitionBy("shard").parquet(path)
