"""Shard placement through a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by its own preference (an offset and a
stride from its name's hash); shards take turns claiming their best free slot until the table
is full. A row's slot is a hash of its key, so placement is one lookup in a broadcast table of
fixed size. Shards differ by one slot at most, and when one joins or leaves few other slots
change hands.

Defined results: rows with equal keys share a shard, repeated rows included; a row whose key
columns are all null is placed by the hash of its whole row, so that such rows don't meet in
one shard; input columns named ``slot`` or ``shard`` are replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
#: The table is broadcast, so its size is bounded (16 bytes a slot).
LARGEST_TABLE = 2_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The number of the shard that owns each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(size) or not len(shards) <= size <= LARGEST_TABLE:
        raise ValueError(f"size must be a prime from the number of shards to {LARGEST_TABLE}")
    at = [xxhash.xxh64_intdigest(s, 1) % size for s in shards]
    stride = [xxhash.xxh64_intdigest(s, 2) % (size - 1) + 1 for s in shards]
    owner = np.full(size, -1, dtype=np.int32)
    for turn in range(size):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + stride[k]) % size
        owner[at[k]] = k
    return owner


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, without a shuffle."""
    owner = lookup_table(shards, size)
    rows = [(slot, shards[k]) for slot, k in enumerate(owner.tolist())]
    table = df.sparkSession.createDataFrame(rows, "slot int, shard string")
    no_key = F.lit(True)
    for k in keys:
        no_key = no_key & F.col(k).isNull()
    place = F.when(no_key, F.xxhash64(*df.columns)).otherwise(F.xxhash64(*keys))
    placed = df.withColumn("slot", F.pmod(place, F.lit(size)).cast("int")).drop("shard")
    return placed.join(F.broadcast(table), "slot")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder of Parquet for each shard; rows are salted so that a shard may span several tasks."""
    salt = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
