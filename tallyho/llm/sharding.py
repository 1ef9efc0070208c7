"""Operator 4, sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table, a
walk ``offset + i * skip`` that visits every slot.  The shards take turns; at its turn
a shard claims the next slot of its order that is still free.  A key's slot is its hash
modulo the table size, so placing a row is one look-up in a broadcast table of
fixed size.  When a shard goes, its slots are shared by the others and nearly all
other slots stay as they were.

Defined results
* Every input row is returned once, also repeated rows; equal keys share a shard
  unless ``max_rows`` splits them.
* A null key has the hash of null and is placed like any other.
* With ``max_rows`` a key with more rows than that is dealt over
  ceil(rows / max_rows) sub-keys, so a key that holds a third of all rows does not
  land in one shard.
* ``slot`` and ``shard`` replace columns of these names.  Empty input gives empty output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.llm._join import attach
from tallyho.session import materialize

#: Slots of the table, a prime; it bounds the broadcast table whatever the data are.
SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, slots: int) -> np.ndarray:
    """A shard's order over the slots; as the size is prime, any skip visits all."""
    digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
    offset = int.from_bytes(digest[:8], "little") % slots
    skip = int.from_bytes(digest[8:], "little") % (slots - 1) + 1
    return (offset + np.arange(slots, dtype=np.int64) * skip) % slots


def fill_table(shards: Sequence[str], weights: Sequence[float] | None = None, slots: int = SLOTS) -> np.ndarray:
    """Shard index of every slot.

    ``weights`` (1 each if None): at every round a shard earns its weight divided by the
    largest and takes a turn for each whole unit earned.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(slots) or slots <= len(shards):
        raise ValueError("slots must be a prime above the number of shards")
    weights = [1.0] * len(shards) if weights is None else list(weights)
    if len(weights) != len(shards) or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be one non-negative number per shard, one positive at least")
    orders = [preference(s, slots).tolist() for s in shards]
    table, seen, earned = [-1] * slots, [0] * len(shards), [0.0] * len(shards)
    free = slots
    while True:
        for k, order in enumerate(orders):
            earned[k] += weights[k] / max(weights)
            while earned[k] >= 1.0:
                earned[k] -= 1.0
                while table[order[seen[k]]] >= 0:
                    seen[k] += 1
                table[order[seen[k]]] = k
                free -= 1
                if not free:
                    return np.array(table, dtype=np.int32)


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], weights: Sequence[float] | None = None,
          slots: int = SLOTS, max_rows: int | None = None) -> DataFrame:
    """Add ``slot`` and ``shard`` (a name of ``shards``) by the hash of ``keys``."""
    spark = df.sparkSession
    names = fill_table(shards, weights, slots)
    table = spark.createDataFrame(
        [(i, shards[k]) for i, k in enumerate(names.tolist())], "__sh_slot long, shard string")
    df = df.drop("slot", "shard")
    hashed = [F.col(k) for k in keys]
    if max_rows:
        hot = materialize(df.groupBy(*keys).agg(F.count("*").alias("__sh_rows")).where(F.col("__sh_rows") > max_rows)
                          .select(*keys, F.ceil(F.col("__sh_rows") / max_rows).cast("int").alias("__sh_parts")))
        rest = [c for c in df.columns if c not in keys]
        salt = F.pmod(F.xxhash64(*rest) if rest else F.monotonically_increasing_id(),
                      F.coalesce("__sh_parts", F.lit(1))).cast("int")
        df = attach(df, hot, list(keys), "left").withColumn("__sh_salt", salt)
        hashed.append(F.when(F.col("__sh_salt") > 0, F.col("__sh_salt")))
    slot = F.pmod(F.xxhash64(*hashed), F.lit(slots)).alias("slot")
    placed = df.select("*", slot).join(F.broadcast(table), F.col("slot") == F.col("__sh_slot"))
    return placed.drop("__sh_slot", "__sh_parts", "__sh_salt")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write one folder per shard."""
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
