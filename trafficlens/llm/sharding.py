"""Placement of rows on shards by a lookup table that is filled in turns.

Every shard has an order of preference over the slots of a table of prime size, a permutation from two hashes of its name.
The shards take turns, each claiming the first slot of its order that is still free, until the table is full: shares differ by
at most one slot, and when a shard leaves or joins, few slots change hands besides its own. A row's slot is a hash of its key; the
table has as many rows as slots, whatever the data, so it is broadcast, and placing a row is one lookup, without a shuffle.

Defined cases: a null key is placed like the empty text. Equal keys go to one shard, also in repeated rows. Other columns are
handed through; ``slot`` and ``shard`` replace columns of those names. Repeated names of shards count once; no shard is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; a hundred slots or more per shard keep the shares even after changes.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def fill(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The position in sorted(set(shards)) of the shard of every slot; ``slots`` must be prime."""
    names = sorted(set(shards))
    if not names or len(names) > slots:
        raise ValueError("there must be shards, and no more than slots")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [xxhash.xxh64_intdigest(n, seed=1) % slots for n in names]
    step = [xxhash.xxh64_intdigest(n, seed=2) % (slots - 1) + 1 for n in names]
    table = np.full(slots, -1, dtype=np.int64)
    owner = table.tolist()
    for turn in range(slots):
        k = turn % len(names)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        owner[at[k]] = k
    return np.array(owner, dtype=np.int64)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots))


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """slot and shard, one row per slot."""
    names = sorted(set(shards))
    rows = [(i, names[k]) for i, k in enumerate(fill(shards, slots).tolist())]
    return spark.createDataFrame(rows, "slot long, shard string")


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with slot and shard."""
    plain = df.drop(*[c for c in ("slot", "shard") if c != key])
    keyed = plain.withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot").select(*plain.columns, "slot", "shard")
