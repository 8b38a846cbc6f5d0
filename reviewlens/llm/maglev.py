"""Sharding by a permutation-filled lookup table (Maglev hashing).

Each shard has its own order of preference over the slots of a prime-sized table. The shards take turns; each claims
the first free slot in its order, until the table is full. A key's hash names a slot, the slot names the shard. Shards get
equal shares to within one slot, and removing a shard moves few other keys. The table has a fixed size and is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537   # prime; the bound of what is broadcast
DIGITS = 13


def preference(shard: str, size: int) -> tuple[int, int]:
    """(offset, skip) of the shard's permutation: slot j of its order is (offset + j * skip) mod size."""
    d = hashlib.md5(shard.encode()).hexdigest()
    return int(d[:8], 16) % size, int(d[8:16], 16) % (size - 1) + 1


def lookup_table(shards, size: int = TABLE_SIZE) -> np.ndarray:
    """Shard names by slot. Repeated names count once; names keep their given order for the turns."""
    names = list(dict.fromkeys(shards))
    if not names or len(names) > size:
        raise ValueError(f"need 1 to {size} shards, got {len(names)}")
    table = np.full(size, -1, dtype=np.int32)
    prefs = [preference(n, size) for n in names]
    at = [offset for offset, _ in prefs]
    filled = 0
    while filled < size:
        for i, (_, skip) in enumerate(prefs):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot] = i
            at[i] = (slot + skip) % size
            filled += 1
            if filled == size:
                break
    return np.array(names, dtype=object)[table]


def place(keys: DataFrame, table: np.ndarray, key_col: str = "doc_id") -> DataFrame:
    """``keys`` with ``slot`` and ``shard``; null keys go where an empty key goes. No shuffle: the table is broadcast."""
    digest = F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long"), F.lit(len(table))).cast("int")
    slots = keys.sparkSession.createDataFrame([(i, str(s)) for i, s in enumerate(table)], "slot int, shard string")
    return keys.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(slots), "slot", "left")
