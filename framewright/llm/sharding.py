"""Placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: offset + j * skip (mod size), both drawn from
hashes of its name. The shards take turns; each claims the next slot of its order that is still free, until the table is full.
Shares differ by at most one slot, and when a shard goes only a few other slots change hands. A key hashes to a slot, and the
broadcast table, whose size is a constant, gives its shard: no shuffle, no skew by key, constant work per row.

Edge cases: a null key takes the hash of the empty text; repeated rows and ties go to one place; an empty input gives no rows;
names must be distinct and at most as many as slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it. A few hundred thousand steps at any data size."""
    if len(set(names)) != len(names) or not 0 < len(names) <= slots:
        raise ValueError("names must be distinct, at least one and at most one per slot")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    draw = lambda n, salt: int.from_bytes(hashlib.sha256(f"{salt}:{n}".encode()).digest()[:8], "big")
    at = [draw(n, "offset") % slots for n in names]
    skip = [draw(n, "skip") % (slots - 1) + 1 for n in names]
    owner, free = [-1] * slots, slots
    while free:
        for s in range(len(names)):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            owner[at[s]] = s
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table size."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
    return (bits.cast("long") % slots).cast("int")


def place(rows: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows with ``slot`` and ``shard`` (an index into ``names``) in a struct ``placed``."""
    if "placed" in rows.columns:
        raise ValueError("the rows have a column placed already")
    seats = rows.sparkSession.createDataFrame(list(enumerate(lookup_table(names, slots))), "slot int, shard int")
    seats = seats.select(F.col("slot").alias("__slot"), F.struct("slot", "shard").alias("placed"))
    boxed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"),
                        slot_of(F.col(f"`{key}`"), slots).alias("__at"))
    return boxed.join(F.broadcast(seats), F.col("__at") == F.col("__slot"), "left").select("__row.*", "placed")
