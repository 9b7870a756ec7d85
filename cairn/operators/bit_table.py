"""Tables of bits over keys, of a size that is bounded whatever the number of keys, to be sent to all tasks.

What is not set is surely no key; of what is set a few are none. Where keys are too many for the largest table more of
them are, so a table only spares work: what passes it is joined or compared exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of a table.
BUCKET = 1 << 15
#: Bits for a key, and bits at most (32 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 28


def size_for(keys: int, bits_a_key: int = BITS_A_KEY, most: int = MOST_BITS) -> int:
    """A power of two."""
    return min(most, max(BUCKET, 1 << (bits_a_key * keys).bit_length()))


def rows_of(places: DataFrame) -> DataFrame:
    """bucket, bits of the places (place: a long from 0) that are set."""
    at = F.col("place") + 1
    return places.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def collected(table: DataFrame, bits: int) -> np.ndarray:
    """The table as bytes, bit k of byte n for place 8 n + k; ``bits`` of it, however many keys there are."""
    out = np.zeros((bits // BUCKET, BUCKET // 8), np.uint8)
    got = table.toArrow()
    for bucket, row in zip(got.column("bucket").to_pylist(), got.column("bits").to_pylist()):
        out[bucket - 1] = np.frombuffer(row, np.uint8)
    return out.ravel()


def flagged(rows: DataFrame, key: str, keys: DataFrame, name: str, many: int | None = None) -> DataFrame:
    """Add ``name``: false for rows whose column ``key`` is surely none of the ``keys`` (a column of that name), or is null.

    ``many`` is the number of the keys, where it is known.
    """
    bits = size_for(keys.count() if many is None else many)

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    table = F.broadcast(rows_of(keys.select(place(key).alias("place"))).withColumnRenamed("bucket", "__bucket"))  # MOST_BITS at most
    asked = rows.withColumn("__at", place(key) + 1)
    asked = asked.withColumn("__bucket", F.bitmap_bucket_number("__at")).withColumn("__at", F.bitmap_bit_position("__at").cast("int"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("__at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("bits").isNotNull() & F.col(key).isNotNull() & (F.coalesce(F.getbit(byte, F.col("__at") % 8), F.lit(0)) == 1)
    return asked.join(table, "__bucket", "left").withColumn(name, hit).drop("__bucket", "bits", "__at")
