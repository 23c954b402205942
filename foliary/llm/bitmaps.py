"""Bit maps of bounded size over 64-bit hashes: a filter at the scan, whatever the table.

A map has 2**24 bits (2 MB) unless asked for more. It lets through every wanted value and, by chance, some
others, so what it filters is joined or grouped exactly afterwards. It comes to the driver in rows of 4 KB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, MOST_BITS = 24, 27


def bits_for(values: int) -> int:
    """Bits for a map that at most one in 16 other values passes, up to 2**27 (16 MB)."""
    return min(MOST_BITS, max(16, (16 * max(1, values) - 1).bit_length()))


def bitmap(frame: DataFrame, value: Column, bits: int = BITS) -> np.ndarray:
    """The map of a column of 64-bit hashes, by their leading bits."""
    bit = F.shiftrightunsigned(value, 64 - bits) + 1  # these functions number from 1
    rows = frame.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place")).groupBy("bucket").agg(
        F.bitmap_construct_agg("place").alias("bits")
    ).collect()
    out, size = np.zeros(1 << (bits - 3), np.uint8), 1 << 12  # bytes of one bucket
    for bucket, own in rows:
        out[(bucket - 1) * size : bucket * size] = np.frombuffer(bytes(own), np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    place = (hashes.view(np.uint64) >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7)) & 1 == 1
