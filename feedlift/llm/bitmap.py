"""A set of hashes as a bitmap of fixed size: what a map side may drop before a shuffle.

Each hash sets two bits. The bitmap has ``2**BITS`` bits whatever the size of the set, so broadcasting it is bounded. A hash
that is missing in it is not in the set; one that is there may or may not be, and goes on to the
join that decides. A set too large for the bitmap drops less and loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25
_LAST = (1 << BITS) - 1


def bitmap_of(hashes: DataFrame, column: str) -> Broadcast:
    """Bits of all values of a long column; of the rows to the driver there are at most ``2**BITS / 64``."""
    low, high = F.col(column).bitwiseAND(F.lit(_LAST)), F.shiftrightunsigned(column, 64 - BITS)
    words = (
        hashes.select(F.explode(F.array(low, high)).alias("place"))
        .groupBy(F.shiftright("place", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toPandas()
    )
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return hashes.sparkSession.sparkContext.broadcast(bits.tobytes())


def maybe_in(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """False where a hash (uint64) is not in the set."""
    words = np.frombuffer(bitmap, np.uint64)

    def at(place: np.ndarray) -> np.ndarray:
        return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0

    found = at(hashes & np.uint64(_LAST))
    rest = np.flatnonzero(found)
    found[rest] = at(hashes[rest] >> np.uint64(64 - BITS))
    return found


def possible(bitmap: Broadcast, hashes: Column | str) -> Column:
    """The same as a column, of a column of longs that is never null."""

    def test(values: pa.Array) -> pa.Array:
        return pa.array(maybe_in(bitmap.value, values.to_numpy(zero_copy_only=False).view(np.uint64)))

    return F.arrow_udf(test, "boolean")(hashes)
