"""A Bloom filter of a table's keys, for leaving out rows before a shuffle.

Every key sets a few bits; tasks combine theirs to words of 64 bits before the shuffle, and words are combined by
``bit_or``, so parts of a table may be sketched apart and put together.  The filter is sized by the counted
number of keys and never larger than ``MOST_BITS``, whatever the table: with more keys it lets more rows through,
but it never keeps a row out that has a key.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits for each key, how many of them a key sets, and the largest filter: 32 MB.
KEY_BITS, PROBES, MOST_BITS = 12, 4, 2**28

Screen = Callable[[Column], Column]


def size_for(keys: int) -> int:
    """Bits for so many keys: a power of two."""
    return min(MOST_BITS, max(1 << 10, 1 << (KEY_BITS * max(1, keys) - 1).bit_length()))


def _probe(key: Column, number: int, bits: int) -> Column:
    return F.xxhash64(F.lit(number), key).bitwiseAND(bits - 1)


def words_of(keys: DataFrame, name: str, bits: int) -> DataFrame:
    """``word, bits``: the words of the filter that aren't 0."""
    places = F.explode(F.array(*(_probe(F.col(name), i, bits) for i in range(PROBES)))).alias("place")
    set_bits = F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS int)))").alias("bits")
    return keys.select(places).groupBy(F.shiftright("place", 6).alias("word")).agg(set_bits)


def screen(keys: DataFrame, name: str, counted: int | None = None) -> Screen:
    """A test of columns: true for every value among the keys and for few others; false for missing values.

    Runs a job.  ``counted`` is the number of keys, if it is known.
    """
    known = keys.filter(F.col(name).isNotNull())
    bits = size_for(known.count() if counted is None else counted)
    found = words_of(known, name, bits).toArrow()  # at most MOST_BITS / 64 rows
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf(BooleanType())
    def held(*probes: pa.Array) -> pa.Array:
        out = np.ones(len(probes[0]), bool)
        for column in probes:
            place = column.to_numpy(zero_copy_only=False)
            out &= (sent.value[place >> 6] >> (place & 63) & 1).astype(bool)
        return pa.array(out)

    return lambda key: key.isNotNull() & held(*(_probe(key, i, bits) for i in range(PROBES)))
