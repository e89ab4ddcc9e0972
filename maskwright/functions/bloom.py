"""Bloom filters made by aggregation and tested inside a row.

The bits are gathered on the executors with the bitmap functions, one row for each 32,768 bits, so
what reaches the driver has the size of the filter, whatever the number of keys.  The filter is a
binary literal: a row's keys are tested before anything is exploded or shuffled.

``words`` and ``passing`` are the form for many rows of one key each: the filter is a small table of 64-bit
words, broadcast, and a key has three bits in one word, so a test is one lookup in generated code.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_KEY = 10
HASHES = 3
MIN_BITS, MAX_BITS = 1 << 15, 1 << 24  # 4 KB to 2 MB; beyond, more keys pass that shouldn't
MAX_WORDS = 1 << 22  # of the table form: about 150 MB in an executor, and 16 million keys at 16 bits each
KEYS_A_WORD = 4
BUCKET_BITS = 1 << 15  # fixed value: bits of a bucket of the bitmap functions


def _place(key: Column, i: int, bits: int) -> Column:
    """The i-th bit of a 64-bit key: two halves, combined."""
    low, high = key.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(key, 33)
    return F.pmod(low + high * i + i * i, F.lit(bits))


def build(keys: DataFrame, key: str, n: int) -> bytes:
    """The filter of a long column with about ``n`` values; nulls count for nothing."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_KEY * n):
        bits *= 2
    places = keys.where(F.col(key).isNotNull()).select(
        F.explode(F.array(*[_place(F.col(key), i, bits) for i in range(HASHES)])).alias("bit")
    )
    # bucket numbers count from 1 and a bit's place lies in [1, bits]
    buckets = places.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")
    )
    out = bytearray(bits // 8)
    for row in buckets.collect():  # bits / 32,768 rows
        at = (row.bucket - 1) * BUCKET_BITS // 8
        out[at : at + len(row.bits)] = row.bits
    return bytes(out)


def may_hold(filter_bits: bytes, key: Column) -> Column:
    """False only for keys that are not in the filter."""
    bits, literal = 8 * len(filter_bits), F.lit(filter_bits)

    def set_(i: int) -> Column:
        place = _place(key, i, bits)
        byte = F.conv(F.hex(F.substring(literal, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.shiftright(byte, 0).bitwiseAND(F.element_at(F.lit([1, 2, 4, 8, 16, 32, 64, 128]), (place % 8 + 1).cast("int"))) != 0

    return reduce(and_, (set_(i) for i in range(HASHES)))


def _word(key: Column, n: int) -> Column:
    return key.bitwiseAND(n - 1)


def _mask(key: Column) -> Column:
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(key, at).bitwiseAND(63).cast("int")) for at in (24, 34, 44)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def words(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """The table form for a long column with about ``n`` values, and its number of words."""
    size = 1
    while size < min(MAX_WORDS, n / KEYS_A_WORD):
        size *= 2
    made = keys.where(F.col(key).isNotNull()).groupBy(_word(F.col(key), size).alias("_at"))
    return made.agg(F.bit_or(_mask(F.col(key))).alias("_word")), size


def passing(rows: DataFrame, key: str, table: DataFrame, size: int) -> DataFrame:
    """The rows whose key may be in the filter; all whose key is."""
    met = rows.join(F.broadcast(table), _word(F.col(key), size) == F.col("_at"))
    return met.where(F.col("_word").bitwiseAND(_mask(F.col(key))) == _mask(F.col(key))).select(*rows.columns)
