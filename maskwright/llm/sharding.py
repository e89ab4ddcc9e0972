"""Jump consistent hashing: shards of stable keys, without a ring or a table of shards.

A key walks through buckets 0 = b0 < b1 < ... and lives in the last one below the number of
shards.  The next bucket depends on the key alone, so one more shard takes from every shard
only the keys whose walk visits it, and nothing moves between the old ones.

Only column functions are used; sizes, checksums, walks and slots run inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered, written

# fixed values: the multiplier of the 64-bit linear congruential generator that the published
# algorithm steps with, cut into its upper 32 bits and two lower halves of 16 bits
MULTIPLIER = 2862933555777941757
_HIGH, _MID, _LOW = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
_MASK = 0xFFFFFFFF


def _next(s: Column) -> Column:
    """One jump: the generator's next state (modulo 2**64, in two halves) and the next bucket."""
    low, high = s["low"], s["high"]
    mid = low * _MID
    sum_low = low * _LOW + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    sum_high = (
        F.shiftright(sum_low, 32)
        + F.shiftright(mid, 16)
        + low * _HIGH
        + high * _LOW
        + F.shiftleft((high * _MID).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    new_high = sum_high.bitwiseAND(F.lit(_MASK))
    step = F.lit(2147483648.0) / (F.shiftright(new_high, 1) + 1).cast("double")
    return F.struct(
        sum_low.bitwiseAND(F.lit(_MASK)).alias("low"),
        new_high.alias("high"),
        s["ahead"].alias("bucket"),
        F.floor((s["ahead"] + 1).cast("double") * step).cast("long").alias("ahead"),
    )


def _walk(start: Column, shards: int, steps: int) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        start,
        lambda s, _: F.when(s["ahead"] >= shards, s).otherwise(_next(s)),
    )


def jump(key: Column, shards: int) -> Column:
    """The shard (int, from 0) of a bigint key.  A null key counts as 0.

    A walk takes about ln(shards) jumps and never more than ``shards``; the few that need
    more than the usual number go on in a second walk.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        key.bitwiseAND(F.lit(_MASK)).alias("low"),
        F.shiftrightunsigned(key, 32).alias("high"),
        F.lit(-1).cast("long").alias("bucket"),
        F.lit(0).cast("long").alias("ahead"),
    )
    usual = min(shards, 6 + 2 * math.ceil(math.log(shards)))
    done = F.transform(
        F.array(_walk(start, shards, usual)),
        lambda s: F.when(s["ahead"] >= shards, s["bucket"]).otherwise(
            _walk(s, shards, shards)["bucket"]
        ),
    )
    return done[0].cast("int")


def stable_key(df: DataFrame, name: str) -> Column:
    """Integers are their own key; any other type is hashed."""
    kind = dict(df.dtypes)[name]
    return F.col(name).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(name)


def assign(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard``, and ``grown_shard`` if one shard were appended."""
    k = stable_key(df, key)
    return df.withColumns({"shard": jump(k, shards), "grown_shard": jump(k, shards + 1)})


def placed(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot) of every row; texts stay where they are.

    size: UTF-8 bytes of the text plus 8 for the key.  A null text has no bytes; a null key
    goes where key 0 goes.  Repeated rows get a slot each.  slot numbers a shard from 0
    without gaps.  Other columns of ``df`` are not read.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key), raw.alias(text))
    narrow = assign(
        rows.select(
            F.col(key),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        ),
        key,
        shards,
    )
    return numbered(written(narrow, "shards"), ["shard"], [key, "text_crc32", "size"], "slot")


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write whole rows, a folder ``shard=N`` for each shard.

    Map tasks write straight into the folders, so no shard is gathered in one task.
    """
    df.withColumn("shard", jump(stable_key(df, key), shards)).write.partitionBy("shard").parquet(path)
