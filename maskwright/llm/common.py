"""Helpers the training-data operators share: written tables, fences, gapless numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to a fresh shared folder and read it back.

    Used for what later steps read more than once: a lost executor then costs a read, not
    a second run of the steps before.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fence(df: DataFrame) -> DataFrame:
    """Checkpoint a small table to the shared folder; it is removed with its last reference."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "fences"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, blocks: int | None = None
) -> DataFrame:
    """Number the rows of every group from 0 without gaps, in a new column ``name``.

    A group is cut into ``blocks`` hash blocks of its ``order`` columns; rows are ranked in
    their block and shifted by the rows of the blocks before, so a group that holds a third
    of all rows is still spread over ``blocks`` tasks.  Nulls in ``groups`` form a group of
    their own.  ``df`` is read twice and should be a written table.
    """
    blocks = blocks or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    taken = set(df.columns)
    block, before, g = "_block", "_before", [f"_group{i}" for i in range(len(groups))]
    if taken & {block, before, *g}:
        raise ValueError("column names starting with _block, _before or _group are reserved")
    cut = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)))
    ranked = cut.withColumn(
        name, F.row_number().over(Window.partitionBy(*groups, block).orderBy(*order)).cast("long") - 1
    )
    earlier = Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(*groups, block)
        .agg(F.count("*").alias("_n"))
        .select(
            *[F.col(c).alias(a) for c, a in zip(groups, g)],
            F.col(block).alias("_at"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long").alias(before),
        )
    )
    same = F.col(block) == F.col("_at")
    for c, a in zip(groups, g):
        same = same & F.col(c).eqNullSafe(F.col(a))
    return (
        ranked.join(shifts, same)
        .withColumn(name, F.col(name) + F.col(before))
        .drop(block, "_at", before, *g)
    )
