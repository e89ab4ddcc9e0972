"""Sinks: redacted tables, and the mapping under its own path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.redact import mapping_report


def write_redacted(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write redacted blocks; an existing result is replaced as a whole."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_mapping(mapped: DataFrame, path: str) -> None:
    """Write the mapping as JSON lines with a one-row header beside it.

    It links originals to replacements, so ``path`` should be readable to auditors only.
    The header counts the written rows, not a second run of the detection.
    """
    spark = mapped.sparkSession
    mapped.write.mode("overwrite").json(path + "/mappings")
    written = spark.read.schema(mapped.schema).json(path + "/mappings")
    mapping_report(written).write.mode("overwrite").json(path + "/header")
