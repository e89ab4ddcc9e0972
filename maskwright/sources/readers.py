"""Readers: text tables as blocks, and labelled passages."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

TRUTH_SCHEMA = (
    "metadata map<string,string>, passages array<struct<text:string,"
    "ground_truth_pii:array<struct<type:string,value:string>>>>"
)

# table -> (document key, block key or None, text column)
TEXT_TABLES = {
    "documents": ("doc_id", None, "text"),
    "conversations": ("conv_id", "turn", "text"),
    "pages": ("page_id", None, "html"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; a missing path fails when the plan is analysed."""
    return spark.read.parquet(os.path.join(folder, name + ".parquet"))


def text_blocks(
    spark: SparkSession, folder: str, names: Sequence[str] = tuple(TEXT_TABLES)
) -> DataFrame:
    """Rows (source, doc_id, block_id, text) of the text tables, key and text columns only."""
    parts = []
    for name in names:
        doc, block, text = TEXT_TABLES[name]
        parts.append(
            table(spark, folder, name).select(
                F.lit(name).alias("source"),
                F.col(doc).cast("long").alias("doc_id"),
                (F.col(block) if block else F.lit(0)).cast("long").alias("block_id"),
                F.col(text).alias("text"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def truth_files(spark: SparkSession, path: str | Sequence[str], optional: bool = True) -> DataFrame:
    """Label files: (file, metadata, passages), one object per file.

    Point it at a folder of many files to spread the reading.  An optional path that
    does not exist gives no rows.
    """
    try:
        raw = spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=True)
    except AnalysisException as error:
        if not optional or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, " + TRUTH_SCHEMA)
    return raw.select(F.col("_metadata.file_path").alias("file"), "metadata", "passages")


def passages(spark: SparkSession, path: str | Sequence[str], optional: bool = True) -> DataFrame:
    """Labelled passages of label files: (file, passage_id, text, truth)."""
    return (
        truth_files(spark, path, optional)
        .select("file", F.posexplode("passages").alias("passage_id", "p"))
        .select("file", "passage_id", "p.text", F.col("p.ground_truth_pii").alias("truth"))
    )


def truth_rows(df: DataFrame, keys: Sequence[str] = ("passage_id",)) -> DataFrame:
    """One row per label; passages without labels keep one row with nulls."""
    return df.select(*keys, F.posexplode_outer("truth").alias("truth_idx", "t")).select(
        *keys,
        F.col("truth_idx").cast("long").alias("truth_idx"),
        F.col("t.type").alias("pii_type"),
        F.col("t.value").alias("value"),
    )


def label_lines(spark: SparkSession, path: str | Sequence[str], optional: bool = True) -> DataFrame:
    """JSON documents of labels, one a line, of any shape: (file, raw, doc).

    doc is a VARIANT and null where the line is no JSON, so one damaged line or file costs itself
    alone.  Large files are split at lines.  An optional path that does not exist gives no rows.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if not optional or error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).withColumn(
        "doc", F.try_parse_json("raw")
    )


def damaged_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON object, with their files; blank lines are none."""
    is_object = F.schema_of_variant("doc").startswith("OBJECT")
    return lines.where((F.trim("raw") != "") & ~F.coalesce(is_object, F.lit(False))).select("file", "raw")


def labelled_passages(lines: DataFrame) -> DataFrame:
    """(file, source, place, text, truth) of the passages of readable lines.

    source is metadata.source, "unknown" by default; place is the passage's in its document.  A
    passage without text has an empty one, one without labels no truth, and a label without a
    type or a value is left out.
    """
    passages = lines.where(F.col("doc").isNotNull()).select(
        "file",
        F.coalesce(F.try_variant_get("doc", "$.metadata.source", "string"), F.lit("unknown")).alias("source"),
        F.posexplode(F.try_variant_get("doc", "$.passages", "array<variant>")).alias("place", "p"),
    )
    labels = F.try_variant_get("p", "$.ground_truth_pii", "array<struct<type:string,value:string>>")
    return passages.select(
        "file", "source", "place", F.coalesce(F.try_variant_get("p", "$.text", "string"), F.lit("")).alias("text"),
        F.filter(F.coalesce(labels, F.array().cast("array<struct<type:string,value:string>>")),
                 lambda t: t["type"].isNotNull() & t["value"].isNotNull()).alias("truth"),
    )
