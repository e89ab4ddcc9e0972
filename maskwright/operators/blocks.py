"""Text units: from document tables to block rows ``(doc_id, section, block_id, text)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spans as sp, validators as v
from ..session import stored
from . import detectors


def lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One block per line of the text, in order."""
    return df.select(
        *keys, F.posexplode_outer(F.split(text, "\n", -1)).alias("block_id", "text")
    ).where(F.col("block_id").isNotNull())


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    """Blocks with something to look at; null counts as blank."""
    return df.where(v.strip(F.col(text)) != "")


def dedup(df: DataFrame, keys: Sequence[str] = ("doc_id", "block_id")) -> DataFrame:
    """Each block once, however often it was reached (merged cells)."""
    return df.dropDuplicates(list(keys))


def table_cells(df: DataFrame, keys: Sequence[str], rows: str = "rows") -> DataFrame:
    """Cells of tables and of tables nested in cells, cut into lines.

    ``rows``: array<struct<cells array<struct<text, nested array<struct<cells array<string>>>>>>>.
    ``path`` is [row, cell, line] or [row, cell, nested row, nested cell, line].
    """
    cells = (
        df.select(*keys, F.posexplode(rows).alias("r", "row"))
        .select(*keys, "r", F.posexplode("row.cells").alias("c", "cell"))
    )
    outer = cells.select(
        *keys, "r", "c", F.posexplode(F.split("cell.text", "\n", -1)).alias("l", "text")
    ).select(*keys, F.array("r", "c", "l").alias("path"), "text")
    nested = (
        cells.select(*keys, "r", "c", F.posexplode("cell.nested").alias("nr", "row"))
        .select(*keys, "r", "c", "nr", F.posexplode("row.cells").alias("nc", "text"))
        .select(*keys, "r", "c", "nr", "nc", F.posexplode(F.split("text", "\n", -1)).alias("l", "text"))
        .select(*keys, F.array("r", "c", "nr", "nc", "l").alias("path"), "text")
    )
    return outer.unionByName(nested)


def nested_cells(cells: DataFrame, keys: Sequence[str] = ("doc_id",), max_depth: int = 100) -> DataFrame:
    """Lines of tables nested to any depth: keys, depth, path, line, text.

    ``cells`` has keys, cell_id, parent_id (the cell that holds this one's table, null outside),
    row, col and text.  path is row and column of every cell on the way, depth the cells around
    it.  Each round joins one level to the next by cell, and levels are written, so the plan doesn't
    grow with the depth.  A cell whose parents run in a circle or that has none is an error; a
    null text has no lines.
    """
    own = [*keys, "cell_id"]
    level = stored(
        cells.where(F.col("parent_id").isNull()).select(*own, F.array("row", "col").alias("path"), "text"), "cells"
    )
    inner = stored(cells.where(F.col("parent_id").isNotNull()).select(*own, "parent_id", "row", "col", "text"), "inner-cells")
    levels, found, wanted = [], 0, inner.count()
    for depth in range(max_depth + 1):
        levels.append(level.withColumn("depth", F.lit(depth)))
        if found == wanted or depth == max_depth:
            break
        parents = level.select(*keys, F.col("cell_id").alias("parent_id"), F.col("path").alias("_above"))
        level = stored(
            inner.join(parents, [*keys, "parent_id"]).select(*own, F.concat("_above", F.array("row", "col")).alias("path"), "text"),
            "cells",
        )
        more = level.count()
        found += more
        if not more:
            break
    if found != wanted:
        raise ValueError(f"{wanted - found} cells have no outer table, or hold themselves, or lie deeper than {max_depth}")
    every = reduce(DataFrame.unionByName, levels)
    return every.select(*keys, "depth", "path", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def sections(df: DataFrame, keys: Sequence[str], names: Sequence[str] = ("body", "header", "footer")) -> DataFrame:
    """Paragraph arrays of the document parts as blocks; a missing part gives none."""
    parts = F.array(
        *[F.struct(F.lit(s).alias("section"), F.col(s).alias("paragraphs")) for s in names]
    )
    return (
        df.select(*keys, F.explode(parts).alias("part"))
        .select(*keys, "part.section", F.posexplode("part.paragraphs").alias("block_id", "text"))
        .where(F.col("text").isNotNull())
    )


PART = "struct<paragraphs array<string>, cells array<struct<cell_id int, parent_id int, row int, col int, text string>>>"


def parts(df: DataFrame, keys: Sequence[str], names: Sequence[str] = ("body", "header", "footer")) -> DataFrame:
    """Documents whose parts come as JSON, one column each: keys, section, part, raw.

    A part is an object of ``paragraphs`` and ``cells`` (of tables in it, as in ``nested_cells``), lists either of
    which may be missing.  part is null where raw is no such object, so a damaged header costs
    itself and not its document; a null part gives no row.
    """
    each = F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("raw")) for n in names])
    rows = df.select(*keys, F.explode(each).alias("x")).select(*keys, "x.section", "x.raw").where(F.col("raw").isNotNull())

    def listed(doc: Column, name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant"))
        return F.coalesce(kind.startswith("ARRAY") | (kind == "VOID"), F.lit(True))

    def read(doc: Column) -> Column:
        known = F.schema_of_variant(doc).startswith("OBJECT") & listed(doc, "paragraphs") & listed(doc, "cells")
        return F.when(known, F.try_variant_get(doc, "$", PART))

    # parsed once a part
    return rows.withColumn("part", sp.let(F.try_parse_json("raw"), read))


def part_faults(read: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts that couldn't be read: keys, section, raw."""
    return read.where(F.col("part").isNull()).select(*keys, "section", "raw")


def part_blocks(read: DataFrame, keys: Sequence[str], max_depth: int = 100) -> DataFrame:
    """(keys, section, place, text): paragraphs and the lines of all tables' cells, at any depth.

    place is the paragraph's number, or ``t`` and the cell's path and line.
    """
    paragraphs = read.select(*keys, "section", F.posexplode("part.paragraphs").alias("i", "text")).select(
        *keys, "section", F.col("i").cast("string").alias("place"), "text"
    )
    cells = read.select(*keys, "section", F.explode("part.cells").alias("c")).select(*keys, "section", "c.*")
    lines = nested_cells(cells, [*keys, "section"], max_depth).select(
        *keys, "section",
        F.concat_ws("/", F.lit("t"), F.transform("path", lambda i: i.cast("string")), F.col("line").cast("string")).alias("place"), "text",
    )
    return paragraphs.unionByName(lines).where(F.col("text").isNotNull())


def whole_text(column: Column) -> Column:
    """The text of styled runs put together."""
    return F.array_join(F.transform(column, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def detect_distinct(df: DataFrame, keys: Sequence[str], text: str = "text", **detection) -> DataFrame:
    """Spans of every row, with each distinct text searched once.

    A text is known by its SHA-256: one copy of it for each hash reaches the detection, combined
    on the map side, and the rows are joined to what was found by hash and keys alone.  Texts
    are never join keys, and one that a third of all rows share is one row on the other side.
    """
    hashed = df.withColumn("_hash", F.unhex(F.sha2(text, 256)))
    distinct = hashed.groupBy("_hash").agg(F.first(text).alias(text))
    found = detectors.explode_spans(detectors.detect(distinct, text, **detection), ["_hash"])
    return hashed.select(*keys, "_hash").join(found, "_hash").drop("_hash")
