"""Redaction of text columns, and the reports on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, spans as sp, surrogates as su
from . import blocks, detectors
from ..session import stored


def with_entities(
    df: DataFrame,
    text: str = "text",
    *,
    salt: str,
    as_of: str = su.DEFAULT_AS_OF,
    output: str = "entities",
    **detection,
) -> DataFrame:
    """Add the resolved spans with key and replacement.  Needs no shuffle.

    Who knows the salt can search short values back from their replacements, so there is no
    default.  A table that has a column ``output`` already is an error.
    """
    sp.reserve(df, output)
    found = detectors.detect(df, text, output="_spans", **detection)
    return found.select(*sp.columns(df), su.entities("_spans", salt, as_of).alias(output))


def _redacted(text: str, entities: str) -> Column:
    return sp.splice(F.col(text), F.col(entities), lambda e: e["replacement"])


def _n_redactions(entities: str) -> Column:
    return F.coalesce(F.size(entities), F.lit(0)).cast("long")


def redact(df: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Replace the text of rows that carry ``entities``, and count the replacements."""
    return df.withColumns({text: _redacted(text, entities), "n_redactions": _n_redactions(entities)})


def redact_text(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Detect and redact in one narrow step: scan, project, write.  Other columns stay as they are."""
    sp.reserve(df, "n_redactions")
    name = sp.fresh(df, "entities")
    found = with_entities(df, text, output=name, **options)
    kept = [_redacted(text, name).alias(c) if c == text else column for c, column in zip(df.columns, sp.columns(df))]
    return found.select(*kept, _n_redactions(name).alias("n_redactions"))


def explode_entities(df: DataFrame, keys: Sequence[str] = (), entities: str = "entities") -> DataFrame:
    return sp.unnest(df, keys, entities, "e").select(*keys, "e.*")


def categories(spark) -> DataFrame:
    """The nine categories with their report order."""
    return spark.createDataFrame(
        [(c, i) for i, c in enumerate(fv.CATEGORIES)], "pii_type string, ord int"
    )


def mapping(df: DataFrame, entities: str = "entities") -> DataFrame:
    """The distinct replacements made.  Holds originals: keep it in a restricted place.

    ``distinct`` combines on the map side first, so a value found in a third of all
    rows reaches the shuffle once per task.
    """
    return (
        explode_entities(df, (), entities)
        .select(
            "pii_type",
            F.col("key").alias("normalized_original"),
            F.col("replacement").alias("synthetic_replacement"),
        )
        .distinct()
    )


def mapping_report(mapped: DataFrame) -> DataFrame:
    """The one-row header of the exported mapping."""
    return mapped.agg(F.count("*").alias("total_mappings")).select(
        F.lit(fv.MAPPING_NOTICE).alias("notice"), "total_mappings"
    )


def counts(df: DataFrame, entities: str = "entities") -> DataFrame:
    """Redactions per category; all nine appear."""
    n = explode_entities(df, (), entities).groupBy("pii_type").agg(F.count("*").alias("n"))
    dimension = categories(df.sparkSession)
    return dimension.join(n, "pii_type", "left").select(
        "pii_type", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def run_summary(df: DataFrame, entities: str = "entities") -> DataFrame:
    """One row: redactions in total and per category, and distinct entities."""
    per_entity = (
        explode_entities(df, (), entities).groupBy("pii_type", "key").agg(F.count("*").alias("n"))
    )

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    return per_entity.agg(
        total(F.lit(True)).alias("total_redactions"),
        F.count("*").alias("unique_entities"),
        *[total(F.col("pii_type") == c).alias("n_" + c.lower()) for c in fv.CATEGORIES],
    )


def document_run(df: DataFrame, keys: Sequence[str], salt: str, **detection) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole run over documents in parts: (redacted blocks, summary, faults).

    ``df`` has keys and the parts body, header and footer as JSON.  Parts are read, blocks reached
    twice are taken once, blank ones left out, the rest redacted; parts that can't be read are listed
    with the faults and cost nothing else.
    """
    read = stored(blocks.parts(df, keys), "parts")
    place = [*keys, "section", "place"]
    units = blocks.nonblank(blocks.dedup(blocks.part_blocks(read, keys), place))
    found = stored(with_entities(units, salt=salt, **detection), "blocks")
    return redact(found).drop("entities"), run_summary(found), blocks.part_faults(read, keys)


def residual(df: DataFrame, original_entities: str, redacted: str, keys: Sequence[str]) -> DataFrame:
    """Originals that still stand somewhere in the redacted text of their row."""
    checked = sp.with_each(
        original_entities,
        redacted,
        lambda e, after: F.when(
            F.contains(after, e["value"]),
            F.struct(e["pii_type"].alias("pii_type"), e["value"].alias("value")),
        ),
    )
    leaks = F.array_distinct(F.filter(checked, lambda leak: leak.isNotNull()))
    return sp.unnest(df, keys, leaks, "leak").select(*keys, "leak.*")
