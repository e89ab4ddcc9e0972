"""Styled runs: replacing spans without touching run boundaries or formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spans as sp
from .blocks import whole_text


def run_offsets(runs: Column) -> Column:
    """Runs with their start and end in the joined text."""
    state = F.struct(
        F.lit(0).alias("pos"),
        F.array()
        .cast("array<struct<run_id:int,text:string,bold:boolean,italic:boolean,start:int,end:int>>")
        .alias("runs"),
    )

    def step(acc: Column, run: Column) -> Column:
        text = F.coalesce(run["text"], F.lit(""))
        end = acc["pos"] + F.length(text)
        placed = F.struct(
            run["run_id"].cast("int").alias("run_id"),
            text.alias("text"),
            run["bold"].alias("bold"),
            run["italic"].alias("italic"),
            acc["pos"].alias("start"),
            end.alias("end"),
        )
        return F.struct(end.alias("pos"), F.concat(acc["runs"], F.array(placed)).alias("runs"))

    return F.aggregate(runs, state, step, lambda acc: acc["runs"])


def overlaps(span: Column, run: Column) -> Column:
    return F.greatest(span["start"], run["start"]) < F.least(span["end"], run["end"])


def _run_text(run: Column, entities: Column) -> Column:
    """A run's text after redaction.

    Spans are disjoint, so everything follows from the original offsets: what a span
    covers goes, and its replacement stands in the first run it touches.
    """
    state = F.struct(run["start"].alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        kept = F.substring(
            run["text"], acc["pos"] - run["start"] + 1, F.greatest(e["start"] - acc["pos"], F.lit(0))
        )
        placed = F.when(e["start"] >= run["start"], e["replacement"]).otherwise("")
        return F.struct(
            F.least(e["end"], run["end"]).alias("pos"), F.concat(acc["out"], kept, placed).alias("out")
        )

    return F.aggregate(
        F.filter(entities, lambda e: overlaps(e, run)),
        state,
        step,
        lambda acc: F.concat(
            acc["out"], F.substring(run["text"], acc["pos"] - run["start"] + 1, F.length(run["text"]))
        ),
    )


def with_text(df: DataFrame, runs: str = "runs", text: str = "text") -> DataFrame:
    return df.withColumn(text, whole_text(F.col(runs)))


def redact_runs(df: DataFrame, runs: str = "runs", entities: str = "entities") -> DataFrame:
    """Rewrite the runs of blocks that carry ``entities``; count and flags stay."""
    placed = df.withColumn("_placed", run_offsets(F.col(runs)))
    return placed.withColumn(
        runs,
        sp.with_each(
            "_placed",
            entities,
            lambda r, found: F.struct(
                r["run_id"].alias("run_id"),
                _run_text(r, found).alias("text"),
                r["bold"].alias("bold"),
                r["italic"].alias("italic"),
            ),
        ),
    ).drop("_placed")


def explode_runs(df: DataFrame, keys: Sequence[str], runs: str = "runs") -> DataFrame:
    return sp.unnest(df, keys, runs, "run").select(*keys, "run.*")


def span_runs(df: DataFrame, keys: Sequence[str], entities: str = "entities", runs: str = "runs") -> DataFrame:
    """Every span with every run it overlaps, found inside the row."""
    placed = df.withColumn("_placed", run_offsets(F.col(runs)))
    touched = F.filter(F.col("_placed"), lambda r: overlaps(F.col("e"), r))
    return sp.unnest(
        sp.unnest(placed, [*keys, "_placed"], entities, "e"), [*keys, "e"], touched, "run"
    ).select(
        *keys,
        F.col("e.pii_type").alias("pii_type"),
        F.col("e.start").cast("long").alias("start"),
        F.col("e.end").cast("long").alias("end"),
        F.col("run.run_id").cast("long").alias("run_id"),
    )


def layout(df: DataFrame, runs: str = "runs") -> DataFrame:
    """Blocks, runs, bold runs and italic runs of a table."""
    def of(condition) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(F.col(runs), condition))), F.lit(0)).cast("long")

    return df.agg(
        F.count("*").alias("n_blocks"),
        of(lambda r: F.lit(True)).alias("n_runs"),
        of(lambda r: r["bold"]).alias("n_bold"),
        of(lambda r: r["italic"]).alias("n_italic"),
    )
