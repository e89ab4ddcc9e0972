"""Redaction of streams: the batch transformation on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import spans as sp
from ..operators import detectors, redact as rd
from ..sources import readers as rs


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``path`` is a folder of them or a glob.

    Without ``files_per_trigger`` all files there form one batch.  With it, batches follow the
    files' times of change, not event time: a watermark has to allow for that.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table, be it one file or a folder of part files, as a stream."""
    schema = rs.table(spark, folder, name).schema
    # as a glob, since the file source takes a plain path for a folder
    return read_stream(spark, f"{folder.rstrip('/')}/{name}[.]parquet", schema, files_per_trigger)


def redact_stream(stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """Stateless: each row is detected and redacted on its own."""
    return rd.redact_text(stream, text, **options)


def counts_stream(
    stream: DataFrame, time: str, text: str = "text", window: str = "1 hour", late: str = "10 minutes",
    **options,
) -> DataFrame:
    """Detections per category and tumbling window; state is dropped behind the watermark."""
    found = detectors.detect(stream.withWatermark(time, late), text, **options)
    return (
        sp.unnest(found, [time], "spans", "e")
        .groupBy(F.window(time, window), F.col("e.pii_type").alias("pii_type"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "pii_type", "n")
    )


def dedup_stream(stream: DataFrame, keys: Sequence[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each block once, however often it comes within ``late`` of its first time.

    State holds one key and its time until the watermark passes it, so it is bounded by the
    distinct keys of that span, not by the length of the stream.
    """
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def mapping_stream(stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """The replacements made, each once over the life of the stream.  Holds originals: a restricted sink.

    A key is remembered as state, as long as the mapping itself is kept; with a file sink, which
    commits a batch once, a batch that is run again after a kill leaves no second row.
    """
    found = rd.explode_entities(rd.with_entities(stream, text, **options))
    return found.select(
        "pii_type", F.col("key").alias("normalized_original"), F.col("replacement").alias("synthetic_replacement")
    ).dropDuplicates(["pii_type", "normalized_original"])


REPORTED = 100_000  # batches whose progress a run keeps


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out; an error if not all batches are reported."""
    reported = query.recentProgress
    if reported and reported[0]["batchId"] > 0 and len(reported) >= REPORTED:
        raise RuntimeError(f"more than {REPORTED} batches: late rows of the first ones are not known")
    return sum(
        int(o.get("numRowsDroppedByWatermark", 0)) for p in reported for o in p["stateOperators"]
    )


def run_available(
    out: DataFrame, path: str, checkpoint: str, output_mode: str = "append", allow_late: bool = False
) -> StreamingQuery:
    """Process what is there into parquet, with exactly-once file output, and stop.

    Rows later than the watermark are an error unless ``allow_late``: a wider ``late`` or no
    ``files_per_trigger`` keeps them.
    """
    conf, kept = out.sparkSession.conf, "spark.sql.streaming.numRecentProgressUpdates"
    before = conf.get(kept)
    conf.set(kept, str(REPORTED))  # else only the last 100 batches are known
    query = (
        out.writeStream.outputMode(output_mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        conf.set(kept, before)
    if not allow_late and (n := late_rows(query)):
        raise RuntimeError(f"{n} rows came later than the watermark allows and were not counted")
    return query
