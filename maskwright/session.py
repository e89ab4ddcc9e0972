"""Session helpers: a local session for tests, and the shared folder for jobs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

SPREAD = "spark.maskwright.spread"
ROWS_A_TASK = 20_000  # of narrow rows from which texts are derived
TEXTS_A_TASK = 4_000  # of rows of text tables


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maskwright")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SPREAD, "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``; where that is unset, below the warehouse folder,
    which a cluster shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.conf.get("spark.master", "local").startswith("local") and (root.startswith("file:") or "://" not in root):
            raise ValueError("set spark.checkpoint.dir: the warehouse folder lies on each machine's own disk")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back: read again, it is not computed again,
    and a lost executor costs a read."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give an input one partition per core, if the session asks for it.

    Text rules are CPU-bound, and a file with one row group is read by one task.  Local
    sessions of this module ask; elsewhere texts are dealt by number (``dealt_texts``).
    """
    if df.isStreaming or not _asks_for_spread(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def _asks_for_spread(df: DataFrame) -> bool:
    return df.sparkSession.conf.get(SPREAD, "false") == "true"


def dealt_texts(df: DataFrame) -> DataFrame:
    """Deal the rows of text tables, unless the session has them spread anyway.

    Files are split no finer than by row group, and the rules take far longer on a text than reading and
    sending it does; so no task may have to search all texts of a file.
    """
    return df if _asks_for_spread(df) else dealt(df, TEXTS_A_TASK)


def dealt(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """Deal rows evenly to tasks of about ``rows`` rows each.

    Files are split by bytes and no finer than by row group, so a column of keys comes in one task,
    whatever is derived from each key.  Rows are dealt in turn, not by key: a frequent key or null
    is as good as any other.
    """
    tasks = math.ceil(df.count() / rows)
    return df.repartition(tasks) if tasks > 1 else df
