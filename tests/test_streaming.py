"""A stream of several files equals the batch."""

import datetime

import os

import pytest
from pyspark.sql import functions as F

from maskwright.operators import redact as rd
from maskwright.streaming import redaction as st

TEXTS = ["mail a{0}@mail.example.org", "host 10.0.0.{0} up", "nothing {0}", "Contact Person: Leela Quint, SSN 123-45-67{0:02d}"]


def source(spark, folder, files=3):
    start = datetime.datetime(2024, 1, 1)
    for f in range(files):
        rows = [(i, start + datetime.timedelta(minutes=i), TEXTS[i % 4].format(i % 90)) for i in range(f * 100, f * 100 + 100)]
        spark.createDataFrame(rows, "doc_id int, ts timestamp, text string").coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch = source(spark, folder)
    stream = st.read_stream(spark, folder, batch.schema, files_per_trigger=1)
    st.run_available(st.redact_stream(stream, salt="s"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = rd.redact_text(batch, salt="s")
    assert got.count() == 300
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_windowed_counts(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch = source(spark, folder)
    stream = st.read_stream(spark, folder, batch.schema)
    st.run_available(st.counts_stream(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.window_start, r.pii_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = batch.agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=10)
    want = {}
    for r in rd.explode_entities(rd.with_entities(batch, salt="s"), ["ts"]).collect():
        hour = r.ts.replace(minute=0)
        if hour + datetime.timedelta(hours=1) <= last:
            want[hour, r.pii_type] = want.get((hour, r.pii_type), 0) + 1
    assert got == want and want


@pytest.mark.parametrize("layout", ["one file", "a folder", "four files", "four files, newest first"])
def test_files_and_their_order_change_nothing(spark, tmp_path, layout):
    """The same table in other files, one file a batch, with a lateness as wide as the data."""
    source(spark, str(tmp_path / "whole"), files=4)
    rows = sorted(spark.read.parquet(str(tmp_path / "whole")).collect(), key=lambda r: r.ts)
    parts = {"one file": 1, "a folder": 1}.get(layout, 4)
    folder, size = tmp_path / "t.parquet", -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : k * size + size]).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if not f.name.startswith("at-"):
                moved = f.rename(folder / f"at-{k}.parquet")
                at = 1_000_000_000 + 1000 * (-k if "newest" in layout else k)
                os.utime(moved, (at, at))
    if layout == "one file":
        only = next(folder.glob("at-*"))
        place = tmp_path / "single"
        place.mkdir()
        only.rename(place / "t.parquet")
        stream = st.read_table(spark, str(place), "t", files_per_trigger=1)
    else:
        stream = st.read_table(spark, str(tmp_path), "t", files_per_trigger=1)
    st.run_available(st.counts_stream(stream, "ts", late="7 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.window_start, r.pii_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {} or all(k[0].hour == 0 for k in got)
    stream = st.read_table(spark, str(tmp_path / "single" if layout == "one file" else tmp_path), "t")
    st.run_available(st.counts_stream(stream, "ts"), str(tmp_path / "out2"), str(tmp_path / "state2"))
    got = {(r.window_start, r.pii_type): r.n for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    want = {}
    for r in rd.explode_entities(rd.with_entities(spark.createDataFrame(rows), salt="s"), ["ts"]).collect():
        hour = r.ts.replace(minute=0)
        if hour + datetime.timedelta(hours=1) <= rows[-1].ts - datetime.timedelta(minutes=10):
            want[hour, r.pii_type] = want.get((hour, r.pii_type), 0) + 1
    assert got == want and want


def test_late_rows_are_an_error(spark, tmp_path):
    folder = tmp_path / "t.parquet"
    start = datetime.datetime(2024, 1, 1)
    for k, day in enumerate((9, 5, 1)):
        row = [(start + datetime.timedelta(days=day), "mail a1@mail.example.org")]
        spark.createDataFrame(row, "ts timestamp, text string").coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*.parquet"):
            os.utime(f.rename(folder / f"at-{k}.parquet"), (1_000_000_000 + k, 1_000_000_000 + k))
    counted = lambda: st.counts_stream(st.read_table(spark, str(tmp_path), "t", files_per_trigger=1), "ts")
    with pytest.raises(RuntimeError, match="later than the watermark"):
        st.run_available(counted(), str(tmp_path / "out"), str(tmp_path / "state"))
    st.run_available(counted(), str(tmp_path / "out2"), str(tmp_path / "state2"), allow_late=True)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1), (1, 3, 0, 2)])
def test_dedup_in_any_order_of_files(spark, tmp_path, order):
    start = datetime.datetime(2024, 1, 1)
    folder = str(tmp_path / "in")
    for k, f in enumerate(order):
        rows = [(i % 60, start + datetime.timedelta(minutes=i % 60), f"text {i % 60}") for i in range(f * 30, f * 30 + 45)]
        spark.createDataFrame(rows, "doc_id int, ts timestamp, text string").coalesce(1).write.mode("append").parquet(folder)
        for path in (tmp_path / "in").glob("part-*.parquet"):
            if not path.name.startswith("part-done"):
                os.utime(path, (1000 + k, 1000 + k))
                path.rename(path.with_name(f"part-done-{k}.parquet"))
    batch = spark.read.parquet(folder)
    stream = st.read_stream(spark, folder, batch.schema, files_per_trigger=1)
    st.run_available(st.dedup_stream(stream, ["doc_id"], "ts", late="2 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.distinct().collect()))


def test_mapping_is_written_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch = source(spark, folder)
    where = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # the second run finds everything done
        st.run_available(st.mapping_stream(st.read_stream(spark, folder, batch.schema, files_per_trigger=1), salt="s"), *where)
    source(spark, folder)
    st.run_available(st.mapping_stream(st.read_stream(spark, folder, batch.schema, files_per_trigger=1), salt="s"), *where)
    got, want = spark.read.parquet(where[0]), rd.mapping(rd.with_entities(batch, salt="s"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_late_rows_of_early_batches_are_an_error(spark, tmp_path, monkeypatch):
    """A row late in an early batch is still known after many batches."""
    start = datetime.datetime(2024, 1, 2)
    for k in range(8):
        ts = start + datetime.timedelta(hours=k) if k != 2 else start - datetime.timedelta(days=1)
        spark.createDataFrame([(k, ts, "mail a@mail.example.org")], "doc_id int, ts timestamp, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for path in (tmp_path / f"in/{k}").glob("*.parquet"):
            os.utime(path, (1000 + k, 1000 + k))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        counted = st.counts_stream(st.read_stream(spark, str(tmp_path / "in/*"), schema, files_per_trigger=1), "ts")
        with pytest.raises(RuntimeError, match="1 rows came later"):
            st.run_available(counted, str(tmp_path / "out"), str(tmp_path / "state"))
        assert spark.conf.get("spark.sql.streaming.numRecentProgressUpdates") == "2"
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
