"""Redaction, its reports, styled runs, sources and sinks."""

import json
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from maskwright.operators import blocks as bl, detectors, redact as rd, runs as rn
from maskwright.sources import readers as rs, writers as ws

TEXTS = [
    "Contact Person: Leela Quint, mail leela.quint@mail.example.org or LEELA.QUINT@mail.example.org",
    "Shri leela  quint, Tel: +91 20 7718 6640. Fax: +912077186640",
    "nothing here", "Host 10.1.2.3 and 10.1.2.3", "DOB: 14/08/1998, SSN 123-45-6789",
]


def entities(spark, texts=TEXTS, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(parts)
    return rd.with_entities(df, salt="s")


def test_equal_entities_get_equal_replacements(spark):
    rows = rd.explode_entities(entities(spark), ["doc_id"]).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault((r.pii_type, r.key), set()).add(r.replacement)
        assert r.replacement != r.value
    assert all(len(x) == 1 for x in by_key.values())
    assert ("EMAIL", "leela.quint@mail.example.org") in by_key and ("PHONE", "912077186640") in by_key
    assert {k for t, k in by_key if t == "FULL_NAME"} == {"Leela Quint"}


def test_text_is_cut_at_the_spans(spark):
    for r in entities(spark).join(rd.redact_text(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string"), salt="s")
                                  .withColumnRenamed("text", "redacted"), "doc_id").collect():
        want, at = "", 0
        for e in r.entities:
            want, at = want + r.text[at:e.start] + e.replacement, e.end
        assert r.redacted == want + r.text[at:] and r.n_redactions == len(r.entities)


def test_result_does_not_depend_on_partitioning(spark):
    one = {(r.doc_id, r.text) for r in rd.redact(entities(spark, parts=1)).collect()}
    many = {(r.doc_id, r.text) for r in rd.redact(entities(spark, parts=50)).collect()}
    assert one == many


def test_counts_and_summary(spark):
    df = entities(spark)
    counts = {r.pii_type: r.n for r in rd.counts(df).collect()}
    assert counts == {"FULL_NAME": 2, "EMAIL": 2, "PHONE": 2, "COMPANY": 0, "ADDRESS": 0, "SSN": 1, "CREDIT_CARD": 0, "DOB": 1, "IP_ADDRESS": 2}
    summary = rd.run_summary(df).first()
    assert summary.total_redactions == 10 and summary.unique_entities == 6 == rd.mapping(df).count()


def test_no_residuals(spark):
    df = entities(spark)
    after = rd.redact(df)
    assert rd.residual(after, "entities", "text", ["doc_id"]).count() == 0


def test_runs_keep_their_shape_and_join_to_the_spliced_text(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(TEXTS) for _ in range(rng.randint(1, 3)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 12)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows.append((i, text, [(j, p, bool(j % 2), bool(j % 3)) for j, p in enumerate(pieces)]))
    rows += [(900, "", []), (901, "", [(0, "", True, False)])]
    df = spark.createDataFrame(rows, "doc_id int, t string, runs array<struct<run_id:int,text:string,bold:boolean,italic:boolean>>")
    found = rd.with_entities(rn.with_text(df), salt="s")
    out = rn.redact_runs(found.withColumn("before", F.col("runs")))
    spliced = {r.doc_id: r.text for r in rd.redact(found).collect()}
    for r in out.collect():
        assert "".join(x.text for x in r.runs) == spliced[r.doc_id]
        assert [(x.run_id, x.bold, x.italic) for x in r.runs] == [(x.run_id, x.bold, x.italic) for x in r.before]
        assert r.text == r.t
        at = 0
        for old, new in zip(r.before, r.runs):
            touched = [e for e in r.entities if max(e.start, at) < min(e.end, at + len(old.text))]
            if not touched:
                assert old.text == new.text
            at += len(old.text)
    assert rn.layout(df).first() == rn.layout(out).first()


def test_run_example(spark):
    runs = [(0, "Contact Person: ", True, None), (1, "Leela ", False, True), (2, "Quint", None, None), (3, ", Secretary", None, None)]
    df = spark.createDataFrame([(1, runs)], "doc_id int, runs array<struct<run_id:int,text:string,bold:boolean,italic:boolean>>")
    found = rd.with_entities(rn.with_text(df), salt="s")
    made = found.first().entities[0].replacement
    assert [x.text for x in rn.redact_runs(found).first().runs] == ["Contact Person: ", made, "", ", Secretary"]


def test_blocks(spark):
    df = spark.createDataFrame([(1, "a\n\n \nb"), (2, None)], "doc_id int, text string")
    lines = bl.lines(df, ["doc_id"])
    assert [(r.block_id, r.text) for r in lines.orderBy("block_id").collect()] == [(0, "a"), (1, ""), (2, " "), (3, "b")]
    assert [r.block_id for r in bl.nonblank(lines).orderBy("block_id").collect()] == [0, 3]
    assert bl.dedup(lines.unionByName(lines)).count() == 4
    parts = spark.createDataFrame([(1, ["p"], None, ["f", None])], "doc_id int, body array<string>, header array<string>, footer array<string>")
    assert [(r.section, r.block_id, r.text) for r in bl.sections(parts, ["doc_id"]).collect()] == [("body", 0, "p"), ("footer", 0, "f")]


def test_table_cells(spark):
    schema = "doc_id int, rows array<struct<cells:array<struct<text:string,nested:array<struct<cells:array<string>>>>>>>"
    rows = [([("a\nb", None), ("m@x.org", [(["n1", "n2"],)])],)]
    got = bl.table_cells(spark.createDataFrame([(1, rows)], schema), ["doc_id"]).collect()
    assert sorted((list(r.path), r.text) for r in got) == [
        ([0, 0, 0], "a"), ([0, 0, 1], "b"), ([0, 1, 0], "m@x.org"), ([0, 1, 0, 0, 0], "n1"), ([0, 1, 0, 1, 0], "n2"),
    ]


def test_sinks(spark, tmp_path):
    df = entities(spark)
    ws.write_redacted(rd.redact(df).select("doc_id", "text"), str(tmp_path / "out" / "deep"))
    assert spark.read.parquet(str(tmp_path / "out" / "deep")).count() == len(TEXTS)
    ws.write_mapping(rd.mapping(df), str(tmp_path / "map"))
    rows = spark.read.json(str(tmp_path / "map" / "mappings")).collect()
    head = spark.read.json(str(tmp_path / "map" / "header")).first()
    assert len(rows) == head.total_mappings == 6 and head.notice
    assert set(rows[0].asDict()) == {"pii_type", "normalized_original", "synthetic_replacement"}


def test_truth_files(spark, tmp_path):
    payload = {"metadata": {"name": "fixture"}, "passages": [
        {"text": "mail a@b.org", "ground_truth_pii": [{"type": "EMAIL", "value": "a@b.org"}]}, {"text": "none"}]}
    (tmp_path / "truth.json").write_text(json.dumps(payload, indent=1))
    rows = rs.truth_rows(rs.passages(spark, str(tmp_path))).orderBy("passage_id").collect()
    assert [(r.passage_id, r.truth_idx, r.pii_type, r.value) for r in rows] == [(0, 0, "EMAIL", "a@b.org"), (1, None, None, None)]


def test_missing_files(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    assert rs.passages(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(AnalysisException):
        rs.passages(spark, str(tmp_path / "none.json"), optional=False)
    with pytest.raises(AnalysisException):
        rs.table(spark, str(tmp_path), "documents")


def test_sweep_example(spark):
    from maskwright.functions import spans as sp

    intervals = [(0, 10), (5, 30), (12, 20), (20, 25)]
    rng = random.Random(3)
    many = [[(s, s + rng.randint(1, 30)) for s in (rng.randint(0, 100) for _ in range(rng.randint(0, 25)))] for _ in range(200)]
    rows = [(i, [("T", "r", 0, s, e, "") for s, e in x]) for i, x in enumerate([intervals, *many])]
    got = {r.i: [(s.start, s.end) for s in r.k] for r in
           spark.createDataFrame(rows, f"i int, s {sp.SPANS}").select("i", sp.resolve(F.col("s")).alias("k")).collect()}
    assert got[0] == [(0, 10), (12, 20), (20, 25)]
    for i, x in enumerate([intervals, *many]):
        assert got[i] == [(s, e) for s, e, _ in brute.sweep([(s, e, 0) for s, e in x])]


def test_redaction_needs_no_shuffle(spark):
    plan = rd.redact_text(spark.range(10).selectExpr("id", "cast(id as string) as text"), salt="s")._jdf.queryExecution().toString()
    assert not re.search(r"Exchange (hash|range|Round|Single)|ShuffleQueryStage", plan)


def test_distinct_lines_with_one_line_in_a_third_of_all_rows(spark):
    rows = spark.range(100_000).selectExpr(
        "id as doc_id", "case when id % 3 = 0 then 'write to a1@mail.example.org' else concat('line ', id) end as text"
    )
    found = bl.detect_distinct(rows, ["doc_id"], rules=["email"])
    assert found.agg(F.count("*"), F.sum("doc_id"), F.min("value")).first()[:] == (33_334, sum(range(0, 100_000, 3)), "a1@mail.example.org")


@pytest.mark.parametrize("column", ["_text", "_SCAN", "_folded", "_digit", "_candidates", "_spans", "n_redactions"])
def test_reserved_columns_are_an_error(spark, column):
    df = spark.createDataFrame([(1, "x", 2)], f"id int, text string, {column} int")
    with pytest.raises(ValueError, match="reserved"):
        rd.redact_text(df, salt="s")


def test_callers_columns_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc", "mine", 7)], "id int, text string, entities string, spans int")
    out = rd.redact_text(df, salt="s")
    assert out.columns == ["id", "text", "entities", "spans", "n_redactions"]
    (row,) = out.collect()
    assert (row.entities, row.spans, row.n_redactions) == ("mine", 7, 1)
    for call in (lambda: rd.with_entities(df, salt="s"), lambda: detectors.detect(df), lambda: detectors.candidates(df, output="entities")):
        with pytest.raises(ValueError, match="reserved"):
            call()


def test_a_salt_has_to_be_given(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    with pytest.raises(TypeError):
        rd.redact_text(df)
