"""Nested tables, label files of changing shape, evaluation totals."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import blocks as bl, evaluate as ev, redact as rd
from maskwright.sources import readers as rs

CELLS = "doc_id int, cell_id int, parent_id int, row int, col int, text string"


def test_cells_by_depth(spark):
    chain = [(1, d, d - 1 if d else None, 0, d, f"at {d}\nsecond") for d in range(7)]
    df = spark.createDataFrame(chain + [(2, 0, None, 3, 4, None), (2, 1, 0, 0, 0, "")], CELLS)
    got = {(r.doc_id, r.depth, tuple(r.path), r.line): r.text for r in bl.nested_cells(df).collect()}
    assert got[1, 6, (0, 0, 0, 1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 6), 1] == "second" and len(got) == 15
    assert got[2, 1, (3, 4, 0, 0), 0] == ""
    assert bl.nested_cells(df.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [[(1, 1, 2, 0, 0, "a"), (1, 2, 1, 0, 0, "b")], [(1, 1, 1, 0, 0, "a")], [(1, 1, 9, 0, 0, "a")]])
def test_circles_and_orphans_are_errors(spark, rows):
    with pytest.raises(ValueError):
        bl.nested_cells(spark.createDataFrame([(1, 0, None, 0, 0, "x"), *rows], CELLS))


def test_cells_too_deep(spark):
    chain = [(1, d, d - 1 if d else None, 0, 0, "x") for d in range(5)]
    with pytest.raises(ValueError):
        bl.nested_cells(spark.createDataFrame(chain, CELLS), max_depth=3)


GOOD = '{"metadata":{"source":"x"},"passages":[{"text":"t","ground_truth_pii":[{"type":"EMAIL","value":"a@b.c"},{"type":null,"value":"v"}]},{"other":1}]}'


def test_label_lines(spark, tmp_path):
    lines = [GOOD, "", '{"passages":"none"}', '{"metadata":5,"passages":[{"text":7}]}', "[1]", '{"cut":', "null"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json").write_bytes(b"\xff\xfe broken")
    read = rs.label_lines(spark, str(tmp_path))
    assert sorted(r.raw for r in rs.damaged_lines(read).collect())[:3] == ["[1]", "null", '{"cut":']
    assert rs.damaged_lines(read).select("file").distinct().count() == 2
    got = {(r.source, r.place, r.text): [tuple(t) for t in r.truth] for r in rs.labelled_passages(read).collect()}
    assert got == {("x", 0, "t"): [("EMAIL", "a@b.c")], ("x", 1, ""): [], ("unknown", 0, "7"): []}
    none = rs.label_lines(spark, str(tmp_path / "absent"))
    assert rs.labelled_passages(none).collect() == [] == rs.damaged_lines(none).collect()
    with pytest.raises(Exception):
        rs.label_lines(spark, str(tmp_path / "absent"), optional=False)


def test_totals(spark):
    rows = [("a", "EMAIL", 1, 0, 1), ("a", "EMAIL", 1, 0, 0), ("a", "SSN", 0, 2, 0), ("b", None, 0, 0, 0), ("b", "DOB", 0, 0, 3)]
    got = {(r.scope, r.tier, r.pii_type): (r.tp, r.fp, r.fn, r.n, r.precision, r.recall, r.f1) for r in ev.totals(
        spark.createDataFrame(rows, "tier string, pii_type string, tp long, fp long, fn long")).collect()}
    assert got == {
        ("type", "a", "EMAIL"): (2, 0, 1, 3, 1.0, 0.6667, 0.8), ("type", "a", "SSN"): (0, 2, 0, 2, 0.0, 1.0, 0.0),
        ("type", "b", "DOB"): (0, 0, 3, 3, 0.0, 0.0, 0.0), ("tier", "a", None): (2, 2, 1, 5, 0.5, 0.6667, 0.5714),
        ("tier", "b", None): (0, 0, 3, 3, 0.0, 0.0, 0.0), ("all", None, None): (2, 2, 4, 8, 0.5, 0.3333, 0.4),
    }
    empty = ev.totals(spark.createDataFrame([], "tier string, pii_type string, tp long, fp long, fn long")).collect()
    assert [r.scope for r in empty] in ([], ["all"])


def test_parts_with_faults(spark):
    head = '{"paragraphs":["p",null,""],"cells":[{"cell_id":1,"row":0,"col":0,"text":"a\\nb"},{"cell_id":2,"parent_id":1,"row":3,"col":4,"text":"in"}]}'
    rows = [(1, '{"paragraphs":["x"]}', head, None), (2, "", '{"cells":[]}', "nope"), (3, None, None, "[]"), (4, "{}", '{"paragraphs":"text"}', '{"more":1}')]
    df = spark.createDataFrame(rows, "doc_id int, body string, header string, footer string")
    read = bl.parts(df, ["doc_id"])
    got = sorted(map(tuple, bl.part_blocks(read, ["doc_id"]).collect()))
    assert got == [
        (1, "body", "0", "x"), (1, "header", "0", "p"), (1, "header", "2", ""), (1, "header", "t/0/0/0", "a"),
        (1, "header", "t/0/0/1", "b"), (1, "header", "t/0/0/3/4/0", "in"),
    ]
    faults = sorted(map(tuple, bl.part_faults(read, ["doc_id"]).select("doc_id", "section").collect()))
    assert faults == [(2, "body"), (2, "footer"), (3, "footer"), (4, "header")]


def test_a_whole_run(spark):
    body = '{"paragraphs":["mail a@b.cc"," ","Born 1/2/1934"]}'
    df = spark.createDataFrame([(1, body, "{", body), (2, None, None, None)], "doc_id int, body string, header string, footer string")
    redacted, summary, faults = rd.document_run(df, ["doc_id"], "s")
    assert sorted((r.section, r.place, r.n_redactions) for r in redacted.collect()) == [
        ("body", "0", 1), ("body", "2", 1), ("footer", "0", 1), ("footer", "2", 1)]
    assert summary.first().asDict() | {"n_email": 2, "n_dob": 2, "total_redactions": 4, "unique_entities": 2} == summary.first().asDict()
    assert [tuple(r) for r in faults.collect()] == [(1, "header", "{")]
