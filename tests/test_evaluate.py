"""Scoring, with hand-computed results."""

from pyspark.sql import functions as F

from maskwright.operators import detectors as dt, evaluate as ev

TRUTH = "array<struct<type:string,value:string>>"
SPAN = "array<struct<pii_type:string,value:string>>"


def test_fuzzy_match(spark):
    pairs = [("Asha Rao", "asha rao", True), ("6 Fern Ln, Surat", "fern ln surat", True), ("a b", "b c", True),
             ("a b c", "c d e", False), ("", "x", False), ("...", "x", False), ("Rao", "Asha-Rao", True)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string, want boolean")
    assert df.where(ev.values_match(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_one_to_one_matching(spark):
    rows = [
        (0, [("EMAIL", "a@b.org"), ("EMAIL", "a@b.org"), ("PHONE", "123")], [("EMAIL", "A@b.org"), ("PHONE", "999")]),
        (1, [("FULL_NAME", "Asha Rao")], [("FULL_NAME", "Ravi Iyer"), ("FULL_NAME", "asha rao"), ("FULL_NAME", "Asha Rao")]),
        (2, [], [("EMAIL", "x@y.org")]), (3, [("EMAIL", "x@y.org")], None),
    ]
    df = spark.createDataFrame(rows, f"passage_id int, spans {SPAN}, truth {TRUTH}")
    matched = ev.match_passages(df)
    assert {r.passage_id: list(r.matched) for r in matched.collect()} == {0: [0, -1, -1], 1: [1], 2: [], 3: [-1]}
    stats = {r.pii_type: (r.tp, r.fp, r.fn) for r in ev.passage_stats(ev.passage_outcomes(matched)).collect()}
    assert stats == {"EMAIL": (1, 2, 1), "PHONE": (0, 1, 1), "FULL_NAME": (1, 0, 2)}
    assert {r.pii_type for r in ev.observed_types(df).collect()} == {"EMAIL", "PHONE", "FULL_NAME"}


def test_metrics(spark):
    stats = spark.createDataFrame([("EMAIL", 3, 1, 0), ("PHONE", 0, 0, 2), ("SSN", 0, 5, 0)], "pii_type string, tp long, fp long, fn long")
    observed = spark.createDataFrame([("EMAIL",), ("PHONE",)], "pii_type string")
    metrics = ev.per_type(stats, observed)
    got = {r.pii_type: (r.precision, r.recall, r.f1, r.observed) for r in ev.rounded(metrics).collect()}
    assert got["EMAIL"] == (0.75, 1.0, 0.8571, True)
    assert got["PHONE"] == (0.0, 0.0, 0.0, True)
    assert got["SSN"] == (0.0, 1.0, 0.0, False)
    assert got["DOB"] == (1.0, 1.0, 1.0, False) and len(got) == 9
    a = ev.averages(metrics).first()
    assert (a.tp, a.fp, a.fn) == (3, 1, 2)
    assert (a.micro_precision, a.micro_recall, a.micro_f1) == (0.75, 0.6, 0.6667)
    assert (a.macro_precision, a.macro_recall, a.macro_f1) == (0.375, 0.5, 0.4286)
    report = {r.pii_type: r.f1 for r in ev.report(metrics).collect()}
    assert report["SSN"] is None and report["EMAIL"] == 0.8571


def test_run_without_labels(spark):
    cases = spark.createDataFrame([(0, "EMAIL", "mail a@b.org", ["a@b.org"])], "case_id int, pii_type string, text string, expected array<string>")
    negatives = spark.createDataFrame([(0, "mail x@y.org")], "case_id int, text string")
    none = spark.createDataFrame([], f"passage_id int, text string, truth {TRUTH}")
    found = ev.run(cases, negatives, none).collect()
    rows = {(r.tier, r.pii_type): (r.tp, r.fp, r.fn, r.observed) for r in found if r.scope == "type"}
    assert rows["cases", "EMAIL"] == (1, 1, 0, True) and len(rows) == 18 and len(found) == 22
    averages = {(r.tier, r.scope): (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in found if r.scope != "type"}
    assert averages["cases", "micro"] == (1, 1, 0, 0.5, 1.0, 0.6667)
    assert averages["cases", "macro"] == (1, 1, 0, 0.9444, 1.0, 0.963)
    assert averages["passages", "micro"] == averages["passages", "macro"] == (0, 0, 0, 0.0, 0.0, 0.0)
    assert {v for (tier, _), v in rows.items() if tier == "passages"} == {(0, 0, 0, False)}


def test_cases_and_negatives(spark):
    """A case is right if the value of its type is found; a text is clean if nothing is."""
    made = {
        "EMAIL": "i{0}@host.zz", "SSN": "00{0}-51-0007", "IP_ADDRESS": "31.31.31.{0}", "PHONE": "812345679{0}",
        "COMPANY": "Ochre Kiln{0} LLP", "DOB": "Born 1/2/193{0}",
    }
    cases, k = [], 0
    for kind, shape in made.items():
        for n in range(1, 4):
            value = shape.format(n)
            cases.append((k, kind, f"= {value}", [value.removeprefix("Born ")]))
            k += 1
    missed = (k, "SSN", "= 000-51-0007", ["000-51-0007"])
    texts = [(n, f"= {31 + n}") for n in range(5)] + [(9, "= i9@host.zz")]
    df = spark.createDataFrame([*cases, missed], "case_id int, pii_type string, text string, expected array<string>")
    plain = spark.createDataFrame(texts, "case_id int, text string")
    scored = ev.score_cases(dt.detect(df))
    assert {r.case_id: (r.tp, r.fp, r.fn) for r in scored.collect()} == {c[0]: (1, 0, 0) for c in cases} | {k: (0, 0, 1)}
    clean = ev.score_negatives(dt.detect(plain))
    assert {r.pii_type: r.n for r in clean.collect()} == {"TRUE_NEGATIVE": 5, "EMAIL": 1}
    assert ev.binary_accuracy(scored, clean, df, plain).first().accuracy == round(23 / 25, 4)
