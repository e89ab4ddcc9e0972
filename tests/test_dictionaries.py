"""The joined dictionary path against the inline one."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import detectors as dt, dictionaries as dc


def test_joined_equals_inline(spark):
    rng = random.Random(5)
    words = ["asha", "Rao", "rao", "Oak", "N.A.", "&", "Finch", "bank", "of", "x", "é", "(old)", "_a"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)} - {"&", "& &", "& & &"})
    firms = ["Oak Oak", "Finch & Oak", "N.A.", "bank of rao", "(old) bank"]
    texts = [rng.choice(["", "Dr. "]) + "".join(rng.choice(words).swapcase() + rng.choice([" ", " ", ", ", "", "."]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "doc_id int, text string")
    dictionary = spark.createDataFrame([("name", n) for n in names] + [("company", c) for c in firms], "kind string, term string")
    inline = dt.candidates(df, known_names=names, known_companies=firms)
    joined = dc.joined_candidates(df, ["doc_id"], dictionary)

    def rows(out):
        return {r.doc_id: sorted((s.rule, s.start, s.end, s.value) for s in r.candidates) for r in out.collect()}

    a, b = rows(inline), rows(joined)
    assert a == b and sum(map(len, a.values())) > 100
    one = dc.detect_with_known(df, ["doc_id"], dictionary, max_inline=0)
    two = dc.detect_with_known(df, ["doc_id"], dictionary)
    key = lambda out: {r.doc_id: [(s.start, s.end, s.pii_type) for s in r.spans] for r in out.collect()}
    assert key(one) == key(two)


@pytest.mark.parametrize("size", [0, 1, 200, 201, 1500])
def test_size_changes_nothing(spark, size):
    """Also for entries without words, empty ones and letters with odd case pairs."""
    odd = ["µ Labs", "ΟΔΟΣ", "ϐeta", "Straẞe", "&", "+/-", "ſun", "İzmir", "", None]
    names = ([*odd, *(f"Word{i} Rao" for i in range(1500))])[: size and size + 1]
    texts = ["μ labs, οδος and οδοσ", "BETA βeta", "straße STRAẞE", "A&B C & D x&&y", "1+/-2", "SUN sun", "izmir", "word7 RAO", "word1400 rao"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    dictionary = spark.createDataFrame([("company" if i % 2 else "name", n) for i, n in enumerate(names)], "kind string, term string")
    key = lambda out: {r.doc_id: [(s.start, s.end, s.rule) for s in r.spans] for r in out.collect()}
    joined = key(dc.detect_with_known(df, ["doc_id"], dictionary, rules=["name_known", "company_known"], max_inline=-1 if size else 0))
    if len(names) <= 2 * dt.MAX_INLINE_VALUES:
        terms = {kind: dt.clean_terms(n for i, n in enumerate(names) if ("company" if i % 2 else "name") == kind) for kind in ("name", "company")}
        inline = dt.detect(df, rules=["name_known", "company_known"], known_names=terms["name"], known_companies=terms["company"])
        assert joined == key(inline)
    assert sum(map(len, joined.values())) >= (0, 1, 8, 8, 9)[[0, 1, 200, 201, 1500].index(size)]


def test_limits(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    with pytest.raises(ValueError):
        dt.candidates(df, known_names=[f"n{i}" for i in range(dt.MAX_INLINE_VALUES + 1)])
    other = spark.createDataFrame([("person", "Asha")], "kind string, term string")
    for inline in (0, 10):
        with pytest.raises(Exception, match="no such kind"):
            dc.detect_with_known(df, ["doc_id"], other, max_inline=inline).collect()


def test_only_likely_sequences_leave_the_row(spark):
    """A large dictionary: exploded word sequences are at most twice the hits."""
    entries = [("name", f"Partner{i} Varga") for i in range(3000)]
    dictionary = spark.createDataFrame(entries, "kind string, term string")
    rows = [(i, f"note {i} of partner{i * 7} varga and partner x{i}, house {i}, varga partner " * 3) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    firsts = dc._Firsts(dc.keyed_entries(dictionary))
    assert firsts.words is None
    worded = df.select(dc._folded_words(F.col("text")).alias("w"))
    grams = worded.select(F.explode(F.array_distinct(dc._sequences("w", [2], firsts))))
    hits = sum(i * 7 < 3000 for i in range(800))
    assert hits <= grams.count() <= 2 * hits
    found = dc.detect_with_known(df, ["doc_id"], dictionary, rules=["name_known"])
    assert {r.doc_id: len(r.spans) for r in found.collect()} == {i: 3 * (i * 7 < 3000) for i in range(800)}


def test_filters_of_large_dictionaries_are_tables(spark, monkeypatch):
    """Beyond some thousand entries the plan holds no filter, and the spans are the same."""
    odd = ["µ Labs", "ΟΔΟΣ", "&", "+/-", "ſun", "İzmir", "One Two Three Four", "N.A.", "", None]
    dictionary = spark.createDataFrame(
        [("company" if i % 2 else "name", n) for i, n in enumerate([*odd, *(f"Word{i} Rao" for i in range(3000))])], "kind string, term string"
    )
    texts = ["μ labs, οδος", "A&B C & D x&&y", "1+/-2", "SUN sun", "izmir", "one two three four five", "n.a.x n.a.", "word7 RAO, word7 rao", "word1400 rao " * 300, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")

    def spans():
        out = dc.detect_with_known(df, ["doc_id"], dictionary, rules=["name_known", "company_known"], max_inline=0)
        return out, {r.doc_id: [(s.start, s.end, s.rule) for s in r.spans] for r in out.collect()}

    _, in_row = spans()
    monkeypatch.setattr(dc, "MAX_ROW_KEYS", 2000)
    out, joined = spans()
    assert joined == in_row and len(joined[8]) == 300 and sum(map(len, joined.values())) > 308
    assert len(out._jdf.queryExecution().toString()) < 400_000
    monkeypatch.setattr(dc, "MAX_BROADCAST_BYTES", 0)
    assert spans()[1] == in_row
