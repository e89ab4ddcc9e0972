"""Collision-free replacements."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import assigned as asg, redact as rd


@pytest.mark.parametrize("space", sorted(asg.SPACES))
def test_a_million_numbers_get_a_million_values(spark, space):
    a, b = asg.SPACES[space]
    n = min(1_000_000, a * b)
    numbers = spark.range(0, n, 1, 8).select(F.lit(space).alias("space"), (F.col("id") * ((a * b) // n)).alias("number"))
    placed = asg.permuted(numbers, "salt")
    assert placed.where("left < 0 or right < 0").count() == 0 and placed.agg(F.max("left"), F.max("right")).first()[0] < a
    made = placed.select(asg.value(space, F.lit("Some Firm"), F.col("left"), F.col("right")).alias("v"))
    assert made.distinct().count() == n and made.where("v is null").count() == 0


def test_whole_space_is_mapped_onto_itself(spark, monkeypatch):
    monkeypatch.setitem(asg.SPACES, "SSN", (7, 11))
    numbers = spark.range(77).select(F.lit("SSN").alias("space"), F.col("id").alias("number"))
    got = {(r.left, r.right) for r in asg.permuted(numbers, "s").collect()}
    assert got == {(i, j) for i in range(7) for j in range(11)}
    with pytest.raises(Exception, match="more entities than values"):
        asg.permuted(spark.range(78).select(F.lit("SSN").alias("space"), F.col("id").alias("number")), "s").collect()


def people(spark, n, parts):
    return spark.range(0, n, 1, parts).select(
        F.when(F.col("id") % 3 == 0, "EMAIL").when(F.col("id") % 3 == 1, "FULL_NAME").otherwise("PHONE").alias("pii_type"),
        F.concat(F.lit("k"), (F.col("id") % (n // 2)).cast("string")).alias("key"),
    )


def test_partitions_change_nothing(spark):
    one, many = ({tuple(r) for r in asg.assigned(people(spark, 4000, p), "salt").collect()} for p in (1, 200))
    assert one == many and len({(t, v) for t, _, v in one}) == len(one) == people(spark, 4000, 1).distinct().count()
    assert one != {tuple(r) for r in asg.assigned(people(spark, 4000, 1), "other").collect()}


def test_nulls_and_other_types(spark):
    df = spark.createDataFrame([("DOB", "1/1/1990"), ("EMAIL", None), ("EMAIL", "a@b.c"), ("EMAIL", "a@b.c"), (None, "x")], "pii_type string, key string")
    assert [r[:2] for r in map(tuple, asg.assigned(df, "s").collect())] == [("EMAIL", "a@b.c")]
    assert asg.assigned(df.limit(0), "s").collect() == []


def test_redacted_texts(spark):
    rows = [(i, f"Mr. Tom Rao and mail u{i % 7}@mail.example.org, DOB: 01/02/1990") for i in range(40)] + [(99, "nothing"), (100, None)]
    df = rd.with_entities(spark.createDataFrame(rows, "id int, text string"), salt="s")
    out = {r.id: r for r in asg.redact(df, ["id"], "s").collect()}
    hashed = {r.id: r for r in rd.redact(df).collect()}
    assert out.keys() == hashed.keys() and all(out[i].n_redactions == hashed[i].n_redactions for i in out)
    assert out[99].text == "nothing" and out[100].text is None
    assert len({out[i].text for i in range(40)}) == 7 and all("@mail.example.org" not in out[i].text for i in range(40))
