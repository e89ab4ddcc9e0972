"""Search for standing originals against every pair, and the Bloom filter under it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import bloom
from maskwright.operators import residual as rl

KEYS = ["source", "doc_id", "block_id"]


def random_text(rng, n):
    parts = ["asha", "Rao", "é", "日本", "12", "9876543210", " ", " ", ", ", ".", "@", "_", "-", "\n", "x", "\U0001F642", "+91 "]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("scope", [[], KEYS[:2], KEYS])
def test_equals_every_pair(spark, seed, scope):
    rng = random.Random(seed)
    blocks = [("s" if d % 2 else "t", d // 2, b, random_text(rng, rng.randrange(0, 25))) for d in range(12) for b in range(3)]
    blocks += [("s", 99, 0, None), ("s", 0, 0, "asha"), blocks[3], blocks[3]]
    values = {("K", rng.choice(["s", "t"]), rng.randrange(6), rng.randrange(3), random_text(rng, rng.randrange(1, 5))) for _ in range(200)}
    values |= {("K", "s", 1, 0, ""), ("L", "t", 1, 1, None), ("K", "s", 1, 1, "asha Rao" * 30)}
    texts = spark.createDataFrame(blocks, "source string, doc_id long, block_id long, text string")
    wanted = spark.createDataFrame(list(values), "pii_type string, source string, doc_id long, block_id long, value string")
    got = sorted(tuple(r) for r in rl.standing(texts, KEYS, wanted.select(*scope, "pii_type", "value"), scope).collect())
    at = [KEYS.index(s) for s in scope]
    want = {
        (*b[:3], k, v) for b in blocks for k, *place, v in values
        if v and b[3] and v in b[3] and all(b[i] == place[i] for i in at)
    }
    assert got == sorted(want) and want


def test_nothing_to_look_for(spark):
    texts = spark.createDataFrame([("s", 1, 1, "x")], "source string, doc_id long, block_id long, text string")
    none = spark.createDataFrame([], "pii_type string, value string")
    assert rl.standing(texts, KEYS, none).collect() == []
    assert rl.standing(texts.limit(0), KEYS, spark.createDataFrame([("K", "x")], none.schema)).collect() == []
    with pytest.raises(ValueError):
        rl.standing(texts.withColumn("_h", F.lit(1)), KEYS, none)


def test_no_text_is_a_join_key(spark):
    texts = spark.createDataFrame([("s", i, 0, f"call {i} Asha Rao") for i in range(20)], "source string, doc_id long, block_id long, text string")
    wanted = spark.createDataFrame([("K", "Asha Rao"), ("K", "call 7")], "pii_type string, value string")
    plan = rl.standing(texts, KEYS, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search(r"(text|value)#\d+ =|= _?(text|value)#", plan)


def test_filter_has_no_false_negatives(spark):
    rng = random.Random(4)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(20_000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "h long").repartition(5)
    bits = bloom.build(df, "h", len(keys))
    assert len(bits) * 8 == 1 << 18
    assert df.where("h is not null").where(~bloom.may_hold(bits, F.col("h"))).count() == 0
    others = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    assert others.where(bloom.may_hold(bits, F.col("h"))).count() < 1500


def test_filter_of_nothing(spark):
    empty = spark.createDataFrame([], "h long")
    bits = bloom.build(empty, "h", 0)
    assert spark.range(100).where(bloom.may_hold(bits, F.xxhash64("id"))).count() == 0


def test_filter_table_has_no_false_negatives(spark):
    rng = random.Random(5)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(20_000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "h long").repartition(5)
    table, size = bloom.words(df, "h", len(keys))
    assert size == 1 << 13
    assert bloom.passing(df, "h", table, size).count() == len(keys)
    assert bloom.passing(spark.range(20_000).select(F.xxhash64("id").alias("h")), "h", table, size).count() < 1500
    assert bloom.passing(df, "h", *bloom.words(df.limit(0), "h", 0)).count() == 0


def test_pieces_are_tested_in_generated_code(spark):
    """No lambda runs over the pieces of a text, and a kind with few pieces is not cut from texts."""
    texts = spark.createDataFrame([("s", i, 0, f"call 98765{i:05} Asha Rao") for i in range(50)], "source string, doc_id long, block_id long, text string")
    body = texts.select(*KEYS, F.col("text").alias("_text"))
    h = F.xxhash64(F.lit("digit"), F.lit(8), F.lit("98765000"))
    piece = spark.range(1).select(h.alias("h"), F.lit("98765000").alias("piece"))
    hits = rl._hits(body, KEYS, {"digit": [8]}, piece.collect(), *bloom.words(piece, "h", 1))
    assert "lambda" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted({r.doc_id for r in hits.collect()}) == list(range(50))


def test_documents_of_one_row_are_searched_in_the_row(spark, monkeypatch):
    """The search by pieces sees documents of several rows only; null keys, repeats and odd scopes as before."""
    e = "array<struct<pii_type:string,value:string>>"
    rows = [("s", i, 0, f"call 98765{i:05} now", [("PHONE", f"98765{i:05}"), ("PHONE", "98765")]) for i in range(30)]
    rows += [("t", 1, 0, "x Tom Rao", [("NAME", "Tom")]), ("t", 1, 1, "Tom", [("NAME", "Tom Rao"), ("NAME", "")])]
    rows += [("t", 2, None, "Asha", [("NAME", "Asha")]), ("t", None, 0, "Asha", [("NAME", "Asha")]), ("t", 3, 0, None, None)]
    rows += [("t", 4, 0, "Asha", [("NAME", "Asha")])] * 2 + [("t", 5, None, "x", [("NAME", "Asha")]), ("t", 5, 1, "Asha", [])]
    found = spark.createDataFrame(rows, f"source string, doc_id long, block_id long, text string, entities {e}")
    seen, search = [], rl.standing
    monkeypatch.setattr(rl, "standing", lambda blocks, *a, **k: seen.append(blocks.count()) or search(blocks, *a, **k))
    got = sorted(tuple(r) for r in rl.standing_in_documents(found, KEYS, KEYS[:2]).collect())
    want = [(*r[:4], k, v) for r in rows[:30] for k, v in r[4]]
    want += [("t", 1, 0, "x Tom Rao", "NAME", "Tom"), ("t", 1, 0, "x Tom Rao", "NAME", "Tom Rao"), ("t", 1, 1, "Tom", "NAME", "Tom")]
    want += [("t", 4, 0, "Asha", "NAME", "Asha")] * 2 + [("t", 5, 1, "Asha", "NAME", "Asha")]
    assert got == sorted(want) and seen == [6]


def test_common_beginnings_are_no_pairs(spark, monkeypatch):
    """Values that begin alike, in texts that hold the beginning, leave only pairs of text and tail."""
    texts = spark.createDataFrame([("s", i, 0, f"at 12 Fern Lane, Plot {i}, Pune") for i in range(300)], "source string, doc_id long, block_id long, text string")
    wanted = spark.createDataFrame([("A", f"{j} Fern Lane, Plot {i}, Pune") for i in range(0, 3000, 10) for j in (12, 13)], "pii_type string, value string")
    rows, keep = {}, rl.stored

    def stored(df, purpose):
        out = keep(df, purpose)
        rows[purpose] = out.count()
        return out

    monkeypatch.setattr(rl, "stored", stored)
    got = {(r.doc_id, r.value) for r in rl.standing(texts, KEYS, wanted).collect()}
    assert got == {(i, f"12 Fern Lane, Plot {i}, Pune") for i in range(0, 300, 10)}
    assert rows["candidates"] <= 2 * len(got)


def test_values_with_regex_signs(spark):
    values = [r"a \Q.\E b", r"\E x", "(a) [b", "$1 ^", "x" * 60 + " " + "y" * 90, "1" * 70, "🙂 ab", "a🙂b cd"]
    texts = spark.createDataFrame([("s", i, 0, f"q {v} z🙂 {v}") for i, v in enumerate(values)], "source string, doc_id long, block_id long, text string")
    wanted = spark.createDataFrame([("K", v) for v in values] + [("K", "x" * 60 + " " + "y" * 91), ("K", "1" * 71)], "pii_type string, value string")
    got = {(r.doc_id, r.value) for r in rl.standing(texts, KEYS, wanted).collect()}
    assert got == set(enumerate(values))
