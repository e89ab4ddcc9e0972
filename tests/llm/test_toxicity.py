"""The toxicity classifier against a slow form of the same updates, and on held-out rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries as q, toxicity as tx
from maskwright.llm.quality import held_out

from .cases import AWKWARD


def slow_ftrl(examples, size):
    """FTRL-proximal with plain numbers: one example after the other."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(k):
        l1, l2 = (0.0, 0.0) if k == size else (tx.L1, tx.L2)
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((tx.BETA + math.sqrt(n[k])) / tx.ALPHA + l2)

    for at, label in examples:
        used = [*at, size]
        w = [weight(k) for k in used]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for k, own in zip(used, w):
            sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / tx.ALPHA
            z[k] += g - sigma * own
            n[k] += g * g
    return [weight(k) for k in range(size + 1)], z, n


def test_updates_equal_the_slow_form():
    rng = random.Random(7)
    examples = [(sorted(rng.sample(range(40), rng.randrange(0, 12))), rng.randrange(2)) for _ in range(300)]
    state = tx.State(40)
    for at, label in examples:
        state.learn(np.array(at, np.int64), label)
    weights, z, n = slow_ftrl(examples, 40)
    assert np.allclose(state.z, z) and np.allclose(state.n, n)
    assert np.allclose(state.weights(slice(0, 40)), weights[:40]) and math.isclose(state.bias(), weights[40])
    assert (state.weights(slice(0, 40)) == 0).any()


def test_one_part_is_plain_ftrl(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(0, k, rng.randrange(2), tx.packed(np.array(sorted(rng.sample(range(1 << 14), 9))))) for k in range(60)]
    df = spark.createDataFrame(rows, "part int, place long, label int, x binary").repartition(4)
    model = tx.fit(df, bits=14, rounds=2, epochs=1)
    plain = [(tx.unpacked(x).tolist(), y) for _, _, y, x in rows] * 2
    weights, _, _ = slow_ftrl(plain, 1 << 14)
    assert np.allclose(model.table(), weights[:-1], atol=1e-4) and math.isclose(model.bias, weights[-1], rel_tol=1e-4)


def test_parts_move_by_their_mean(spark):
    rows = [(p, k, 1, tx.packed(np.array([3, 10 + p]))) for p in range(2) for k in range(5)]
    df = spark.createDataFrame(rows, "part int, place long, label int, x binary")
    state = tx.State(1 << 12)
    (block,) = [np.frombuffer(r.d, "<f4").reshape(2, -1) for r in tx._round(df, state, 1).collect() if r.block == 0]
    one = tx.State(1 << 12)
    for _ in range(5):
        one.learn(np.array([3, 10]), 1)
    assert np.allclose(block[0][[3, 10, 11]], one.z[[3, 10, 10]], atol=1e-5)


def test_buckets():
    words = "a b c d"
    assert len(tx.buckets(words)) == 4 + 3 + 4 * len(tx.STEMS) + 2 + 1
    assert len(tx.buckets(None)) == len(tx.buckets(" .!")) == 0
    assert set(tx.buckets("One TWO")) == set(tx.buckets("one  two!"))
    assert tx.buckets("x" * 50000).max() < 1 << tx.BITS


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(folder + "/labels.parquet").collect()}
    out = q.op11_toxicity(spark, folder).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    rest = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert len(out) == 1000 and sum(p == y for p, y in rest) / len(rest) > 0.85
    clean = [p for p, y in rest if y == 0]
    assert sum(clean) / len(clean) < 0.02


def test_learns_rude_words_and_pairs(docs, spark):
    rng = random.Random(9)
    calm = "the of and to in is it that was for on are with as his they at be this".split()
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(calm) for _ in range(rng.randrange(5, 60))]
        bad = k % 5 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = ["grumbleface"] if k % 2 else ["you", "was", "at"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in tx.classified(docs(rows), table).collect()}
    rest = [(out[k].predicted, y) for k, y in labels if held_out(k)]
    assert sum(p == y for p, y in rest) / len(rest) > 0.97


def test_awkward_rows_and_tables(spark, docs):
    label_rows = [(i, k % 2) for k, (i, _) in enumerate(AWKWARD) if i] + [(None, 1), (1, None), (4, 0), (4, 1), (99, 1), (6, 7)]
    labels = spark.createDataFrame(label_rows, "doc_id long, toxic int")
    for table in (labels, labels.limit(0)):
        out = tx.classified(docs(AWKWARD), table).collect()
        assert sorted((r.doc_id is None, r.doc_id) for r in out) == sorted((i is None, i) for i, _ in AWKWARD)
        assert all(0 <= r.score <= 1 for r in out)
    assert tx.classified(docs([]), labels).collect() == []
    with pytest.raises(ValueError):
        tx.scored(docs(AWKWARD).withColumn("score", F.lit(1)), tx.Model(np.zeros(0, np.int64), np.zeros(0), 0.0))


def test_same_model_however_dealt(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a, b = (tx.fit(tx.examples(d.repartition(n), l, "doc_id", "text", "toxic"), epochs=2) for n in (1, 7))
    assert (a.buckets == b.buckets).all() and (a.weights == b.weights).all() and a.bias == b.bias
