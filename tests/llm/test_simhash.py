"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from maskwright.llm import components as cc, queries as q, simhash as sh

from .cases import AWKWARD


def slow_fingerprint(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance):
    """prints: {id: fingerprint}."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in zip(ids, values):
        for j in np.nonzero(np.bitwise_count(values ^ v) <= distance)[0]:
            a, b = root(i), root(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [t for _, t in AWKWARD if t is None or len(t) < 2000] + ["the cat sat on the mat " * 40])
def test_fingerprint(text):
    assert sh.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_in_blocks():
    text = " ".join(f"w{i % 97}" for i in range(5000))
    assert sh.fingerprint(text, block=64) == slow_fingerprint(text)


def test_query_equals_brute_force(spark, small):
    rows = q.op2_simhash(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(small + "/documents.parquet").collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == {i: slow_fingerprint(t) for i, t in texts.items()}
    want = slow_components({r.doc_id: int(r.fingerprint, 16) for r in rows}, 2)
    assert {r.doc_id: r.component_id for r in rows} == want


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_crowds_and_strangers(spark, distance):
    """A ball of near copies that crowds every part, and random fingerprints."""
    rnd = random.Random(distance)
    base, prints = rnd.getrandbits(64), {}
    for i in range(600):
        v = base
        for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 4])):
            v ^= 1 << b
        prints.setdefault(v, i)
    for i in range(600, 1200):
        prints.setdefault(rnd.getrandbits(64), i)
    rows = [(int(np.uint64(v).astype(np.int64)), i) for v, i in prints.items()]
    df = spark.createDataFrame(rows, "fingerprint long, node long")
    got = {r.node: r.component for r in cc.components(sh.links(df, distance)).collect()}
    want = slow_components({i: v for v, i in prints.items()}, distance)
    assert {i: got.get(i, i) for i in want} == want


def test_awkward_rows(docs):
    df = docs(AWKWARD)
    rows = sh.groups(df, "doc_id", "text").collect()
    assert len(rows) == len(AWKWARD)
    named = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert named[6] == named[7] == named[8] == 6
    assert named[1] == named[2] == named[3] == 1
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    kept = sh.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 not in ids and 8 not in ids and ids.count(5) == 1 and ids.count(None) == 2


def test_repeated_ids_lose_no_other_text(spark):
    """An id with two texts is judged text by text, and of equal rows one stays."""
    t, other, near = "the quick brown fox jumps over the lazy dog " * 30, "some words of its own, and no others " * 9, "x y z " * 40
    rows = [(1, t), (1, t), (2, t), (2, t), (3, t), (3, other), (4, near), (4, near), (None, t), (0, None), (5, "")]
    df = spark.createDataFrame([(i, x, "r", "i", 1) for i, x in rows], "doc_id long, text string, _row string, _id string, id int").repartition(4)
    kept = sh.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, t), (3, other), (4, near), (None, t), (0, None)], key=str
    )


def test_empty_table(docs):
    assert sh.groups(docs([(1, "x")]).where("doc_id < 0"), "doc_id", "text").collect() == []


def test_every_threshold_vector_covers_the_distance():
    rnd = np.random.default_rng(1)
    cost = rnd.random((200, 4, 4)) * 10
    cost[:, :, 0] = 0
    chosen, total = sh.allocate(cost, 2)
    assert ((chosen + 1).sum(1) == 3).all()
    picked = np.take_along_axis(cost, (chosen + 1)[:, :, None], 2).sum((1, 2))
    assert np.allclose(picked, total)
    options = [t for t in np.ndindex(4, 4, 4, 4) if sum(t) == 3]
    assert np.allclose(total, [min(sum(c[p, t] for p, t in enumerate(o)) for o in options) for c in cost])


def test_correlated_bits_share_a_part():
    rnd = np.random.default_rng(2)
    bits = rnd.integers(0, 2, (500, 64))
    bits[:, 40] = bits[:, 3]
    sample = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
    parts = sh.group_bits(sample, 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any({3, 40} <= set(p) for p in parts)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 300)]
    hub = [(1000, i) for i in range(1001, 1400)]
    edges = spark.createDataFrame(path + hub + [(7, 7), (None, 3), (5, 6), (6, 5)], "u long, v long")
    got = {r.node: r.component for r in cc.components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, **{i: 1000 for i in range(1000, 1400)}, 5: 5, 6: 5}
