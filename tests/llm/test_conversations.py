"""Conversation repair against a plain program that tries edits one by one."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from maskwright.llm import conversations as cv, queries as q

BLANK = set(" \t\n\x0b\x0c\r")
EMPTY = hashlib.sha256(b"").hexdigest()


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(named).encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def slow_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = "".join(c for c in text if c not in BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_edits(rows, faults):
    """Dijkstra over (cost, audit) with states (rows used, last initial); repaired rows with it."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, out = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            return cost, audit, out
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in follows:
                heapq.heappush(heap, (cost + 3, audit + "I", k, initial, (*out, role + ":")))
        if k == len(rows):
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", k + 1, last, out))
        _, _, role, text = rows[k]
        if faults[k] in ("blank", "duplicate"):
            continue
        more = 3 if faults[k] else 0
        if role[:1] and role[0] in follows:
            heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[0], (*out, f"{role}:{text}")))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if initial in follows:
                heapq.heappush(heap, (cost + more + 3, audit + "R", k + 1, initial, (*out, f"{name}:{text}")))
    raise AssertionError


def slow_report(rows):
    convs = defaultdict(list)
    for r in slow_damage(rows):
        convs[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = slow_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = slow_edits(own, faults)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def run(spark, rows, parts=3):
    schema = "conv_id long, turn long, role string, text string, pos string, mark string, at string"
    df = spark.createDataFrame([(*r, "p", "m", "a") for r in rows], schema).repartition(parts)
    path = cv.written(df, "conversations")
    original = q.table
    q.table = lambda *_: path
    try:
        found = q.op12_conversation_repair(spark, "")
    finally:
        q.table = original
    return {r[0]: tuple(r)[1:] for r in found.collect()}, found


def random_rows(seed, convs=40, longest=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", " ", "\n\t", "So it is. ", "a b.\n", "x\x1c", "?", "ü…", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    return [
        (conv if conv else None, None if rng.random() < 0.05 else turn + rng.randrange(2), rng.choice(roles[: rng.choice([2, 3, 9])]), rng.choice(texts))
        for conv in range(convs) for turn in range(rng.randrange(1, longest))
    ]


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, monkeypatch):
    monkeypatch.setattr(cv, "CHUNK_BITS", 2)
    monkeypatch.setattr(cv, "CHUNK", 4)
    monkeypatch.setattr(cv, "FAN_OUT_BITS", 1)
    rows = random_rows(seed, convs=12, longest=9 + 40 * seed)
    found, df = run(spark, rows)
    assert found == slow_report(rows)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_equals_plain_program(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(small + "/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r[0]: tuple(r)[1:] for r in q.op12_conversation_repair(spark, small).collect()}
    assert found == slow_report(rows)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Go on.", "No", f"Row {t}."])) for t in range(4000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho."), (3, None, "user", "Hi.")] + [(4, 7, "user", "Same.")] * 50
    found, _ = run(spark, rows, parts=6)
    assert found == slow_report(rows)


def test_empty_and_all_lost(spark):
    assert run(spark, [])[0] == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(lost, 0, "user", "Hi.")])[0] == {lost: (0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_matrices_compose_in_any_grouping():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("suax" "SUAX" "-") for _ in range(rng.randrange(1, 40)))
        pairs, grammar = (), cv.Grammar()
        for _ in range(4):
            counts = cv.pair_counts(cv.Grammar(pairs).compressed(text))
            if counts:
                pairs += (max(counts, key=lambda p: (counts[p], p)),)
        grammar = cv.Grammar(pairs)
        assert len(grammar.compressed(text)) <= len(text)
        plain, cut = cv.IDENTITY, rng.randrange(len(text) + 1)
        for c in text:
            plain = cv.product(plain, cv.row_matrix(c))
        parts = cv.product(grammar.matrix(text[:cut]), grammar.matrix(text[cut:]))
        for m in (parts, grammar.matrix(text)):
            assert {k: (c, cv.flat(a)) for k, (c, a) in m.items()} == {k: (c, cv.flat(a)) for k, (c, a) in plain.items()}


def test_pair_counts_are_what_replacing_takes():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("uas") for _ in range(rng.randrange(30)))
        for pair, n in cv.pair_counts(text).items():
            assert n == text.count(pair)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "What"), (1, 2, "user", ""), (1, 3, "tool", "It."), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in cv.Repair(df).repaired().orderBy("conv_id", "place").collect()]
    assert [r[2:] for r in got if r[0] == 1] == [
        ("I", None, "user", ""), ("K", 0, "assistant", "Hello."), ("K", 1, "user", "What"), ("R", 3, "assistant", "It."),
    ]
    assert [r[1] for r in got if r[0] == 2] == [None]
