"""Token ids, record files and packing against brute force and round trips."""

import io
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskwright.llm import packing as pk, queries as q, records as rc, token_ids as ti
from maskwright.llm.common import written

from .cases import AWKWARD

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(ti.VOCABULARY))


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("text", [
    "", " ", "Hello's WORLD's 123abc ...x", "a\x00b", "a\x1cb\x85c d é ́x", "<|endoftext|> x<|startoftext|>y",
    "<|ENDOFTEXT|>", "Ünïcode ÉÈ ΑΣ ς İ", "a" * 3000, "don't DON'T i'Ve ''s", "日本語 テスト 123４５", "x\r\ny​z ﻿q\x7f", "é É",
])
def test_ids_equal_the_tokenizers(text):
    assert ti.word_encoder().encode(text).tolist() == plain(text)


def test_ids_after_the_memory_is_cleared(monkeypatch, spark, small):
    monkeypatch.setattr(ti, "KEPT", 50)
    encoder = ti.WordEncoder(public_tokenizers.path(ti.VOCABULARY))
    for r in spark.read.parquet(small + "/documents.parquet").limit(20).collect():
        assert encoder.encode(r.text).tolist() == plain(r.text)


# --- records --------------------------------------------------------------------------------------


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rnd = random.Random(1)
    data = [rnd.randbytes(n) for n in (0, 1, 2, 63, 64, 65, 127, 128, 1000, 5000)] + [b"123456789"]
    assert rc.crc32c(data).tolist() == [slow_crc32c(d) for d in data]
    assert int(rc.crc32c([b"123456789"])[0]) == 0xE3069283
    assert rc.crc32c([]).tolist() == []


def test_frames_round_trip_and_damage():
    payloads = [b"", b"x", bytes(1000), b"abc" * 700]
    raw = b"".join(rc.frames(payloads))
    assert [p for part in rc.read_frames(io.BytesIO(raw), "f", batch_bytes=100) for p in part] == payloads
    for at in (0, 9, 14, 20, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(rc.read_frames(io.BytesIO(bytes(bad)), "f"))
    with pytest.raises(ValueError):
        list(rc.read_frames(io.BytesIO(raw[:-2]), "f"))


def test_record_query(spark, small):
    want, at = {}, 0
    for r in sorted(spark.read.parquet(small + "/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = plain(r.text) + [1]
        want[r.doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in q.op6_record_files(spark, small).collect()}
    assert got == want


def test_records_of_awkward_rows(docs, tmp_path):
    path = f"file://{tmp_path}/records"
    index = rc.write(docs(AWKWARD), "doc_id", "text", path)
    rows = rc.read(index.sparkSession, path).orderBy("start").collect()
    some = AWKWARD
    assert [r.doc_id for r in rows] == sorted((i for i, _ in some), key=lambda i: (i is not None, i))
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == Counter((i, crc(plain(t) + [1])) for i, t in some)
    fetched = rc.fetch(index.orderBy("n_tokens"), path).collect()
    assert Counter((r.doc_id, crc(r.ids)) for r in fetched) == Counter((r.doc_id, r.ids_crc32) for r in rows)


def test_large_inputs_make_more_files(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(rc, "FILE_BYTES", 1000)
    rows = [(1, "same words " * 20)] * 60 + [(2, "x")]
    index = rc.write(docs(rows), "doc_id", "text", f"file://{tmp_path}/many")
    assert index.select("file").distinct().count() >= 10 and rc.read(index.sparkSession, f"file://{tmp_path}/many").count() == 61
    with pytest.raises(ValueError):
        rc.payload(rc.NO_ID, np.zeros(1, rc.ID_TYPE))


def test_records_of_an_empty_table(docs, tmp_path):
    index = rc.write(docs([(1, "x")]).where("doc_id < 0"), "doc_id", "text", f"file://{tmp_path}/none")
    assert index.count() == 0 and rc.read(index.sparkSession, f"file://{tmp_path}/none").count() == 0


def test_damaged_file_is_noticed(docs, tmp_path):
    path = tmp_path / "records"
    index = rc.write(docs([(i, f"text number {i}") for i in range(50)]), "doc_id", "text", f"file://{path}")
    file = next(path.glob("*.rec"))
    raw = bytearray(file.read_bytes())
    raw[20] ^= 4
    file.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="checksum"):
        rc.read(index.sparkSession, f"file://{path}").collect()


# --- packing ----------------------------------------------------------------------------------------


def check_plan(counts, capacity):
    groups, used = pk.plan(counts, capacity), Counter()
    for lengths, n in groups:
        assert n > 0 and 0 < sum(lengths) <= capacity
        for x in lengths:
            used[x] += n
    assert all(used[x] == counts[x] for x in range(capacity + 1))
    return sum(n for _, n in groups)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rnd = np.random.default_rng(seed)
    lengths = np.minimum(512, rnd.lognormal(4 + seed / 6, 1, 40 * 4**seed).astype(int) + 1)
    n = check_plan(np.bincount(lengths, minlength=513), 512)
    least = -(-int(lengths.sum()) // 512)
    assert least <= n <= least * 1.1 + 2


@pytest.mark.parametrize("lengths, sequences", [
    ([7, 3], 1), ([6, 3, 1], 1), ([4, 3, 2, 1], 1), ([5, 5, 5], 2), ([10, 10], 2), ([], 0), ([6, 6, 2, 2, 2, 2], 2),
])
def test_exact_complements(lengths, sequences):
    assert check_plan(np.bincount(np.array(lengths, int), minlength=11).astype(np.int64), 10) == sequences


def test_complement_is_found_whenever_there_is_one():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        counts = (rnd.random(31) < 0.2).astype(np.int64) * rnd.integers(1, 3, 31)
        counts[0] = 0
        length = 30 - int(rnd.integers(1, 20))
        counts[length] += 1
        rest = counts.copy()
        rest[length] -= 1
        there = [x for x in range(1, 31) for _ in range(rest[x])]
        gap = 30 - length
        exact = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(there, k))
        found = pk.complement(counts, (length,), gap)
        assert (found is not None) == exact
        assert found is None or sum(found) == gap


def check_packed(rows, texts, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts:
        ids = plain(text) + [1]
        got = {(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc]}
        starts = range(0, len(ids), capacity)
        assert {(k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(starts)} <= got
    return len(by_sequence)


def test_packing_query(spark, small):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(small + "/documents.parquet").collect()]
    rows = q.op8_best_fit_packing(spark, small).collect()
    n = check_packed(rows, texts, 4096)
    sizes = [len(plain(t)) + 1 for _, t in texts]
    assert len(rows) == sum(-(-s // 4096) for s in sizes)
    assert n <= -(-sum(sizes) // 4096) * 1.05 + 1


def test_packing_awkward_rows(docs):
    rows = pk.packed(docs(AWKWARD), "doc_id", "text", capacity=64).collect()
    check_packed(rows, AWKWARD, 64)
    assert sum(r.length for r in rows) == sum(len(plain(t)) + 1 for _, t in AWKWARD)
    assert pk.packed(docs([(1, "x")]).where("doc_id < 0"), "doc_id", "text").count() == 0


def test_sequences_hold_the_ids(docs):
    texts = [(i, "word " * (i % 7) + f"number {i}") for i in range(60)]
    placed = written(pk.pack(written(pk.pieces(docs(texts), "doc_id", "text", 32, with_ids=True), "p"), 32), "q")
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in pk.sequences(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(bytes(r.ids), "<u4").tolist()
