"""The other operators against brute force, held-out accuracy and round trips."""

import gzip
import math
import os
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from maskwright.llm import (
    decontaminate as dc, lm_score as lm, quality as ql, queries as q, sharding as sd, token_counts as tc, topk, warc,
)
from maskwright.llm.common import numbered

from .cases import AWKWARD


def documents(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(folder + "/documents.parquet").collect()}


def test_registered_names():
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(q.CHECKS))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = q.QUERIES[name](spark, small)
    want = con.sql(q.CHECKS[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


# --- 1: language-model scores -----------------------------------------------------------------------


def slow_scores(rows):
    words = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in rows]
    f1 = Counter(w for _, d in words for w in d)
    f2 = Counter(p for _, d in words for p in zip(d, d[1:]))
    total = sum(f1.values())
    out = []
    for i, d in words:
        own1, own2, s, known = Counter(d), Counter(zip(d, d[1:])), 0.0, 0
        for k, w in enumerate(d):
            single = max(1, f1[w] - own1[w]) / max(1, total - len(d))
            pair = f2[d[k - 1], w] - own2[d[k - 1], w] if k else 0
            known += pair > 0
            s += math.log10(pair / (f1[d[k - 1]] - own1[d[k - 1]]) if pair > 0 else single * (0.4 if k else 1))
        out.append((i, len(d), known, sum(f1[w] == own1[w] for w in d), round(s, 5)))
    return Counter(out)


def shown_scores(rows):
    return Counter((r.doc_id, r.n_words, r.n_pairs_known, r.n_words_unseen, round(r.log10_score, 5)) for r in rows)


def test_scores_query(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 40_000)
    assert shown_scores(q.op1_lm_score(spark, small).collect()) == slow_scores(documents(spark, small).items())


def test_scores_of_awkward_rows(docs):
    assert shown_scores(lm.scores(docs(AWKWARD)).collect()) == slow_scores(AWKWARD)
    assert lm.scores(docs([(1, "x")]).where("doc_id < 0")).collect() == []


def test_a_chunk_reads_few_answers_of_others(docs, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(lm, "GROUP_BYTES", 1 << 13, raising=False)
    monkeypatch.setattr(lm, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(600))) for i in range(60)]
    assert shown_scores(lm.scores(docs(rows)).collect()) == slow_scores(rows)
    files = [pq.ParquetFile(x).metadata for x in sorted((tmp_path / "lm-answers").rglob("*.parquet"))]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    # row groups far below a file of 16 chunks, and apart by chunk
    assert len(groups) >= 4 * len(files)
    assert max(g.num_rows for g in groups) <= max(m.num_rows for m in files) / 2
    chunk = next(i for i in range(groups[0].num_columns) if groups[0].column(i).path_in_schema == "chunk")
    assert all(g.column(chunk).statistics.has_min_max for g in groups)


def slow_ngram_scores(rows, order):
    words = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in rows]
    runs = lambda d, n: zip(*(d[k:] for k in range(n)))
    every = Counter(g for _, d in words for n in range(1, order + 1) for g in runs(d, n))
    total, out = sum(len(d) for _, d in words), []
    for i, d in words:
        own = Counter(g for n in range(1, order + 1) for g in runs(d, n))
        f = lambda g: every[g] - own[g]

        def s(g):
            if len(g) == 1:
                return max(1, f(g)) / max(1, total - len(d))
            return f(g) / f(g[:-1]) if f(g) > 0 else 0.4 * s(g[1:])

        sums = [sum(math.log10(s(tuple(d[max(0, k - n + 1) : k + 1]))) for k in range(len(d))) for n in range(1, order + 1)]
        known = [sum(f(g) > 0 for g in runs(d, n)) for n in range(2, order + 1)]
        out.append((i, tuple(known), tuple(round(x, 4) for x in sums)))
    return Counter(out)


def shown_ngram_scores(rows):
    return Counter((r.doc_id, tuple(r.n_known), tuple(round(x, 4) for x in r.log10_scores)) for r in rows)


def test_scores_of_longer_contexts(spark, small, docs, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 40_000)
    want = slow_ngram_scores(documents(spark, small).items(), 3)
    assert shown_ngram_scores(q.op1_lm_score(spark, small).collect()) == want
    assert sum(k[1] for _, k, _ in want) > 0
    for order in (2, 5):
        assert shown_ngram_scores(lm.scores(docs(AWKWARD), order=order).collect()) == slow_ngram_scores(AWKWARD, order)


def test_packed_arrays_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (lm._keys(lm._packed_keys(keys)) == keys).all()
    assert (np.diff(lm.part_of(keys, 7).astype(int)) >= 0).all() and set(lm.part_of(keys, 7)) == set(range(7))


# --- 3: top-k ---------------------------------------------------------------------------------------


def slow_topk(rows, every, k):
    found = {(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, v in found:
        if i % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in found if j != i and len(w) == len(v))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(hits[:k])}
    return out


def test_topk_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)]) for i in range(150)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0]), (240, [float("nan")] * 4), (260, [float("inf")] * 4), (280, []), (281, []), (300, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + rows[:3]], "vec_id long, embedding array<double>, block string")
    got = topk.nearest(df, "vec_id", "embedding", every=20, k=20).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == slow_topk(rows, 20, 20)
    assert len(got) == len(set(got))
    assert topk.nearest(df.where("vec_id < 0"), "vec_id", "embedding", 20, 20).collect() == []


def test_products_beyond_doubles():
    big = np.array([[2**40, 3]], np.int64)
    assert topk.products(big, np.array([[2**20, 1]], np.int64)).tolist() == [[2**60 + 3]]


# --- 4: decontamination -----------------------------------------------------------------------------


def slow_alignment(a, b):
    table, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best / (2 * len(a))


def test_alignment():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        a, b = rnd.integers(0, 4, rnd.integers(1, 12)), rnd.integers(0, 4, rnd.integers(1, 25))
        score, start, end = dc.align(a, b)
        assert score == slow_alignment(a.tolist(), b.tolist())
        if score:
            assert slow_alignment(a.tolist(), b[start:end].tolist()) == score


def test_leaks_equal_alignment_of_everything(spark, small):
    """On whole small tables: what a full alignment accepts is found, and nothing else."""
    texts = documents(spark, small)
    items = {r.item_id: r.text for r in spark.read.parquet(small + "/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in q.op4_decontamination(spark, small).collect()}
    plain = {i: " ".join(re.findall(r"\w+", t.lower())) for i, t in texts.items()}
    verbatim = {(d, i) for i, t in items.items() for d, u in plain.items() if " ".join(re.findall(r"\w+", t.lower())) in u}
    assert verbatim <= set(got) and verbatim
    assert all(got[k].score == 1 for k in verbatim)
    for d, i in verbatim:
        r = got[d, i]
        assert re.findall(r"\w+", texts[d].lower()[r.start : r.end]) == re.findall(r"\w+", items[i].lower())
    for d, i in set(got) - verbatim:
        assert slow_alignment(plain_words(items[i]), plain_words(texts[d])) >= dc.MIN_SCORE


def plain_words(text):
    return re.findall(r"\w+", text.lower())


def test_edited_copies_and_a_passage_everywhere(spark, docs):
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "ero", "ist", "olu", "eth", "ing")]
    phrase = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: phrase(30) for i in range(6)}
    rows, want = [], set()
    for n in range(120):
        copy = list(items[0] if n % 2 else items[1 + n % 5])
        if n % 3 == 0:
            copy[rnd.randrange(30)] = "edited"
        if n % 4 == 0:
            del copy[10:12]
        rows.append((n, " ".join(phrase(80) + copy + phrase(40)).upper()))
        want.add((n, 0 if n % 2 else 1 + n % 5))
    rows += [(1000 + n, " ".join(phrase(200))) for n in range(60)]
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in items.items()] + [(90, None), (91, "..."), (92, "zzz yyy")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs(rows), bench).collect()}
    assert got == want
    kept = {r.doc_id for r in dc.decontaminated(docs(rows), bench).collect()}
    assert kept == {1000 + n for n in range(60)}


def test_edited_copies_of_a_hot_item(spark, docs):
    """Of the copies that full alignment accepts, those of an item in most documents are found too."""
    rnd = random.Random(11)
    phrase = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    items = {i: phrase(n) for i, n in enumerate((16, 24, 40))}
    rows = []
    for n in range(900):
        copy = [rnd.choice(("x", "y", "z")) + str(n) if rnd.random() < (0.2, 0.3, 0.4)[n // 3 % 3] else w for w in items[n % 3]]
        rows.append((n, " ".join(phrase(30) + copy + phrase(30))))
    hashed = {i: dc.word_hashes(" ".join(w)) for i, w in items.items()}
    want = {
        (d, i) for d, t in rows for i, w in hashed.items()
        if dc.align(w, dc.word_hashes(t))[0] >= max(dc.MIN_SCORE, min(1, dc.MIN_WORDS / len(w)))
    }
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs(rows), bench).collect()}
    assert len(want) > 600 and got <= want
    assert len(got) >= 0.99 * len(want)


def test_runs_of_long_items(spark, docs):
    """A run is a copy by its own length, wherever it lies in its item."""
    rnd = random.Random(12)
    phrase = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    items = {300: phrase(300), 256: phrase(256), 380: phrase(380), 1000: phrase(1000)}
    runs = [(300, a, 60) for a in range(0, 241, 30)] + [(256, 20, 100), (380, 0, 150), (380, 115, 150), (1000, 300, 180)]
    runs += [(1000, a, 60) for a in range(0, 941, 47)]
    rows = [(n, " ".join(phrase(50) + items[i][a : a + size] + phrase(50))) for n, (i, a, size) in enumerate(runs)]
    rows += [(1000 + n, " ".join(phrase(40) + items[i][70 : 70 + 20] + phrase(40))) for n, i in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = dc.leaks(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(n, i) for n, (i, _, _) in enumerate(runs)} and len(got) == len(runs)
    texts = dict(rows)
    for r in got:
        i, a, size = runs[r.doc_id]
        if size == 60:
            assert len(set(texts[r.doc_id][r.start : r.end].split()) & set(items[i][a : a + size])) >= dc.ENOUGH_WORDS


def test_leaks_in_awkward_rows(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "one two"), (3, None), (4, ""), (5, "Word"), (6, "A tail")], "item_id long, text string")
    df = docs(AWKWARD + [(20, "they said one two three")])
    want = {6, 7, 8}
    got = dc.leaks(df, bench).collect()
    assert {r.doc_id for r in got if r.item_id == 1 and r.doc_id} == want
    assert {r.doc_id for r in got if r.item_id == 2} == {5, 20}
    assert {r.doc_id for r in got if r.item_id == 5} == {10}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 8)
    assert sorted(map(str, dc.leaks(df, bench).collect())) == sorted(map(str, got))
    kept = dc.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 11: 1, 12: 1, None: 2})
    assert dc.leaks(df, bench.where("item_id < 0")).collect() == [] == dc.leaks(df.where("doc_id < 0"), bench).collect()


# --- 5: WARC ----------------------------------------------------------------------------------------


def test_warc_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "VOLUME_BYTES", 600)
    rows = [(1, "http://a.example/x", "<p>é</p>"), (2, None, None), (None, "http://b.example/\r\ny", ""), (3, "u", "z" * 5000)]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, volume string").coalesce(1)
    index = warc.write(pages, f"file://{tmp_path}/w")
    assert index.select("volume").distinct().count() > 1
    for r in index.collect():
        raw = (tmp_path / "w" / r.volume).read_bytes()[r.offset : r.offset + r.length]
        head, body = gzip.decompress(raw).split(b"\r\n\r\n", 1)
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        assert head.startswith(b"WARC/1.1\r\n") and body == html.encode() + b"\r\n\r\n"
        assert f"Content-Length: {len(html.encode())}".encode() in head


@pytest.mark.parametrize("range_bytes, fan_out", [(256 << 10, 16), (2048, 2)])
def test_audit_finds_every_fault(spark, small, tmp_path, monkeypatch, range_bytes, fan_out):
    monkeypatch.setattr(warc, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(warc, "FAN_OUT", fan_out)
    monkeypatch.setattr(warc, "VOLUME_BYTES", 8_000)
    pages = spark.read.parquet(small + "/pages.parquet")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    index = warc.write(pages, a)
    where = {r.page_id: r for r in index.collect()}
    warc.replicate(index, a, b, lambda page, data: data[:-1] + b"?" if page in (3, 20) else data)
    lost = where[40].volume
    os.remove(tmp_path / "b" / lost)
    cut = next(v for v in sorted({r.volume for r in where.values()}) if v not in {lost, where[3].volume, where[20].volume})
    last = max((r for r in where.values() if r.volume == cut), key=lambda r: r.offset)
    path = tmp_path / "b" / cut
    path.write_bytes(path.read_bytes()[: last.offset + 5])
    want = {(p, "missing in b") for p, r in where.items() if r.volume == lost}
    want |= {(p, "changed") for p in (3, 20) if where[p].volume != lost} | {(last.page_id, "changed")}
    left, right = warc.leaves(index, a), warc.leaves(index, b)
    assert {(r.page_id, r.fault) for r in warc.audit(left, right).collect()} == want
    assert warc.audit(left, left).collect() == []
    none = index.where("page_id < 0")
    assert warc.audit(warc.leaves(none, a), warc.leaves(none, b)).collect() == []


# --- 7: token counts --------------------------------------------------------------------------------


def slow_counts(text, spans, rule):
    encoding, sizes = tc._encoding()
    at, tokens = 0, []
    for i in encoding.encode_ordinary(text):
        tokens.append((at, at + int(sizes[i])))
        at += int(sizes[i])
    chars = [0]
    for c in text:
        chars.append(chars[-1] + len(c.encode()))
    first = lambda b: chars[bisect_right(chars, b) - 1]
    out = []
    for s, e in spans:
        low, high, n, crossing = chars[min(s, len(text))], chars[min(e, len(text))], 0, 0
        for a, z in tokens:
            place = {"first": first(a), "last": first(z - 1), "middle": (a + z - 1) // 2}.get(rule)
            n += (low <= place < high) if rule != "split" else max(0, min(z, high) - max(a, low)) / (z - a)
            crossing += high > low and (a < low < z or a < high < z)
        out.append((n, crossing))
    return out


@pytest.mark.parametrize("rule", tc.RULES)
@pytest.mark.parametrize("text", ["", "\n", "a\n\n b\n", "日本語 テスト\n🙂🙂 x\n\n  y", "One line. And\nanother   line\n" * 20])
def test_attribution(text, rule):
    rnd = random.Random(len(text))
    for spans in (tc.line_spans(text), [tuple(sorted(rnd.choices(range(len(text) + 3), k=2))) for _ in range(8)]):
        n, crossing, _, total = tc.attribute(text, spans, rule)
        want = slow_counts(text, spans, rule)
        assert np.allclose(n, [w for w, _ in want]) and crossing.tolist() == [c for _, c in want]
    n, _, rest, total = tc.attribute(text, tc.line_spans(text), rule)
    assert np.isclose(n.sum(), total) and abs(rest) < 1e-9


def test_attribution_query(spark, small):
    encoding, _ = tc._encoding()
    rows = q.op7_token_attribution(spark, small).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t in documents(spark, small).items():
        assert sum(r.n_tokens for r in by_doc[i]) == len(encoding.encode_ordinary(t))
        assert sorted((r.start, r.end) for r in by_doc[i]) == list(tc.line_spans(t))
        if i % 20 == 0:
            want = slow_counts(t, tc.line_spans(t), "first")
            assert [(r.n_tokens, r.n_crossing) for r in sorted(by_doc[i], key=lambda r: r.section)] == want


def test_sections_from_a_table(spark, docs):
    df = docs([(1, "head body tail"), (2, "no sections"), (3, None)])
    sections = spark.createDataFrame([(1, 0, 4), (1, 4, 9), (1, 90, 99), (1, None, None), (9, 0, 1)], "doc_id long, start long, end long")
    rows = tc.counts(tc.with_sections(df, sections, "doc_id"), sections="sections").collect()
    got = {(r.doc_id, r.start, r.end): r.n_tokens for r in rows}
    assert got == {(1, 0, 0): 0, (1, 0, 4): 1, (1, 4, 9): 1, (1, 90, 99): 0, (1, None, None): 1, (2, None, None): 2}
    assert tc.counts(docs(AWKWARD), rule="split").count() > 0
    assert tc.counts(df.where("doc_id < 0")).collect() == []


# --- 9: quality -------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    rows = q.op9_quality(spark, folder).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(folder + "/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert np.mean([a for a, b in held if b == 1]) >= 0.97


def test_prior_and_risk_on_known_mixtures():
    rnd = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.85):
        def draw(n, positive):
            x = rnd.normal(0, 1, (n, ql.N_FEATURES)).astype(np.float32)
            x[:, :3] += 2.0 if positive else -2.0
            return x

        p, u = draw(3000, True), np.concatenate([draw(int(6000 * share), True), draw(6000 - int(6000 * share), False)])
        model = ql.fit(p, u)
        assert abs(model.prior - share) < 0.06
        good, bad = model.score(draw(2000, True)), model.score(draw(2000, False))
        assert (good[:, None] > bad[None, :]).mean() > 0.98


def test_quality_of_awkward_rows(spark, docs):
    df = docs(AWKWARD)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = ql.classified(df, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in AWKWARD)
    assert all(0 <= r.score <= 1 for r in rows)
    assert ql.accepted(df, labels).columns == df.columns
    nothing = ql.classified(df, labels.where("doc_id < 0")).collect()
    assert {r.score for r in nothing} == {0.5}
    assert ql.classified(df.where("doc_id < 0"), labels).collect() == []


# --- 10: sharding -----------------------------------------------------------------------------------


def slow_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * sd.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 1000, 50_000])
def test_jump(spark, shards):
    rnd = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [rnd.getrandbits(63) for _ in range(400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [r[0] for r in df.select(sd.jump(F.col("k"), shards)).collect()] == [slow_jump(k, shards) for k in keys]


def test_sharding_query(spark, small):
    texts, slots = documents(spark, small), defaultdict(list)
    rows = q.op10_jump_sharding(spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (slow_jump(r.doc_id, 24), slow_jump(r.doc_id, 25))
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_awkward_rows(docs, tmp_path):
    rows = sd.placed(docs(AWKWARD), "doc_id", "text", 3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in AWKWARD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.shard == slow_jump(r.doc_id or 0, 3)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    df = docs(AWKWARD)
    sd.write_shards(df, "doc_id", 3, str(tmp_path / "shards"))
    back = df.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(AWKWARD)
    assert sd.placed(df.where("doc_id < 0"), "doc_id", "text", 3).collect() == []
    by_name = sd.assign(df.select(F.col("text").alias("name")), "name", 5).collect()
    assert all(0 <= r.shard < 5 for r in by_name)


def test_sharding_runs_no_python(spark, small):
    plan = q.op10_jump_sharding(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_numbering_with_null_groups(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 2, i % 7) for i in range(500)], "g int, x int")
    found = defaultdict(list)
    for r in numbered(df, ["g"], ["x"], "n", blocks=4).collect():
        found[r.g].append(r.n)
    assert len(found) == 3 and all(sorted(n) == list(range(len(n))) for n in found.values())


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(small + "/documents.parquet")
    kept = [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(set(r.doc_id for r in docs.select("doc_id").collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
    assert kept[0] > kept[1] > kept[2] >= kept[3] == kept[4]
    direct = q.pipeline(spark, small)
    assert {r.doc_id for r in direct.select("doc_id").collect()} == kept[4]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert direct.select(names).exceptAll(docs.select(names)).count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(small + "/labels.parquet").collect()}
    good = [i for i in kept[0] if labels.get(i) == 1]
    assert np.mean([i in kept[1] for i in good]) >= 0.97


def test_pipeline_takes_awkward_documents(spark, small):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.collect()
        assert stage(spark, docs.where("doc_id < 0"), small).collect() == []


def test_decontamination_judges_texts_not_ids(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "clean words only"), (1, f"before {item} after"), (None, item), (None, "nothing here"), (2, item), (2, item)]
    df = docs(rows).withColumns({"_id": F.lit("i"), "text_hash": F.lit("h")})
    kept = dc.decontaminated(df, tests)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "clean words only"), (None, item), (None, "nothing here")]


def test_quality_keeps_the_callers_columns(spark, small):
    labels = spark.read.parquet(small + "/labels.parquet")
    df = spark.read.parquet(small + "/documents.parquet").withColumns({"score": F.lit(777.0), "_text": F.lit("mine"), "_score": F.lit(5)})
    kept = ql.accepted(df, labels)
    assert kept.columns == df.columns
    assert {(r.score, r._text, r._score) for r in kept.collect()} == {(777.0, "mine", 5)}
    with pytest.raises(ValueError):
        ql.scored(df, None)


def test_pipeline_loses_no_row_by_its_id(spark, small):
    """Ids with two texts: only the text that a stage rejects goes."""
    item = spark.read.parquet(small + "/benchmark.parquet").first().text
    texts = [r.text for r in spark.read.parquet(small + "/documents.parquet").where("length(text) between 300 and 900").limit(3).collect()]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, item)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.drop_near_duplicates(spark, df, small)
    clean = corpus_pipeline.drop_leaks(spark, near, small)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == sorted({(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, item)})
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted([(1, texts[0]), (2, texts[1]), (3, texts[2])])
