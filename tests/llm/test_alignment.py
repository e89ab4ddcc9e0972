"""Token alignment against a plain merge of whole encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from maskwright.llm import alignment as al, queries as q

from .cases import AWKWARD

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte-level alphabet, from the tokenizer itself."""
    from tokenizers.decoders import ByteLevel
    from tokenizers.pre_tokenizers import ByteLevel as Split

    own = {}
    for text in [chr(c) for c in range(0x80)] + [chr(c) for c in range(0x80, 0x800, 7)] + [chr(c) for c in range(0x800, 0xD800, 0x400)] + ["￿", "\U0001F642", "\U000A0000", "\U00100000"]:
        for word, _ in Split(add_prefix_space=False, use_regex=False).pre_tokenize_str(text):
            own |= dict(zip(word, text.encode()))
    assert ByteLevel()
    return own


BYTE = byte_of()


def slow_tokens(text):
    raw = (" " + (text or "")).encode()
    a = A.encode(" " + (text or ""), add_special_tokens=False)
    b = B.encode(text or "")
    a_bytes = [bytes(BYTE[c] for c in t) for t in a.tokens]
    b_bytes = []
    for i in b:
        p = B.id_to_piece(i)
        b_bytes.append(bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode())
    if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return [], []
    return list(zip(a.ids, np.cumsum([len(x) for x in a_bytes]).tolist())), list(zip(b, np.cumsum([len(x) for x in b_bytes]).tolist()))


def slow_groups(a, b):
    shared = sorted({e for _, e in a} & {e for _, e in b})
    out, before = [], 0
    for end in shared:
        out.append(([i for i, e in a if before < e <= end], [i for i, e in b if before < e <= end]))
        before = end
    return out


def slow_report(texts):
    found = []
    for key, text in texts:
        a, b = slow_tokens(text)
        groups = slow_groups(a, b)
        links = [(x[-1], y[-1]) for x, y in groups]
        found.append((key, a, b, groups, links))
    counts = Counter(link for f in found for link in f[4])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for key, a, b, groups, links in found:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            key, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if groups else "",
        ))
    return Counter(out)


ODD = [
    "two  spaces and   three ", " starts with one", "tabs\t and\n\n lines\r\n \n x", "a\xa0b 　c", "x▁y", "▁", " ", "  ",
    "<|endoftext|> <s> </s> <unk> <0x41>", "café ﬁ № ½ é", "日本語 テスト ١٢٣", "🙂🙂 👩‍👩‍👧", "don't we'll I'm 'tis", "a\x1c b\x85 c​ d",
    "﻿bom", "12345 6.78 $9,99", "ÀÉ" * 50, "\x00\x01 \x7f", "...   ", "\n", "word\n next \tx",
]


@pytest.mark.parametrize("broadcast", [0, 1 << 19])
def test_awkward_texts(docs, broadcast):
    rows = [(i, t if t is None else t[:3000]) for i, t in AWKWARD] + [(100 + k, t) for k, t in enumerate(ODD)]
    got = Counter(map(tuple, al.alignment(docs(rows), broadcast=broadcast, piece=16).collect()))
    assert got == slow_report(rows)


def test_query_equals_plain_merge(spark, small):
    df = q.op13_token_alignment(spark, small)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(small + "/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, df.collect())) == slow_report(rows)


def test_empty_table(docs):
    assert al.alignment(docs([])).collect() == []


def test_ids_of_random_texts():
    rng, encoder = random.Random(3), al.encoders()
    parts = [" ", "  ", "\n", "\t", "a", "the", "Über", "'s", "12", "日本", ".", "!?", "\r\n", "\xa0", "é", "<s>", "<|endoftext|>", "x\n \ny"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    for text, (a, b) in zip(texts, encoder.encode(texts)):
        want = slow_tokens(text)
        assert (a.tolist(), b.tolist()) == ([i for i, _ in want[0]], [i for i, _ in want[1]]), repr(text)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 10_000])
def test_pieces_are_stitched(piece):
    rng = random.Random(piece)
    for _ in range(40):
        top = rng.randrange(1, 60)
        a, b = (np.array(sorted(rng.sample(range(1, top + 1), rng.randrange(0, top + 1))), np.int64) for _ in "ab")
        x, y = al.common_ends(a, b, piece)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_diagonals_cut_equal_work():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(1, 500, 300)) for _ in "ab")
    merged = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
    d = np.arange(len(merged) + 1)
    assert al.split(a, b, d).tolist() == [sum(side == 0 for _, side in merged[:k]) for k in d]
