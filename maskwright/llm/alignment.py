"""Alignment of two tokenizers' tokens of the same bytes, by merge-path partitioning.

A document is encoded whole by both.  A's token ends and B's token ends are two ascending lists of
byte offsets; where an end of A meets an end of B, a group of tokens ends.  The documents of a batch
lie one after the other in one pair of lists, and that merge is cut into pieces of equal work: a binary search
along each diagonal i + j = constant finds how many ends of A and of B lie before it, so a piece
holds PIECE ends whatever the documents' lengths are.  Pieces are merged each by itself and give the
ends they share; an end of A that is the last of its piece may meet its end of B in the next piece, and such
boundaries are stitched.

A link is a pair of tokens that end together.  Links are summed up over the corpus as pairs of ids,
combined before they are shuffled, so a pair that every document has is one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import written

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE = 1 << 16  # ends of a piece
BATCH_BYTES = 1 << 20  # of text that is aligned at once; a longer text is a batch of its own
BROADCAST_PAIRS = 1 << 19  # id pairs whose counts may go to every task

SPACE_MARK = "\u2581"  # fixed value: how B writes a space


# --- tokens ---------------------------------------------------------------------------------------


class Encoders:
    """Ids of both tokenizers for whole texts, and the bytes of every id.

    A's vocabulary is read from its file and run by a byte-level encoder that knows no special
    tokens, which gives the same ids several times faster.
    """

    def __init__(self, a_path: str, b_path: str):
        vocabulary = Tokenizer.from_file(a_path)
        special = {i for i, t in vocabulary.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = _byte_level(vocabulary)
        ranks = {raw: i for i, raw in enumerate(self.a_bytes) if i not in special}
        self.a = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = _pieces(self.b)
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of A, ids of B) of every text; none of either where its bytes don't come back."""
        none = np.zeros(0, np.int64)
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            raw = (" " + text).encode() if text else b""
            if raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw:
                a = self.a.encode_to_numpy(" " + text, disallowed_special=())
                if self.a.decode_bytes(a.tolist()) == raw:
                    out.append((a.astype(np.int64), np.array(b, np.int64)))
                    continue
            out.append((none, none))
        return out


def _byte_level(vocabulary: Tokenizer) -> list[bytes]:
    """A's tokens: printable bytes are their own characters, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}
    return [bytes(byte.get(c, 0) for c in vocabulary.id_to_token(i) or "") for i in range(vocabulary.get_vocab_size())]


def _pieces(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """B's pieces: a byte by its number, the mark of a space as a space."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
    ]


@cache
def encoders(a_path: str | None = None, b_path: str | None = None) -> Encoders:
    """One pair a worker process; the paths are files that all workers have."""
    return Encoders(a_path or public_tokenizers.path(A_VOCABULARY), b_path or public_tokenizers.path(B_VOCABULARY))


# --- merge path -----------------------------------------------------------------------------------


def split(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` are among the first d of the merge, for every diagonal d.

    Equal ends are merged A's first.  All diagonals are searched at once.
    """
    low = np.maximum(0, diagonals - len(b))
    high = np.minimum(diagonals, len(a))
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        # a[mid] comes before b[d - 1 - mid]: more of a belong to the first d
        more = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(diagonals - 1 - mid, 0, len(b) - 1)])
        low = np.where(more, mid + 1, low)
        high = np.where(open_ & ~more, mid, high)
    return low


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ascending ``a`` and ``b`` of the ends that both have."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(b, a)
    met = np.nonzero(b[np.minimum(at, len(b) - 1)] == a)[0]
    return met, at[met]


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` (strictly ascending ends) of all ends they share.

    Pieces of ``piece`` ends are independent of each other; the boundaries between them are stitched.
    """
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece, dtype=np.int64), total)
    i = split(a, b, diagonals) if len(a) and len(b) else np.minimum(diagonals, len(a))
    j = diagonals - i
    found = []
    for k in range(len(diagonals) - 1):
        x, y = _shared(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        found.append((x + i[k], y + j[k]))
    # an end of A that is the last before a boundary, its equal in B the first behind it
    inner = np.arange(1, len(diagonals) - 1)
    inner = inner[(i[inner] > 0) & (j[inner] < len(b))]
    inner = inner[a[i[inner] - 1] == b[np.minimum(j[inner], len(b) - 1)]] if len(inner) else inner
    found.append((i[inner] - 1, j[inner]))
    x, y = (np.concatenate(c) for c in zip(*found))
    # a boundary that cuts off nothing is met twice
    x, first = np.unique(x, return_index=True)
    return x, y[first]


# --- groups ---------------------------------------------------------------------------------------


@cache
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, right-aligned, and how many there are."""
    width = len(str(max(0, n - 1)))
    powers = 10 ** np.arange(width - 1, -1, -1)
    table = (np.arange(n)[:, None] // powers % 10 + ord("0")).astype(np.uint8)
    return table, np.maximum(1, np.searchsorted(10 ** np.arange(1, width + 1), np.arange(n), "right") + 1)


def written_groups(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: ids of groups that end before the given places, in ASCII."""
    # ids in the order in which they are written, and the mark behind each
    n = len(a) + len(b)
    sizes_a, sizes_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    before_a = np.cumsum(sizes_b) - sizes_b  # ids of B in the groups before
    at_a = np.arange(len(a)) + np.repeat(before_a, sizes_a)
    at_b = np.arange(len(b)) + np.repeat(ends_a, sizes_b)
    ids, marks = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    marks[at_a[ends_a - 1]], marks[at_b[ends_b - 1]] = ord("|"), ord(";")
    table, lengths = _digits(1 << 16)
    width = table.shape[1]
    if n and ids.max() >= len(table):
        raise ValueError("ids of 65,536 and more")
    wide = np.empty((n, width + 1), np.uint8)
    wide[:, :width], wide[:, width] = table[ids], marks
    kept = np.arange(width + 1) >= (width - lengths[ids])[:, None]
    return wide[kept].tobytes()[:-1]


def _aligned(texts: list[str | None], encoder: Encoders, piece: int) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, digest, a ids of links, b ids of links) of every text of a batch."""
    ids = encoder.encode(texts)
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in ids]).astype(np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(encoder.a_sizes[a]), np.cumsum(encoder.b_sizes[b])
    x, y = common_ends(ends_a, ends_b, piece)
    # texts end together too, so every text has its own run of shared ends
    upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
    upto = np.searchsorted(x, upto_a)
    start = 0
    for k in range(len(texts)):
        end, from_a, from_b = int(upto[k]), int(upto_a[k] - n_a[k]), int(upto_b[k] - n_b[k])
        own_a, own_b = a[from_a : upto_a[k]], b[from_b : upto_b[k]]
        at_a, at_b = x[start:end] - from_a, y[start:end] - from_b
        digest = ""
        if end > start:
            digest = hashlib.sha256(written_groups(own_a, own_b, at_a + 1, at_b + 1)).hexdigest()
        yield len(own_a), len(own_b), end - start, digest, own_a[at_a], own_b[at_b]
        start = end


# --- jobs -----------------------------------------------------------------------------------------

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>"
PAIR = 1 << 16  # a pair of ids is a * PAIR + b


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE,
            paths: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links, times) of every row.

    links: the distinct pairs of ids that end together, a * PAIR + b, ascending; times: how often.
    Rows are written, with a number of their own.
    """
    names = [c.split()[0] for c in ALIGNED.split(", ")][1:]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(parts), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoders(*paths)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            edges, size = [0], 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= BATCH_BYTES:
                    edges.append(k + 1)
                    size = 0
            for low, high in zip(edges, [*edges[1:], len(texts)]):
                if low == high:
                    continue
                columns = list(zip(*_aligned(texts[low:high], encoder, piece)))
                pairs = [np.unique(x * PAIR + y, return_counts=True) for x, y in zip(columns[4], columns[5])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip([keys[low:high], *columns[:3], columns[2], columns[3]], kinds)]
                    + [lists([p for p, _ in pairs], pa.int64()), lists([n for _, n in pairs], pa.int32())],
                    names,
                )

    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, ALIGNED.removeprefix("row long, "))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "alignment")


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): occurrences of every linked pair in the corpus; best: none of its B id has more."""
    each = rows.select(F.explode(F.arrays_zip("links", "times")).alias("x")).select("x.links", "x.times")
    counts = written(each.groupBy(F.col("links").alias("pair")).agg(F.sum("times").alias("n")), "links")
    most = counts.groupBy(F.pmod("pair", F.lit(PAIR)).alias("b")).agg(F.max("n").alias("most"))
    # one row for each id of B, fewer than PAIR
    return counts.join(F.broadcast(most), F.pmod("pair", F.lit(PAIR)) == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")
    )


def alignment(
    docs: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE, broadcast: int = BROADCAST_PAIRS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Null and empty texts, and those whose tokens don't give back their bytes, have no tokens: zeros
    and an empty digest.  Repeated rows are aligned and counted each; rows without an id are kept; other columns
    are not read.  Counts of at most ``broadcast`` pairs go to the tasks, more are joined by pair.
    """
    rows = aligned(docs, key, text, piece)
    counts = written(link_counts(rows), "link-counts")
    if counts.count() <= broadcast:
        counts = F.broadcast(counts)
    each = rows.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", "x.links", "x.times")
    sums = each.join(counts, F.col("links") == F.col("pair")).groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return rows.drop("links", "times").join(sums, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
