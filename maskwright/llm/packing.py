"""Best-fit packing of token sequences, with exact complements found by hashing.

Packing looks at lengths only, and there are at most ``capacity`` of them.  The plan is made
from the counts of each length: for the longest length left, the gap is looked up among the
single lengths, then the sums of two and of three lengths, that are still available; a
combination that fills the gap exactly is consumed as often as the counts allow.  What finds
no exact complement is placed best fit, longest first, again by counts.  The plan is a short
list of (length, range of ranks, sequences, offset); pieces are numbered within their length
in Spark and look up their place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import numbered, written
from .token_ids import word_encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- the plan ---------------------------------------------------------------------------------


def _times(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often this combination is available."""
    return min(int(counts[x]) // n for x, n in Counter(lengths).items())


def _first(counts, base, candidates):
    """The first candidate that can be consumed together with ``base``."""
    for c in candidates:
        if _times(counts, (*base, *c)):
            return c
    return None


def complement(counts: np.ndarray, base: tuple[int, ...], gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, large ones first."""
    if gap <= 0:
        return () if gap == 0 else None
    there = counts > 0
    if there[gap] and (found := _first(counts, base, [(gap,)])):
        return found
    # pairs: both lengths are there, the larger first
    larger = np.arange(gap - 1, (gap - 1) // 2, -1)
    larger = larger[there[larger] & there[gap - larger]]
    if found := _first(counts, base, ((int(a), gap - int(a)) for a in larger)):
        return found
    # sums of two available lengths, as a table from the product of their indicators
    size = 1 << (2 * len(counts)).bit_length()
    sums = np.rint(np.fft.irfft(np.fft.rfft(there.astype(float), size) ** 2, size)[: len(counts)]) > 0
    largest = np.arange(gap - 2, 0, -1)
    largest = largest[there[largest] & sums[gap - largest]] if len(largest) else largest

    def triples():
        for a in map(int, largest):
            rest = gap - a
            b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
            for x in map(int, b[there[b] & there[rest - b]]):
                yield a, x, rest - x

    return _first(counts, base, triples())


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths, and in how many sequences each is used; together all of ``counts``.

    counts[x]: pieces of length x, for x up to ``capacity``; the sum over an empty combination
    never occurs.  Every step uses up a length or closes a group of like sequences, so the plan
    has at most a few entries for each length, however many pieces there are.
    """
    counts = counts.copy()
    out = []
    for length in range(capacity, 0, -1):
        while counts[length] and (rest := complement(counts, (length,), capacity - length)) is not None:
            lengths = (length, *rest)
            n = _times(counts, lengths)
            for x in lengths:
                counts[x] -= n
            out.append((lengths, n))
    gaps: list[int] = []
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def keep(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in open_by_gap:
            insort(gaps, gap)
        open_by_gap.setdefault(gap, []).append((lengths, n))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                lengths, n = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap], gaps[at]
                fits = min(gap // length, left)  # best fit puts the next one here as well
                whole = min(n, left // fits)
                keep(lengths + (length,) * fits, whole)
                if n > whole:
                    keep(lengths, n - whole)
                left -= whole * fits
            else:
                fits = min(capacity // length, left)
                whole = left // fits
                keep((length,) * fits, whole)
                left -= whole * fits
    return out + [group for gap in gaps for group in open_by_gap[gap]]


def places(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length: (length, first rank, first sequence, offset), sorted by the first two."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in groups:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


# --- jobs -------------------------------------------------------------------------------------


def pieces(
    docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False
) -> DataFrame:
    """The token ids of every document with its end id, cut every ``capacity`` ids.

    A null text has the end id only, so every row gives a piece.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for whole in batches:
            encoded = encoder.documents(whole.column(1))
            for at in range(0, whole.num_rows, 512):
                rows = []
                for doc, ids in zip(whole.column(0).slice(at, 512).to_pylist(), encoded):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start : start + capacity].astype("<u4").tobytes()
                        rows.append((doc, k, start, len(raw) // 4, zlib.crc32(raw), *([raw] if with_ids else [])))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    schema = PIECES + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; sequences hold at most ``capacity``.

    rows: a written table with a column ``length`` of 1 to ``capacity``, and columns that tell
    its rows apart.  Rows that are equal in all columns are places apart all the same.  Only
    the counts by length, at most ``capacity`` numbers, reach the driver.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        if length is None or not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length}: cut to 1 to {capacity} first")
        counts[length] = n
    lengths, ranks, sequences, offsets = places(plan(counts, capacity))
    # a length and a rank in one number
    shift = 1 << 50
    from_rank = lengths * shift + ranks
    order = [c for c in rows.columns if c != "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(names.index(c)).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(from_rank, length * shift + rank, side="right") - 1
            placed = [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            kept = [b.column(i) for i, c in enumerate(names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays(kept + placed, out_names)

    ranked = numbered(rows, ["length"], order, "_rank")
    names = ranked.columns
    out_names = [c for c in names if c != "_rank"] + ["sequence_id", "offset"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInArrow(run, kept + ", sequence_id long, offset long")


def packed(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    return pack(written(pieces(docs, key, text, capacity, tokenizer), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from placed pieces with ``ids``; a sequence has at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
