"""Benchmark decontamination: n-gram seeds, upper bounds, then Smith-Waterman alignment.

1. Every n-gram of the test items is a seed, however frequent it is.
2. A document and an item that share a seed are looked at around the places where they do, unless
   the words they have in common cannot carry a score that is enough.  These bounds never lie below
   the alignment's score, so they drop no pair it would accept; they only spare the chance
   overlaps of stop words the alignment.
3. What is left is aligned.  The score is that of the best local alignment over that of a verbatim
   copy: edited, shortened and re-ordered copies score less than 1, chance overlaps far less than
   MIN_SCORE.  A stretch worth ENOUGH_WORDS is enough in an item of any length; long items are cut
   into overlapping passages, so a stretch across a cut is whole in one of them.

Items go to the tasks in blocks of bounded size, one pass over the documents for each block, so
the documents' texts are never shuffled and a passage that many documents share is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fresh, written

N = 3  # words of a seed
PASSAGE = 256  # words; longer items are cut, each passage half over the one before
MIN_SCORE = 0.4
ENOUGH_WORDS = 24  # matched words an alignment has to be worth at most; MIN_SCORE decides up to 60 words
MIN_WORDS = 8  # an alignment is worth at least so many matched words, or the whole of a shorter item
MATCH, MISMATCH, GAP = 2, -1, 1
BLOCK_BYTES = 8 << 20  # of item texts in one pass
KEPT = 400_000  # words a worker keeps the hash of

_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
FOUND = "doc_id long, item_id long, score double, start long, end long, text_hash long"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words (letters, digits and underscores) of a text."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + count]) * _MIX[k % len(_MIX)]
        out ^= out >> np.uint64(29)
    return out


# --- alignment ------------------------------------------------------------------------------------


def _best_end(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment, and where it ends in ``window``.

    A row of the table at a time; gaps along the row are a running maximum.
    """
    steps = GAP * np.arange(len(window) + 1)
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row - GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(window == word, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def align(item: np.ndarray, window: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """(score, start, end): the best alignment's share of a verbatim copy's score, and its words.

    A score below ``least`` is told without its words.
    """
    best, end = _best_end(item, window)
    if best / (MATCH * len(item)) < least:
        return best / (MATCH * len(item)), end, end
    _, back = _best_end(item[::-1], window[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


# --- seeds ----------------------------------------------------------------------------------------


@dataclass
class Items:
    """A block of benchmark passages, with the n-grams that lead to them."""

    ids: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)

    def add(self, item: int, text: str | None) -> None:
        words = word_hashes(text)
        last = max(0, len(words) - PASSAGE)
        for at in [*range(0, last, PASSAGE // 2), last]:
            if len(words):
                self.ids.append(item)
                self.words.append(words[at : at + PASSAGE])

    def grams(self) -> list[tuple[int, np.ndarray]]:
        """(n, hashes) of every passage; one shorter than N words is one n-gram."""
        return [(min(N, len(w)), grams(w, min(N, len(w)))) for w in self.words]


class Lookup:
    """Finds which of a set of n-gram hashes a document has, and where."""

    def __init__(self, hashes: np.ndarray, sizes: list[int]):
        self.hashes, self.sizes = hashes, sizes
        bits = max(12, int(8 * max(1, len(hashes))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(hashes >> self.shift).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, index into ``hashes``) of every hit."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.sizes if len(self.hashes) else []:
            g = grams(words, n)
            at = np.nonzero(self.maybe[(g >> self.shift).astype(np.int64)])[0]
            index = np.minimum(np.searchsorted(self.hashes, g[at]), len(self.hashes) - 1)
            sure = self.hashes[index] == g[at]
            places.append(at[sure])
            found.append(index[sure])
        return np.concatenate(places), np.concatenate(found)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _best_run(shared: np.ndarray) -> int:
    """The most that a stretch of words can score if each shared word matches and no other does."""
    total = np.cumsum(np.where(shared, MATCH, -min(-MISMATCH, GAP)))
    return int((total - np.minimum.accumulate(np.minimum(total, 0))).max(initial=0))


class Candidates:
    """The stretches of a document that an alignment with a passage could accept."""

    def __init__(self, items: Items, least: float, enough: float):
        self.items = items
        passages = items.grams()
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in passages)])
        passage = np.repeat(np.arange(len(passages)), [len(h) for _, h in passages])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for _, h in passages)])
        order = np.argsort(hashes, kind="stable")
        seeds, self.first, self.leads = np.unique(hashes[order], return_index=True, return_counts=True)
        self.passage, self.place = passage[order], place[order]
        self.lookup = Lookup(seeds, sorted({n for n, _ in passages}))
        self.lengths = np.array([len(w) for w in items.words], np.int64)
        # the share of a verbatim copy's score that each passage needs
        enough_words = np.maximum(np.minimum(least * self.lengths, enough), np.minimum(self.lengths, MIN_WORDS))
        self.needed = enough_words / np.maximum(self.lengths, 1)
        # the distinct words of every passage, as places in the vocabulary, and how often it has them
        self.vocabulary, known = np.unique(np.concatenate([np.zeros(0, np.uint64), *items.words]), return_inverse=True)
        self.known = np.split(known, np.cumsum(self.lengths)[:-1]) if len(passages) else []
        distinct = [np.unique(k, return_counts=True) for k in self.known]
        self.n_distinct = np.array([len(k) for k, _ in distinct], np.int64)
        self.at = np.cumsum(self.n_distinct) - self.n_distinct
        self.word = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in distinct)])
        self.times = np.concatenate([np.zeros(0, np.int64), *(n for _, n in distinct)])

    def find(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(passage, start, end) of the merged stretches around shared seeds."""
        at, seed = self.lookup.find(words)
        if not len(at):
            return
        n = self.leads[seed]
        lead = _ranges(self.first[seed], n)
        passage, shift = self.passage[lead], np.repeat(at, n) - self.place[lead]
        index = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.where(self.vocabulary[index] == words, index, len(self.vocabulary))

        # a word of the document matches one of the passage at most
        met = np.unique(passage)
        sizes = self.n_distinct[met]
        entry = _ranges(self.at[met], sizes)
        there = np.bincount(known, minlength=len(self.vocabulary) + 1)
        shared = np.add.reduceat(np.minimum(self.times[entry], there[self.word[entry]]), np.cumsum(sizes) - sizes)
        met = met[shared / self.lengths[met] >= self.needed[met]]
        if not len(met):
            return
        kept = np.isin(passage, met)
        order = np.lexsort((shift[kept], passage[kept]))
        passage, shift = passage[kept][order], shift[kept][order]
        m = self.lengths[passage]
        start, end = np.maximum(0, shift - m), np.minimum(len(words), shift + 2 * m)
        apart = (passage[1:] != passage[:-1]) | (start[1:] > end[:-1])
        first = np.nonzero(np.concatenate([[True], apart]))[0]
        last = np.append(first[1:], len(passage)) - 1

        mark = np.zeros(len(self.vocabulary) + 1, bool)
        for p, a, z in zip(passage[first].tolist(), start[first].tolist(), end[last].tolist()):
            least, full = self.needed[p], MATCH * self.lengths[p]
            mark[self.known[p]] = True
            most = _best_run(mark[known[a:z]])
            mark[self.known[p]] = False
            if most / full < least:
                continue
            mark[known[a:z]] = True
            most = _best_run(mark[self.known[p]])
            mark[known[a:z]] = False
            if most / full >= least:
                yield p, a, z


def _align_block(docs: DataFrame, candidates: Candidates) -> DataFrame:
    """Seed hits and alignments of one block."""
    items = candidates.items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for doc, text, mark in zip(*(c.to_pylist() for c in b.columns)):
                    words = word_hashes(text)
                    best: dict[int, tuple[float, int, int]] = {}
                    for passage, a, z in candidates.find(words):
                        score, start, end = align(items.words[passage], words[a:z], candidates.needed[passage])
                        item = items.ids[passage]
                        if score >= candidates.needed[passage] and (item not in best or score > best[item][0]):
                            best[item] = score, a + start, a + end
                    if best:
                        spans = [m.span() for m in _WORD.finditer(text.lower())]
                        rows += [(doc, i, s, spans[a][0], spans[z - 1][1], mark) for i, (s, a, z) in best.items()]
                columns = zip(*rows) if rows else [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "score", "start", "end", "text_hash"]
                )

    return docs.mapInArrow(run, FOUND)


def _found(docs: DataFrame, benchmark: DataFrame, key: str, text: str, least: float, enough: float) -> DataFrame:
    """``leaks`` with the hash of the document's text."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    tests = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n_bytes = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-n_bytes // BLOCK_BYTES) or 1
    cut = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for k in range(blocks):
        items = Items()
        for r in cut.where(F.col("block") == k).orderBy("item_id", "text").collect():
            items.add(r.item_id, r.text)
        found = _align_block(rows, Candidates(items, least, enough))
        out = found if out is None else out.unionByName(found)
    return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = MIN_SCORE,
    enough: float = ENOUGH_WORDS,
) -> DataFrame:
    """(doc_id, item_id, score, start, end) of every document that holds a copy of an item.

    A copy is worth ``least`` of the item or ``enough`` matched words, whichever is less, so the
    score of a stretch of an item of more than 60 words can lie below ``least``.  It is the share of
    the item, or of the passage of an item of more than PASSAGE words.

    start and end are character places in the lower-cased text.  Null or wordless texts and
    items take no part; an item of fewer than N words is looked up as a whole; repeated rows and
    items give repeated results.  Other columns are not read.
    """
    return _found(docs, benchmark, key, text, least, enough).drop("text_hash")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = MIN_SCORE,
    enough: float = ENOUGH_WORDS,
) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, with their columns.

    A row is known by its id and the hash of its text, so another text of the same id stays.  Rows
    without an id are kept.
    """
    found = written(_found(docs, benchmark, key, text, least, enough), "leaks")
    own_id, own_hash = fresh(docs, "_id", "_hash")
    dropped = found.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    same = (F.col(key).cast("long") == F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash))
    return docs.join(dropped, same, "left_anti")
