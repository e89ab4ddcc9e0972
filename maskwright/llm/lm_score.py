"""Stupid-backoff language-model scores of documents, from counts of the whole corpus.

    S(w | u v) = f(u v w) / f(u v)   where the n-gram is known,
    S(w | u v) = alpha * S(w | v)   otherwise, down to
    S(w) = f(w) / N,

with counts f from all *other* documents: a document's own words never support it, so the
backoff is taken wherever an n-gram is new.  A word that no other document has counts as one
occurrence.  The order, the words of the longest n-gram, is a parameter; one run gives the scores of
all orders up to it.

Count tables are partitioned by n-gram hash and joined to the documents' n-grams in packed form.
Texts never move: a chunk is a run of rows of one input split, in file order, and both passes over
the documents cut the same chunks.  In the first a chunk sends each distinct n-gram once, with its
number there, to the partition of the count table that its hash names.  The partition sums
them up and answers every chunk with the totals of its n-grams, in their order; answers are written
by chunk.  In the second a chunk reads its answers, looks up its documents' n-grams and sums each
document's scores.  What moves grows with the distinct n-grams of a chunk, never with a word's
frequency, so there is no hot key, and repeated rows are spread like any others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder
from .common import written
from .decontaminate import grams

ALPHA = 0.4
ORDER = 3
CHUNK_BYTES = 5 << 20
TOTAL = np.uint64(0)  # the key under which all words are counted
BUCKET_CHUNKS = 16  # chunks whose answers are in one file
GROUP_BYTES = 4 << 20  # of a row group of answers: a chunk reads the groups it lies in, not the whole file
TEXTS_AT_ONCE = 256  # that leave an Arrow batch together
BLOCKS = "part int, chunk long, keys binary, n binary"
SCORES = "doc_id long, n_words long, n_pairs_known long, n_words_unseen long, log10_score double, n_known array<long>, log10_scores array<double>, score_per_word double"


_WORD = re.compile(r"\w+")


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a text; nothing is kept, as most words are rare."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte: the upper bytes are zeros and compress."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").ravel(), dtype=np.uint64)


def _packed_counts(n: np.ndarray) -> bytes:
    """Numbers with as many bytes each as the largest needs, byte by byte, after that width."""
    n = np.asarray(n, "<i8")
    width = next(w for w in (1, 2, 4, 8) if int(n.max(initial=0)) < 1 << (8 * w - 1))
    return bytes([width]) + n.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T
    return np.ascontiguousarray(planes).view(f"<i{raw[0]}").ravel().astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a key; ascending keys have ascending partitions."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of n of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Chunk:
    """The n-grams of some documents: their hashes, the distinct ones, and what each document has."""

    def __init__(self, texts: list[str | None], order: int):
        docs = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(d) for d in docs], np.int64)
        words = np.concatenate([np.zeros(0, np.uint64), *docs])
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), self.sizes)
        left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(words))  # words from here to the document's end
        # where n-grams start, and their hashes, for every n
        self.starts = [np.nonzero(left >= n)[0].astype(np.int32) for n in range(1, order + 1)]
        del docs, left
        hashes = [words, *(grams(words, n)[self.starts[n - 1]] for n in range(2, order + 1))]
        self.cuts = np.cumsum([len(h) for h in hashes])[:-1]
        found = np.concatenate(hashes)
        del hashes, words
        by = np.argsort(found, kind="stable").astype(np.int32)  # equal n-grams together, those of a document beside each other
        ordered = found[by]
        del found
        new_key = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        self.keys = ordered[new_key]
        del ordered
        doc = np.concatenate([self.doc[s] for s in self.starts])[by]
        new_run = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(by)]
        del doc
        self.counts = np.diff(np.append(np.nonzero(new_key)[0], len(by))).astype(np.int32)
        sizes = np.diff(np.append(np.nonzero(new_run)[0], len(by))).astype(np.int32)
        self.key_of, self.own = np.empty(len(by), np.int32), np.empty(len(by), np.int32)
        self.key_of[by] = np.cumsum(new_key, dtype=np.int32) - 1
        self.own[by] = np.repeat(sizes, sizes)

    def scores(self, totals: np.ndarray, n_all: int, alpha: float) -> list[tuple]:
        """Of every document: words, known pairs, unseen words, log10 score by pairs, known n-grams of each n from 2
        on, log10 score of each order from 1 on, and the highest order's a word; no words score 0."""
        n_docs, n_words = len(self.sizes), len(self.doc)
        per_doc = lambda x, at: np.bincount(self.doc[at], x, n_docs)
        f, *longer = np.split(totals[self.key_of] - self.own, self.cuts)
        every = np.arange(n_words)
        unseen = per_doc(f <= 0, every).astype(np.int64)
        s = np.maximum(f, 1) / np.maximum(1, n_all - self.sizes)[self.doc]
        known, sums, context = [], [per_doc(np.log10(s), every)], f
        for n, (start, g) in enumerate(zip(self.starts[1:], longer), 2):
            last = start + n - 1
            s = s.copy()
            s[last] = np.where(g > 0, g / np.maximum(context[start], 1), alpha * s[last])
            context = np.zeros(n_words, np.int64)
            context[start] = g
            known.append(per_doc(g > 0, start).astype(np.int64))
            sums.append(per_doc(np.log10(s), every))
        rows = zip(self.sizes.tolist(), unseen.tolist(), np.stack(known, 1).tolist(), np.stack(sums, 1).tolist())
        return [(n, k[0], u, x[1], k, x, x[-1] / n if n else 0.0) for n, u, k, x in rows]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list, list]]:
    """(chunk, ids, texts) of batches (id, text, file, start): runs of rows of one split, about ``most`` bytes each."""
    place, k, ids, texts, size = None, 0, [], [], 0

    def name() -> int:
        return xxhash.xxh64_intdigest(f"{place[0]}\n{place[1]}\n{k}".encode()) >> 1

    for part in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
        for i, t, *at in zip(*(c.to_pylist() for c in part.columns)):
            if texts and (at != place or size >= most):
                yield name(), ids, texts
                ids, texts, size, k = [], [], 0, k + 1
            if at != place:
                place, k = at, 0
            ids.append(i)
            texts.append(t)
            size += len(t or "")
    if texts:
        yield name(), ids, texts


def _of_files(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text, file, start) of rows that come from files in a fixed order, else of a written copy."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    plan = docs.select(key, text)._jdf.queryExecution().executedPlan().toString()
    if "FileScan" not in plan or "Exchange" in plan or "Join" in plan:
        rows = written(rows, "lm-rows")
    return rows.withColumns({"file": F.input_file_name(), "start": F.input_file_block_start()})


def _answers(system: fs.FileSystem, folder: str, chunk: int) -> np.ndarray:
    """The totals that a chunk has got, in the order of its n-grams."""
    got = parquet.read_table(folder, columns=["part", "n"], filters=[("chunk", "=", chunk)], filesystem=system, partitioning=None)
    raw = got.column("n").to_pylist()
    return np.concatenate([_counts(raw[i]) for i in np.argsort(got.column("part").to_numpy(), kind="stable")])


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_pairs_known, n_words_unseen, log10_score, n_known, log10_scores, score_per_word)
    of every row of ``docs``.

    n_known: the known n-grams of 2, 3, ... ``order`` words.  log10_scores: the scores by n-grams of up
    to 1, 2, ... ``order`` words.  n_pairs_known and log10_score are those of pairs; score_per_word is the
    last of log10_scores over the words, and tells texts of any length apart.

    Words are lower-cased runs of letters, digits and underscores; the first words of a
    document have shorter contexts.  Null and wordless texts score 0.  Repeated rows count as documents of their
    own.  Other columns are not read.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark, most = docs.sparkSession, CHUNK_BYTES
    rows = _of_files(docs, key, text)
    shape = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct("file", "start").alias("splits")).first()
    parts = -(-(shape.bytes or 0) // most) or 1
    buckets = -(-max(parts, shape.splits) // BUCKET_CHUNKS) or 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in _chunks(batches, most):
            chunk = Chunk(texts, order)
            # TOTAL is the least key there is
            keys, n = np.append(TOTAL, chunk.keys), np.append(chunk.sizes.sum(), chunk.counts)
            part = part_of(keys, parts)
            some, first = np.unique(part, return_index=True)
            edges = [*first.tolist(), len(keys)]
            for at in range(0, len(some), 8):
                cut = [slice(edges[i], edges[i + 1]) for i in range(at, min(at + 8, len(some)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some[at : at + 8].astype(np.int32)), pa.array([name] * len(cut), pa.int64()),
                     pa.array([_packed_keys(keys[c]) for c in cut], pa.binary()), pa.array([_packed_counts(n[c]) for c in cut], pa.binary())],
                    ["part", "chunk", "keys", "n"],
                )

    def answer(t: pa.Table) -> pa.Table:
        asked = [_keys(k) for k in t.column("keys").to_pylist()]
        keys, totals = _sums(np.concatenate(asked), np.concatenate([_counts(n) for n in t.column("n").to_pylist()]))
        return pa.table({
            "part": t.column("part"), "chunk": t.column("chunk"),
            "n": [_packed_counts(totals[np.searchsorted(keys, k)]) for k in asked],
        })

    place = shared_folder(spark, "lm-answers")
    answers = rows.mapInArrow(ask, BLOCKS).groupBy("part").applyInArrow(answer, "part int, chunk long, n binary")
    named = answers.withColumn("bucket", F.pmod("chunk", F.lit(buckets)).cast("int"))
    ordered = named.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk", "part")
    ordered.write.partitionBy("bucket").option("parquet.block.size", GROUP_BYTES).parquet(place)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64()]
        system, folder = fs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{place}")
        for name, ids, texts in _chunks(batches, most):
            chunk = Chunk(texts, order)
            totals = _answers(system, f"{folder}/bucket={name % buckets}", name)
            if len(totals) != len(chunk.keys) + 1:
                raise ValueError("the rows of an input split have changed since they were counted")
            found = chunk.scores(totals[1:], int(totals[0]), alpha)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip([ids, *zip(*found)], kinds)], [c.split()[0] for c in SCORES.split(", ")],
            )

    return rows.mapInArrow(tell, SCORES)
