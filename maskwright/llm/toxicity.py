"""Toxicity classifier: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text is the set of its hashed words, their stems (first letters, as inflected words are rare
each), word pairs and pairs with words left out between them, each with value 1.  Every coordinate has its own learning rate, alpha / (beta + root of its squared
gradients), and an L1 threshold that keeps the weight of a coordinate at exactly zero until enough
gradient has gathered there.  What is left after the fit are a few thousand weights, which go to
the tasks; the table they are looked up in has 2^BITS entries at any size of the corpus.

The fit takes at most about EXAMPLES labelled rows that are not held out, chosen by hash, whole
texts each.  They are written once as hashed features and dealt to PARTS parts.  In a round every
part runs EPOCHS times over its rows from the state shared so far and returns what it changed, and
each coordinate moves by the mean over the parts that touched it.  A lost executor costs a round's
part; the features are read again from the shared folder.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import written
from .decontaminate import grams
from .quality import fold

EXAMPLES = 24_000  # bound of the labelled rows of the fit
BITS = 20
NGRAM = 2  # longest run of words
SKIPS = (1, 2)  # words left out between the two words of a skip-gram
STEMS = (4, 6)  # letters
PARTS = 4
ROUNDS = 2  # in which the parts meet
EPOCHS = 3  # of a part in a round
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.0, 1.0
THRESHOLD = 0.5
BLOCK = 1 << 12  # coordinates of a row of the state

KEPT = 200_000  # words a worker keeps the hashes of; a bound on memory only

_WORD = re.compile(r"\w+")
_SKIP_SEED = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


# --- features -----------------------------------------------------------------------------------


class _Hashes(dict):
    """Word -> hashes of the word and of its stems, as bytes."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        found = [xxhash.xxh64_intdigest(word.encode())]
        found += [xxhash.xxh64_intdigest(word[:n].encode(), n) for n in STEMS]
        raw = self[word] = np.array(found, "<u8").tobytes()
        return raw


_hashes = _Hashes()


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """Buckets of a text's n-grams and skip-grams, repeats included; none where there is no word.

    Words are lower-cased runs of letters, digits and underscores.
    """
    raw = b"".join(map(_hashes.__getitem__, _WORD.findall((text or "").lower())))
    words, *stems = np.frombuffer(raw, "<u8").reshape(-1, 1 + len(STEMS)).T.copy()
    found = [*(grams(words, n) for n in range(1, NGRAM + 1)), *stems]
    for skip in SKIPS:
        first, second = words[: -skip - 1], words[skip + 1 :]
        mixed = (first * _SKIP_SEED[0] + np.uint64(skip)) ^ (second * _SKIP_SEED[1])
        found.append(mixed ^ (mixed >> np.uint64(31)))
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def packed(at: np.ndarray) -> bytes:
    """Ascending buckets as their distances, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<u4"), dtype=np.int64)


# --- model --------------------------------------------------------------------------------------


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class State:
    """z and n of every bucket; the last coordinate is the bias, which has no L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return (np.sign(z) * L1 - z) * (np.abs(z) > L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def bias(self) -> float:
        return -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One example: its distinct buckets and its label."""
        w, bias = self.weights(at), self.bias()
        g = _sigmoid(w.sum() + bias) - label
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown
        n = self.n[-1]
        self.z[-1] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * bias
        self.n[-1] = n + g * g


@dataclass
class Model:
    """The weights other than zero, ascending buckets."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def table(self) -> np.ndarray:
        table = np.zeros(1 << self.bits, np.float32)
        table[self.buckets] = self.weights
        return table

    def score(self, text: str | None, table: np.ndarray) -> float:
        """Probability of label 1; a text without words has the bias alone."""
        at = buckets(text, self.bits)
        hit = np.unique(at[table[at] != 0])
        return float(_sigmoid(table[hit].sum(dtype=np.float64) + self.bias))


# --- jobs ---------------------------------------------------------------------------------------


def examples(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int = EXAMPLES, bits: int = BITS,
) -> DataFrame:
    """(part, place, label, x) of the chosen rows that are not held out, written.

    An id that ``labels`` marks both 0 and 1, or neither, teaches nothing.  Of several texts of an
    id the one with the least hash is taken, so a repeated id is one example.  place orders the examples of a part.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where(F.col("label") == F.col("other")).drop("other")
    )
    share = min(1.0, bound / max(1, marked.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    # about ``bound`` rows of two numbers, so they can go to every task
    chosen = F.broadcast(marked.withColumn("place", place).where(F.col("place") < int(share * (1 << 40))))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = (
        texts.join(chosen, "doc_id")
        .groupBy("doc_id", "label", "place").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [packed(np.unique(buckets(t, bits))) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(x, pa.binary())], ["part", "place", "label", "x"]
            )

    rows = one.select(F.pmod(F.hash("place"), F.lit(PARTS)).alias("part"), "place", F.col("label").cast("int"), "text")
    return written(rows.mapInArrow(run, "part int, place long, label int, x binary"), "toxicity")


def _round(rows: DataFrame, state: State, epochs: int) -> DataFrame:
    """(block, d): the mean change of z and n over the parts, of the blocks that any has touched."""
    z, n = state.z, state.n

    def run(part: pa.Table) -> pa.Table:
        own = State(len(z) - 1)
        own.z, own.n = z.copy(), n.copy()
        labels, raw = part.column("label").to_pylist(), part.column("x").to_pylist()
        for _ in range(epochs):
            for i in np.argsort(part.column("place").to_numpy(), kind="stable"):
                own.learn(unpacked(raw[i]), labels[i])
        dz, dn = own.z - z, own.n - n
        some = np.unique(np.nonzero(dn)[0] // BLOCK)
        cut = [slice(k * BLOCK, (k + 1) * BLOCK) for k in some.tolist()]
        return pa.table({
            "block": pa.array(some, pa.int32()),
            "d": pa.array([np.stack([dz[c], dn[c]]).astype("<f4").tobytes() for c in cut], pa.binary()),
        })

    def merge(block: pa.Table) -> pa.Table:
        parts = sorted(block.column("d").to_pylist())  # one of each part; sorted, as sums of floats depend on their order
        changes = [np.frombuffer(d, "<f4").reshape(2, -1).astype(np.float64) for d in parts]
        mean = (sum(changes) / np.maximum(sum(c[1] > 0 for c in changes), 1)).astype("<f4")
        return pa.table({"block": block.column("block").slice(0, 1), "d": pa.array([mean.tobytes()], pa.binary())})

    changes = rows.groupBy("part").applyInArrow(run, "block int, d binary")
    return changes.groupBy("block").applyInArrow(merge, "block int, d binary")


def fit(rows: DataFrame, bits: int = BITS, rounds: int = ROUNDS, epochs: int = EPOCHS) -> Model:
    """Minimise the logistic loss over ``examples``; without examples every score is 0.5."""
    state = State(1 << bits)
    for _ in range(rounds):
        for r in _round(rows, state, epochs).collect():  # at most 2^bits / BLOCK + 1 rows
            d = np.frombuffer(r.d, "<f4").reshape(2, -1)
            at = slice(r.block * BLOCK, r.block * BLOCK + d.shape[1])
            state.z[at] += d[0]
            state.n[at] += d[1]
    w = state.weights(slice(0, 1 << bits))
    kept = np.nonzero(w)[0]
    return Model(kept, w[kept].astype(np.float32), float(state.bias()), bits)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    return fit(examples(docs, labels, key, text, label))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1); the other columns don't pass through the worker."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = model.table()
        for texts in batches:
            yield pd.Series([model.score(t, table) for t in texts], dtype="float64")

    return docs.withColumn(name, score(F.coalesce(F.col(text), F.lit(""))))


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, null and empty texts included.

    predicted is 1 where the score is at least THRESHOLD.  Rows without an id are scored and count
    as the fold of the empty string; repeated rows are kept; other columns are not read.
    """
    model = train(docs, labels, key, text)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return scored(narrow, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
