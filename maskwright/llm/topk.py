"""Exact top-k search: tiled integer matrix products and a tree of merged lists.

Vectors are packed into blocks, each a matrix in one row.  A grid of tiles, a block of queries
against a block of candidates, is spread over the cluster; every tile gives at most k hits for
each query, and those lists are merged a few at a time until one is left.  No step holds
more than one tile, and what leaves a tile is bounded by k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

QUERY_BLOCK = 1024  # queries in a block, about
CANDIDATE_BLOCK = 4096  # candidates in a block, about
FAN_IN = 16  # lists merged at a time
PACKED = "dim int, block int, ids binary, matrix binary"


def quantised(df: DataFrame, key: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(vec_id, dim, v): the vectors as integers floor(scale * x).

    Rows without an id and vectors that are null or hold null, NaN or infinity take no part.
    Equal rows count once.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    return (
        df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        .where(finite)
        .select(F.col(key).cast("long").alias("vec_id"), F.size(vector).alias("dim"), whole.alias("v"))
        .distinct()
    )


def blocks(rows: DataFrame, count: int) -> DataFrame:
    """Pack (vec_id, dim, v) into ``count`` blocks for each dimension, one row each."""

    def pack(t: pa.Table) -> pa.Table:
        dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        ids = t.column("vec_id").to_numpy()
        flat = t.column("v").combine_chunks().flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        matrix = flat.reshape(len(ids), dim)[order] if dim else np.zeros((len(ids), 0), np.int64)
        kind = np.int16 if dim and np.abs(matrix).max() < 2**15 else np.int64
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()),
            "ids": [ids[order].tobytes()], "matrix": [np.dtype(kind).char.encode() + matrix.astype(kind).tobytes()],
        })

    # hashed with the vector, so rows that share an id are spread as well
    cut = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int"))
    return cut.groupBy("dim", "block").applyInArrow(pack, PACKED)


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    flat = np.frombuffer(raw, np.dtype(raw[:1].decode()), offset=1)
    return flat.reshape(rows, -1) if rows and len(flat) else flat.reshape(rows, 0)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products as int64: in doubles where every sum is exact in them, else modulo 2**64."""
    dim = queries.shape[1]
    top = [int(np.abs(m).max(initial=0)) for m in (queries.astype(object) if queries.dtype == object else queries, candidates)]
    if dim * max(1, top[0]) * max(1, top[1]) < 2**53:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    return queries.astype(np.int64) @ candidates.astype(np.int64).T


def best(query_ids, queries, candidate_ids, candidates, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best of one tile; ties go to smaller ids.

    candidate_ids are ascending.  Candidates with the query's own id are left out.
    """
    scores = products(queries, candidates)
    n = len(candidate_ids)
    keep = min(n, k + 1)
    for q, row in zip(query_ids, scores):
        if keep < n:
            # everything above the (k + own rows)th score, and of its ties the smallest ids
            own = np.searchsorted(candidate_ids, q, "right") - np.searchsorted(candidate_ids, q, "left")
            want = min(n, k + int(own))
            edge = np.partition(row, n - want)[n - want]
            above, ties = np.nonzero(row > edge)[0], np.nonzero(row == edge)[0]
            at = np.concatenate([above, ties[: want - len(above)]])
        else:
            at = np.arange(n)
        at = at[candidate_ids[at] != q]
        at = at[np.lexsort((candidate_ids[at], -row[at]))][:k]
        yield int(q), candidate_ids[at], row[at]


def search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product.

    Both sides are (vec_id, dim, v).  Only vectors of the query's dimension are compared and
    a query is never its own candidate; ties go to the smaller vec_id, and a query with fewer
    candidates gets them all.  Ids that two vectors share give a hit for each.
    """
    n_queries, n_candidates = queries.count(), candidates.count()
    q_blocks, c_blocks = -(-n_queries // QUERY_BLOCK) or 1, -(-n_candidates // CANDIDATE_BLOCK) or 1

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = [np.frombuffer(r[c], np.int64) for c in ("q_ids", "c_ids")]
                found = best(ids[0], _matrix(r["q_matrix"], len(ids[0])), ids[1], _matrix(r["c_matrix"], len(ids[1])), k)
                rows = [
                    (q, r["c_block"], [{"worse": ~s, "vec_id": i} for i, s in zip(at.tolist(), scores.tolist())])
                    for q, at, scores in found
                ]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("query_id", "block", "top"), x)) for x in rows], schema=lists
                )

    hit = pa.struct([("worse", pa.int64()), ("vec_id", pa.int64())])
    lists = pa.schema([("query_id", pa.int64()), ("block", pa.int32()), ("top", pa.list_(hit))])
    # every tile has a key of its own, so tiles spread evenly and none is joined twice
    left = blocks(queries, q_blocks).select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
        F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c_block"),
    )
    right = blocks(candidates, c_blocks).select(
        "dim", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("matrix").alias("c_matrix"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"),
    )
    tiles = left.join(right.hint("merge"), ["dim", "q_block", "c_block"])
    tops = tiles.select("c_block", "q_ids", "q_matrix", "c_ids", "c_matrix").mapInArrow(
        tile, "query_id long, block int, top array<struct<worse: long, vec_id: long>>"
    )
    left_over = c_blocks
    while left_over > 1:
        tops = (
            tops.groupBy("query_id", F.floor(F.col("block") / FAN_IN).cast("int").alias("block"))
            .agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        )
        left_over = -(-left_over // FAN_IN)
    hits = tops.select("query_id", F.posexplode("top").alias("at", "hit"))
    return hits.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.bitwise_not(F.col("hit.worse")).alias("score"),
    )


def nearest(df: DataFrame, key: str, vector: str, every: int, k: int) -> DataFrame:
    """Search with the rows whose id is divisible by ``every`` against all rows."""
    rows = written(quantised(df, key, vector), "vectors")
    return search(rows.where(F.col("vec_id") % every == 0), rows, k)
