"""SimHash near-duplicates: generalised pigeonhole search over 64-bit fingerprints.

The bits are cut into parts so that correlated bits share a part.  Two fingerprints at most d
bits apart agree, for any thresholds t_i >= -1 with sum(t_i + 1) = d + 1, in some part i
within t_i bits.  Every fingerprint chooses its own thresholds by dynamic programming on the
number of candidates they are expected to bring: exact counts for values that many
fingerprints share, a sample for the rest.  It then probes the values within t_i bits of its
own, and the joined candidates are verified on all 64 bits.

A fingerprint all of whose choices are crowded, as in a large group of near copies, is not
joined with the crowd.  It sends itself to the values around it instead: any two fingerprints
d bits apart meet at a value between them, where a star replaces the pairs.  So the work stays
in proportion to the fingerprints, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fresh, written
from .components import components

BITS = 64
FEW = 10_000  # rows of two numbers that may go to every task
SAMPLE = 1024  # fingerprints that the estimates are made from
CROWD = 24  # fingerprints sharing a part's value from which their number is counted exactly
PROBE_COST = 4.0  # a probe in units of a candidate


# --- fingerprints ------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = 3, block: int = 1 << 16) -> int:
    """Bit i is 1 if more than half of the shingle hashes have it set; no words: 0.

    A-Z are lowered, words are runs without ASCII white space, shingles overlap and count
    as often as they occur; fewer words than a shingle make one shingle.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = max(1, len(tokens) - words + 1)
    hashed = xxhash.xxh64_intdigest
    last = min(words, len(tokens)) - 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, block):
        cuts = zip(starts[at : min(n, at + block)].tolist(), (ends[last:] - 1)[at : min(n, at + block)].tolist())
        hashes = np.array([hashed(joined[a:b], 42) for a, b in cuts], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, words: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``carry``, fingerprint) of every row; the fingerprint is the bigint with the same bits.

    carry: further columns of longs, passed on.
    """
    names = ["doc_id", *carry, "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, words) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints.view(np.int64))], names)

    columns = [F.col(key).cast("long"), *(F.col(c).cast("long") for c in carry), F.col(text)]
    return docs.select(*columns).mapInArrow(run, ", ".join(f"{c} long" for c in names))


# --- parts, thresholds and probes -------------------------------------------------------------


@cache
def masks(width: int, least: int, most: int) -> np.ndarray:
    """Values of ``width`` bits with ``least`` to ``most`` bits set."""
    return np.array(
        [sum(1 << b for b in c) for k in range(least, most + 1) for c in combinations(range(width), k)], np.uint64
    )


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into parts of near equal size; correlated bits go together."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    centred = bits - bits.mean(0) if len(bits) else np.zeros((1, BITS))
    spread = np.sqrt((centred**2).sum(0)) + 1e-9
    related = np.abs(centred.T @ centred) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, out = set(range(BITS)), []
    for p in range(parts):
        rest = sorted(free)
        size = -(-len(rest) // (parts - p))
        group = [rest[int(related[np.ix_(rest, rest)].sum(1).argmax())]]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(rest[int(related[np.ix_(rest, group)].sum(1).argmax())])
        free -= set(group)
        out.append(sorted(group))
    return out


def part_values(prints: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """The bits of each part, moved together: an array (fingerprints, parts)."""
    out = np.zeros((len(prints), len(parts)), np.uint64)
    for p, group in enumerate(parts):
        for to, b in enumerate(group):
            out[:, p] |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(to)
    return out


def costs(values, sample_values, counts, parts, total: int, distance: int) -> np.ndarray:
    """Cost (fingerprints, parts, t) of threshold t - 1: candidates to expect, and probes.

    counts: fingerprints sharing the part's value where that is known, else NaN.
    """
    out = np.zeros((len(values), len(parts), distance + 2))
    for p, group in enumerate(parts):
        apart = np.bitwise_count(values[:, p, None] ^ sample_values[None, :, p])
        for t in range(distance + 1):
            probes = len(masks(len(group), 0, t))
            near = total * ((apart <= t).sum(1) / max(1, len(sample_values)) + probes / 2.0 ** len(group))
            near = np.maximum(near, np.nan_to_num(counts[:, p])) if counts is not None else near
            if t == 0 and counts is not None:
                near = np.where(np.isnan(counts[:, p]), np.minimum(near, CROWD), counts[:, p])
            out[:, p, t + 1] = near + PROBE_COST * probes
    return out


def allocate(cost: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (fingerprints, parts) with sum(t + 1) = distance + 1 of least cost, and that cost.

    best[s] is the least cost of giving s = sum(t + 1) to the parts so far.
    """
    n, parts, levels = cost.shape
    best = np.full((n, levels), np.inf)
    best[:, 0] = 0
    choice = np.zeros((parts, n, levels), np.int64)
    for p in range(parts):
        options = np.full((n, levels, levels), np.inf)  # given so far in all, given to this part
        for s in range(levels):
            for t in range(s + 1):
                options[:, s, t] = best[:, s - t] + cost[:, p, t]
        choice[p] = options.argmin(2)
        best = options.min(2)
    out, left, rows = np.zeros((n, parts), np.int64), np.full(n, distance + 1), np.arange(n)
    for p in reversed(range(parts)):
        out[:, p] = choice[p][rows, left] - 1
        left -= out[:, p] + 1
    return out, best[:, distance + 1]


def choose_parts(sample: np.ndarray, total: int, distance: int) -> list[list[int]]:
    """Cut the bits into the number of parts that costs evenly spread fingerprints least."""

    def expected(m: int) -> float:
        widths = [(BITS + p) // m for p in range(m)]
        probes = np.array([[len(masks(w, 0, t)) for t in range(distance + 1)] for w in widths], float)
        near = total * probes / np.exp2(widths)[:, None]
        cost = np.concatenate([np.zeros((m, 1)), near + PROBE_COST * probes], 1)
        return float(allocate(cost[None], distance)[1][0])

    return group_bits(sample, min(range(1, distance + 3), key=expected))


# --- links -------------------------------------------------------------------------------------


def _index(prints: DataFrame, parts: list[list[int]]) -> DataFrame:
    """(part, value, fingerprint, node): every fingerprint once in every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = part_values(b.column(0).to_numpy().view(np.uint64), parts)
            for p in range(len(parts)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, p, np.int32)), pa.array(values[:, p].view(np.int64)), b.column(0), b.column(1)],
                    ["part", "value", "fingerprint", "node"],
                )

    return prints.mapInArrow(run, "part int, value long, fingerprint long, node long")


def _probes(counted: DataFrame, parts: list[list[int]], sample: np.ndarray, total: int, distance: int) -> DataFrame:
    """(part, value, fingerprint, node, inner): the values to look up; part -1 holds meeting points.

    inner: the meeting point is within distance // 2 bits.
    """
    sample_values = part_values(sample, parts)
    outer, inner = (distance + 1) // 2, len(masks(BITS, 0, distance // 2))

    def rows(part, values, prints, nodes, is_inner):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(values), part, np.int32)), pa.array(values.view(np.int64)),
             pa.array(prints.view(np.int64)), pa.array(nodes), pa.array(is_inner)],
            ["part", "value", "fingerprint", "node", "inner"],
        )

    def spread(part, values, prints, nodes, flips):
        n = len(flips)
        return rows(part, (values[:, None] ^ flips).ravel(), np.repeat(prints, n), np.repeat(nodes, n),
                    np.tile(np.arange(n) < inner, len(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = masks(BITS, 0, outer)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                prints, nodes = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
                counts = np.stack([b.column(2 + p).to_numpy(zero_copy_only=False).astype(float) for p in range(len(parts))], 1)
                values = part_values(prints, parts)
                thresholds, cost = allocate(costs(values, sample_values, counts, parts, total, distance), distance)
                crowded = cost > PROBE_COST * len(meeting)
                yield spread(-1, prints[crowded], prints[crowded], nodes[crowded], meeting)
                for p, group in enumerate(parts):
                    for t in range(distance + 1):
                        own = ~crowded & (thresholds[:, p] == t)
                        yield spread(p, values[own, p], prints[own], nodes[own], masks(len(group), 0, t))

    return counted.mapInArrow(run, "part int, value long, fingerprint long, node long, inner boolean")


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(u, v) between nodes of fingerprints at most ``distance`` bits apart.

    prints: a written table (fingerprint, node) of distinct fingerprints.  Every pair within
    the distance is linked or, in a crowd, joined by a path of such links.
    """
    total = prints.count()
    chosen = prints.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).select("fingerprint").collect()
    sample = np.array([r[0] for r in chosen], np.int64).view(np.uint64)
    parts = choose_parts(sample, total, distance)

    index = written(_index(prints, parts), "simhash-index")
    crowds = index.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD)
    known = (
        index.join(crowds, ["part", "value"], "left")
        .groupBy("fingerprint", "node")
        .agg(*[F.max(F.when(F.col("part") == p, F.col("n"))).alias(f"n{p}") for p in range(len(parts))])
    )
    probes = written(_probes(known, parts, sample, total, distance), "simhash-probes")
    near = F.bit_count(F.col("q.fingerprint").bitwiseXOR(F.col("x.fingerprint"))) <= distance
    pairs = (
        probes.where(F.col("part") >= 0).alias("q")
        .join(index.alias("x"), (F.col("q.part") == F.col("x.part")) & (F.col("q.value") == F.col("x.value")) & near & (F.col("q.node") != F.col("x.node")))
        .select(F.col("q.node").alias("u"), F.col("x.node").alias("v"))
    )
    meeting = probes.where(F.col("part") == -1)
    hubs = meeting.where("inner").groupBy("value").agg(F.min("node").alias("hub"))
    stars = meeting.join(hubs, "value").where(F.col("node") != F.col("hub")).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    return pairs.unionByName(stars)


def groups(docs: DataFrame, key: str, text: str, words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint bigint, component_id) of every row of ``docs``.

    component_id: the smallest doc_id reached over links of at most ``distance`` differing
    bits, the row's own included.  Null and empty texts have fingerprint 0 and are linked like
    any other.  Rows without an id link nothing and get no component.  Repeated rows are kept.
    Other columns are not read.
    """
    rows = written(fingerprints(docs, key, text, words), "simhash-rows")
    prints = written(
        rows.where(F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("node")),
        "simhash-prints",
    )
    found = components(links(prints, distance))
    named = prints.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    out = rows.join(named, "fingerprint", "left")
    return out.select(
        "doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One row of every group of near copies, with the columns of ``docs``.

    A row belongs to the group of its own fingerprint, whatever other texts its id has.  The row with the
    smallest id stays, of that id's texts the one with the smallest hash; of rows that are equal
    in id and text exactly one stays, any one if other columns differ.  Rows without an id stay
    as they are and make no other row go.
    """
    ids = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.xxhash64(F.col(key).cast("long"), text).alias("row"), F.col(text).alias("text")
    )
    rows = written(fingerprints(ids, "id", "text", words, carry=("row",)).withColumnRenamed("doc_id", "id"), "simhash-rows")
    # fingerprints are their own nodes here, so two texts of an id are apart
    prints = written(rows.select("fingerprint", F.col("fingerprint").alias("node")).distinct(), "simhash-prints")
    found = components(links(prints, distance))
    named = prints.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component"))
    each = rows.groupBy("id", "row", "fingerprint").agg(F.count("*").alias("n")).join(named, "fingerprint")
    first = each.groupBy("component").agg(F.min(F.struct("id", "row")).alias("kept"))
    place = (F.col("id") == F.col("kept.id")) & (F.col("row") == F.col("kept.row"))
    judged = written(
        each.join(first, "component").select("id", "row", place.alias("kept"), "n").where(~F.col("kept") | (F.col("n") > 1)),
        "simhash-judged",
    )
    name, own_id, own_row = fresh(docs, "_row", "_id", "_own_row")
    named_rows = docs.withColumn(name, F.xxhash64(F.col(key).cast("long"), text))

    def matching(side: DataFrame, how: str) -> DataFrame:
        side = side.select(F.col("id").alias(own_id), F.col("row").alias(own_row))
        if side.limit(FEW + 1).count() <= FEW:
            side = F.broadcast(side)
        return named_rows.join(side, (F.col(key).cast("long") == F.col(own_id)) & (F.col(name) == F.col(own_row)), how)

    rest = matching(judged, "left_anti")
    # rows that stay once although they came several times
    again = matching(judged.where("kept"), "left_semi").dropDuplicates([key, name])
    return rest.unionByName(again).drop(name)
