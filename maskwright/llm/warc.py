"""WARC archives and a Merkle audit of their replicas.

Pages are written as WARC records, one gzip member each, into volumes.  A replica's tree has the
SHA-256 of every record's stored bytes as leaves; over them stand offset ranges of a volume in
their order, then ever larger ranges, the volume, buckets of volumes, and the replica.  An
audit reads both replicas once to build the trees, compares the roots, and goes down only from
nodes that differ, level by level, to the records at fault.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

VOLUME_BYTES = 64 << 20  # a volume is closed when it has grown beyond this
RANGE_BYTES = 256 << 10  # stored bytes under a lowest node
FAN_OUT = 16  # nodes under a node
INDEX = "volume string, offset long, length long, page_id long"
DATE = "2000-01-01T00:00:00Z"  # fixed, so that the same pages give the same bytes


# --- archives -----------------------------------------------------------------------------------


def record(page: int | None, url: str | None, html: str | None) -> bytes:
    """A resource record as a gzip member.  Nulls are written as empty."""
    body = (html or "").encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    digest = hashlib.sha256(body).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {target} {digest}")
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + body + b"\r\n\r\n", compresslevel=4, mtime=0)


def _place(path: str):
    return fs.FileSystem.from_uri(path)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_INDEX_KINDS, _INDEX_NAMES = [pa.string(), pa.int64(), pa.int64(), pa.int64()], ["volume", "offset", "length", "page_id"]


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write volumes below ``path``; returns the index (volume, offset, length, page_id).

    Each task writes volumes of its own under names of its own, and the index, which Spark
    commits, names those of successful tasks only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        out, name, at = None, "", 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                rows, raw = [], []
                for page, u, h in zip(*(c.to_pylist() for c in whole.slice(start, 256).columns)):
                    if out is None:
                        system.create_dir(folder, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    data = record(page, u, h)
                    out.write(data)
                    rows.append((name, at, len(data), page))
                    at += len(data)
                    if at >= VOLUME_BYTES:
                        out.close()
                        out = None
                yield _batch(rows, _INDEX_KINDS, _INDEX_NAMES)
        if out is not None:
            out.close()

    narrow = pages.select(F.col(key).cast("long"), F.col(url), F.col(html))
    return written(narrow.mapInArrow(run, INDEX), "warc-index")


def replicate(
    index: DataFrame, path: str, to: str, fault: Callable[[int | None, bytes], bytes] | None = None
) -> None:
    """Copy the volumes in ``index`` to the folder ``to``, record by record.

    fault: what the copy makes of a record's bytes, for rehearsals; a shorter result shortens
    the volume.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, folder = _place(path)
        target, other = _place(to)
        target.create_dir(other, recursive=True)
        name, read, out = None, None, None
        for b in batches:
            for volume, offset, length, page in zip(*(c.to_pylist() for c in b.columns)):
                if volume != name:
                    for f in (read, out):
                        if f is not None:
                            f.close()
                    name, read = volume, source.open_input_file(f"{folder}/{volume}")
                    out = target.open_output_stream(f"{other}/{volume}", compression=None)
                data = read.read_at(length, offset)
                out.write(fault(page, data) if fault else data)
            yield _batch([], [pa.int64()], ["done"])
        for f in (read, out):
            if f is not None:
                f.close()

    # a volume is one file and is copied by one task
    sorted_volumes = index.select("volume", "offset", "length", "page_id").repartition("volume").sortWithinPartitions("volume", "offset")
    sorted_volumes.mapInArrow(run, "done long").write.format("noop").mode("overwrite").save()


# --- trees ----------------------------------------------------------------------------------------


def leaves(index: DataFrame, path: str) -> DataFrame:
    """(volume, offset, length, page_id, digest): SHA-256 of what the replica holds of each record.

    digest is null for a record whose volume is missing or ends before it, and covers what
    is there of one that is cut short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        name, source = None, None
        for b in batches:
            rows = []
            for volume, offset, length, page in zip(*(c.to_pylist() for c in b.columns)):
                if volume != name:
                    name = volume
                    there = system.get_file_info(f"{folder}/{volume}")
                    source = system.open_input_file(f"{folder}/{volume}") if there.type == fs.FileType.File else None
                    size = there.size or 0
                data = source.read_at(length, offset) if source is not None and offset < size else None
                rows.append((volume, offset, length, page, None if data is None else hashlib.sha256(data).hexdigest()))
            yield _batch(rows, [*_INDEX_KINDS, pa.string()], [*_INDEX_NAMES, "digest"])

    spread = index.select(*_INDEX_NAMES).repartitionByRange("volume", "offset").sortWithinPartitions("volume", "offset")
    return written(spread.mapInArrow(run, INDEX + ", digest string"), "warc-leaves")


def _over(children: DataFrame, parent: list[Column], order: list[str]) -> DataFrame:
    """Nodes over ``children``: the hash of their hashes in order.  A node has a bounded number."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.coalesce("digest", F.lit("-")).alias("digest"))))
    text = F.array_join(F.transform(listed, lambda c: F.concat_ws(":", *[c[k].cast("string") for k in order], c["digest"])), "\n")
    return children.groupBy(*parent).agg(F.sha2(text, 256).alias("digest"))


@dataclass
class Level:
    """Nodes (volume or null, node, digest) of a tree, and the key of each one's parent."""

    nodes: DataFrame
    parent_volume: Column
    parent_node: Column

    def above(self, order: list[str]) -> DataFrame:
        return written(_over(self.nodes, [self.parent_volume.alias("volume"), self.parent_node.alias("node")], order), "merkle")


def tree(found: DataFrame) -> list[Level]:
    """Levels of a replica's tree, from the leaves to the root.

    Ranges of a volume stand over its leaves, FAN_OUT of them under a node of the next level, up to
    the volume; then volumes in hash buckets, FAN_OUT of those under a node, up to one root.
    """
    last, n_volumes = found.agg(F.max("offset"), F.count_distinct("volume")).first()
    volume, none = F.col("volume"), F.lit(None).cast("string")
    larger = F.floor(F.col("node") / FAN_OUT)
    levels = [Level(found, volume, F.floor(F.col("offset") / RANGE_BYTES))]
    width, order = (last or 0) // RANGE_BYTES + 1, ["offset", "length"]
    while width > 1:
        levels.append(Level(levels[-1].above(order), volume, larger))
        width, order = -(-width // FAN_OUT), ["node"]
    buckets = -(-max(1, n_volumes) // FAN_OUT)
    tops = levels[-1].above(order)
    levels.append(Level(tops, none, F.pmod(F.xxhash64("volume"), F.lit(buckets))))
    order = ["volume"]
    while buckets > 1:
        levels.append(Level(levels[-1].above(order), none, larger))
        buckets, order = -(-buckets // FAN_OUT), ["node"]
    return [*levels, Level(levels[-1].above(order), none, larger)]


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    left = a.select(*keys, "digest", F.lit(True).alias("there")).alias("a")
    right = b.select(*keys, "digest", F.lit(True).alias("there")).alias("b")
    differ = (
        ~F.col("a.digest").eqNullSafe(F.col("b.digest")) | F.col("a.there").isNull() | F.col("b.there").isNull()
    )
    return left.join(right, same, "full").where(differ).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys])


def _below(level: Level, parents: DataFrame) -> DataFrame:
    """The rows of a level that stand under one of ``parents``."""
    keyed = level.nodes.withColumns({"_volume": level.parent_volume, "_node": level.parent_node})
    same = (F.col("_node") == F.col("p.node")) & F.col("_volume").eqNullSafe(F.col("p.volume"))
    return keyed.join(parents.alias("p"), same, "left_semi").drop("_node", "_volume")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records at which two replicas differ: (volume, offset, length, page_id, fault).

    a and b: leaves of the two replicas under one index.  fault: ``changed`` where both hold
    something, ``missing in a`` or ``missing in b``; a record that both lack is no difference.
    Equal roots give no rows without a look at anything below.
    """
    left, right = tree(a), tree(b)
    if len(left) != len(right):
        raise ValueError("the replicas' leaves don't come from one index")
    bad = written(_differing(left[-1].nodes, right[-1].nodes, ["volume", "node"]), "merkle-bad")
    for x, y in zip(left[-2:0:-1], right[-2:0:-1]):
        if bad.isEmpty():
            break
        bad = written(_differing(_below(x, bad), _below(y, bad), ["volume", "node"]), "merkle-bad")
    keys = ["volume", "offset", "length", "page_id"]
    x, y = (_below(side[0], bad).select(*keys, "digest").alias(n) for side, n in ((left, "x"), (right, "y")))
    both = F.lit(True)
    for k in keys:
        both = both & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    fault = (
        F.when(F.col("x.digest").isNull(), "missing in a")
        .when(F.col("y.digest").isNull(), "missing in b")
        .otherwise("changed")
    )
    return x.join(y, both, "full").where(~F.col("x.digest").eqNullSafe(F.col("y.digest"))).select(
        *[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], fault.alias("fault")
    )
