"""Length-delimited binary records of token ids, with masked checksums and an offset index.

A file is a row of frames:

    length of the payload   8 bytes, unsigned, little-endian
    masked checksum of it   4 bytes
    payload                 document id (8 bytes, signed), then the ids (2 bytes each)
    masked checksum of it   4 bytes

The checksum is CRC-32C; masking rotates it and adds a constant, so that data which holds
checksums itself is still checked well.  The index is a Parquet table beside the files: file,
first document, offset and length of every frame, so a shuffled reader seeks straight to any
record.  A task writes to a name of its own and the index names only files of tasks that
Spark has committed: what a lost or repeated task leaves is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .token_ids import ID_TYPE, word_encoder

# fixed values: the reflected CRC-32C polynomial and the constant of the mask
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

_CHUNK = 64  # bytes that one lane of the vectorised checksum takes
NO_ID = -(1 << 63)  # stands for a null id in a payload
FILE_BYTES = 1 << 30  # of text in a file, about
HEADER = struct.Struct("<QI")
INDEX_SCHEMA = "doc_id long, file string, offset long, n_bytes long, n_tokens long"


# --- checksums -------------------------------------------------------------------------------


@cache
def _byte_table() -> np.ndarray:
    """The checksum's register after each byte value."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return t


@cache
def _pair_table() -> np.ndarray:
    """The register after two bytes, the lower one first."""
    t, crc = _byte_table(), np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        crc = t[crc & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc


def _advance(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    b = np.uint32(255)
    return tables[0][crc & b] ^ tables[1][(crc >> np.uint32(8)) & b] ^ tables[2][(crc >> np.uint32(16)) & b] ^ tables[3][crc >> np.uint32(24)]


@cache
def _zeros_tables(power: int) -> np.ndarray:
    """Tables that move a register over 2**power zero bytes, one for each of its four bytes."""
    if power == 0:
        t, b = _byte_table(), np.arange(256, dtype=np.uint32)
        return np.stack([t[b], b, b << np.uint32(8), b << np.uint32(16)])
    half = _zeros_tables(power - 1)
    return np.stack([_advance(half, half[k]) for k in range(4)])


def _over_zeros(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes."""
    crc, lengths = crc.astype(np.uint32), np.asarray(lengths, np.int64)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        moved = (lengths >> power) & 1 == 1
        if moved.any():
            crc = np.where(moved, _advance(_zeros_tables(power), crc), crc)
    return crc


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of every payload.

    The register is linear in data and start value.  Payloads are cut from their ends into
    lanes of equal length, all lanes go through the table side by side, and each lane's
    register is moved over the bytes behind it and added to its payload's.
    """
    if not payloads:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in payloads], np.int64)
    lanes = -(-sizes // _CHUNK)
    filled = np.cumsum(lanes) * _CHUNK
    data = np.zeros(int(lanes.sum()) * _CHUNK, np.uint8)
    for p, n, end in zip(payloads, sizes, filled):
        data[end - n : end] = np.frombuffer(p, np.uint8)
    columns = np.ascontiguousarray(data.view("<u2").reshape(-1, _CHUNK // 2).T)
    table, crc = _pair_table(), np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        crc = table[(crc ^ column) & np.uint32(0xFFFF)] ^ (crc >> np.uint32(16))
    first = np.cumsum(lanes) - lanes
    behind = np.repeat(np.cumsum(lanes), lanes) - np.arange(len(crc)) - 1
    crc = _over_zeros(crc, behind * _CHUNK)
    out = np.zeros(len(payloads), np.uint32)
    some = lanes > 0
    if some.any():
        out[some] = np.bitwise_xor.reduceat(crc, first[some])
    start = _over_zeros(np.full(len(payloads), 0xFFFFFFFF, np.uint32), sizes)
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = np.asarray(crc, np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


# --- frames -----------------------------------------------------------------------------------


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    return [
        h + struct.pack("<I", a) + p + struct.pack("<I", b)
        for h, p, a, b in zip(heads, payloads, masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist())
    ]


def _checked(heads: list[bytes], payloads: list[bytes], sums: list[int], where: str) -> None:
    if masked(crc32c([h[:8] for h in heads])).tolist() != [HEADER.unpack(h)[1] for h in heads]:
        raise ValueError(f"{where}: the checksum of a length is wrong")
    if masked(crc32c(payloads)).tolist() != sums:
        raise ValueError(f"{where}: the checksum of a record is wrong")


def read_frames(source, where: str, batch_bytes: int = 1 << 22) -> Iterator[list[bytes]]:
    """Lists of checked payloads of an open file, in its order; memory holds one list."""
    heads, payloads, sums, held = [], [], [], 0
    while True:
        head = source.read(HEADER.size)
        if not head or held >= batch_bytes:
            _checked(heads, payloads, sums, where)
            if payloads:
                yield payloads
            heads, payloads, sums, held = [], [], [], 0
            if not head:
                return
        if len(head) < HEADER.size:
            raise ValueError(f"{where}: ends inside a length")
        size = HEADER.unpack(head)[0]
        if size > batch_bytes and masked(crc32c([head[:8]]))[0] != HEADER.unpack(head)[1]:
            raise ValueError(f"{where}: the checksum of a length is wrong")
        body = source.read(size + 4)
        if len(body) < size + 4:
            raise ValueError(f"{where}: ends inside a record")
        heads.append(head)
        payloads.append(body[:size])
        sums.append(struct.unpack("<I", body[size:])[0])
        held += size


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The payload of a record; NO_ID stands for a missing id."""
    if doc_id == NO_ID:
        raise ValueError(f"{NO_ID} is no document id")
    return struct.pack("<q", NO_ID if doc_id is None else doc_id) + ids.tobytes()


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of a record."""
    doc_id = struct.unpack_from("<q", payload)[0]
    return None if doc_id == NO_ID else doc_id, np.frombuffer(payload, ID_TYPE, offset=8)


def _place(path: str):
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside


# --- jobs --------------------------------------------------------------------------------------


def write(docs: DataFrame, key: str, text: str, path: str, tokenizer: str | None = None) -> DataFrame:
    """Encode ``docs`` and write record files below ``path`` in ascending order of ``key``.

    Returns the index, which is also at ``path``/index.  Range partitions keep the order
    across files; equal ids are told apart by their texts' hash, and equal rows by a number, so a
    repeated id or row can be cut as well.  Rows without an id come first.  A null text has the
    end id only.  Other columns are not read.  Files are as many as shuffle partitions, or more if
    they would exceed FILE_BYTES of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.rec"
        system, folder = _place(path)
        at = 0
        out = None
        for whole in batches:
            encoded = encoder.documents(whole.column(1))
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}")
                ids = b.column(0).to_pylist()
                tokens = list(islice(encoded, b.num_rows))
                framed = frames([payload(i, t) for i, t in zip(ids, tokens)])
                sizes = np.array([len(f) for f in framed], np.int64)
                offsets = at + np.cumsum(sizes) - sizes
                out.write(b"".join(framed))
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(offsets), pa.array(sizes),
                     pa.array([len(t) for t in tokens], pa.int64())],
                    ["doc_id", "file", "offset", "n_bytes", "n_tokens"],
                )
        if out is not None:
            out.close()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = rows.withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a fixed number of partitions, so that no later step cuts or joins the files' ranges anew
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // FILE_BYTES))
    keys = ["doc_id", "_tie", "_row"]
    placed = order.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie", "_row")
    placed.mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{path}/index")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the record files.

    start: the ids of all records before, in file order.  ids_crc32: CRC-32 of the ids as
    little-endian unsigned 32-bit integers.  A file is read as a stream, and a damaged or short
    one raises an error.  Files are few: their totals, not the records, are summed in one task.
    """
    index = read_index(spark, path)
    files = index.groupBy("file").agg(
        F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first")
    )
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_input_stream(f"{folder}/{file}", buffer_size=1 << 20) as source:
                    for payloads in read_frames(source, file):
                        found = [unpacked(p) for p in payloads]
                        sizes = np.array([len(t) for _, t in found], np.int64)
                        starts = base + np.cumsum(sizes) - sizes
                        base += int(sizes.sum())
                        sums = [zlib.crc32(t.astype("<u4").tobytes()) for _, t in found]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([i for i, _ in found], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = files.repartition(parts, "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(entries: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of the index rows in ``entries``, in whatever order these come.

    For shuffled reads: order the index at random, and each row is one seek and one read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        opened = {}
        for b in batches:
            ids, tokens = [], []
            for file, offset, size in zip(*(b.column(c).to_pylist() for c in range(3))):
                if file not in opened:
                    if len(opened) >= 64:
                        opened.popitem()[1].close()
                    opened[file] = system.open_input_file(f"{folder}/{file}")
                raw = opened[file].read_at(size, offset)
                _checked([raw[:12]], [raw[12:-4]], [struct.unpack("<I", raw[-4:])[0]], file)
                found = unpacked(raw[12:-4])
                ids.append(found[0])
                tokens.append(found[1].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return entries.select("file", "offset", "n_bytes").mapInArrow(run, "doc_id long, ids array<int>")
