"""Content-addressed payloads in tar shards, with header-only range reads for metadata.

Each task writes its payloads to tar shards of its own in a folder that all executors share; a payload is one member,
named by its digest and stored as a lossless 8-bit grey PNG of fixed width. Rows carry digest, shard, offset and length;
equal payloads are stored once by a task, and rows of one digest all carry the same place, the least. What a lost task
has written is referred to by no row. Reads go to byte ranges, 33 bytes for the metadata.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_PART, filesystem, scratch, small_batches, stored

WIDTH, SHARD_BYTES, RANGE_BYTES, HEADER_BYTES = 576, 128 << 20, 4 << 20, 33
MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes | None, width: int = WIDTH) -> bytes:
    """The text's bytes, filled with bytes 255 to a positive multiple of the width."""
    text = text or b""
    return text + b"\xff" * (-len(text) % width if text else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first 33 bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the header of a stored payload")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    width, height, _ = decode_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def write_shards(rows: DataFrame, folder: str, width: int = WIDTH) -> DataFrame:
    """Store the column text of rows; doc_id, n_bytes, digest, shard, offset, length. Each action on the result writes anew: store it.

    A null text is stored as an empty one; null ids and repeated rows keep their rows; other columns play no part; no rows, no shard.
    """
    small_batches(rows.sparkSession, 500)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        out, shard, size, places = None, "", 0, {}
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                payload = payload_of(text, width)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in places:
                    if out is None or size > SHARD_BYTES:
                        if out is not None:
                            out.write(bytes(1024))
                            out.close()
                        shard = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tar"
                        out, size, places = system.open_output_stream(f"{base}/{shard}"), 0, {}
                    data = encode_png(payload, width)
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(data)
                    head = member.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + data + bytes(-len(data) % 512))
                    places[digest] = (shard, size + len(head), len(data))
                    size += len(head) + len(data) + (-len(data) % 512)
                found.append((len(text or b""), digest, *places[digest]))
            n, digest, names, offset, length = zip(*found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array(names), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, digest string, shard string, offset long, length long")


def objects(index: DataFrame) -> DataFrame:
    """The distinct payloads of an index: digest, its one place, and the number n of its rows."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"), F.count("*").alias("n")).select("digest", "p.*", "n")


def in_ranges(rows: DataFrame) -> DataFrame:
    """Rows dealt out by ranges of shards, in order of place."""
    return rows.repartition("shard", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("shard", "offset")


def _ranged(rows: DataFrame, folder: str, fields: str, f: Callable, names: list[str], whole: bool) -> DataFrame:
    """f of the bytes of each row's range, or of its first 33, as further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        file, of = None, None
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != of:
                    if file is not None:
                        file.close()
                    file, of = system.open_input_file(f"{base}/{shard}"), shard
                found.append(f(file.read_at(length if whole else min(length, HEADER_BYTES), offset)))
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, zip(*found))], [*batch.schema.names, *names])
        if file is not None:
            file.close()

    have = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    return rows.mapInArrow(run, f"{have}, {fields}")


def fill_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """width, height and depth of each row's media, from its first 33 bytes only.

    rows: shard, offset, length (none null) and other columns, which pass, but not width, height or depth. Repeated rows
    are each read; bytes that are no header of a stored payload are an error, not a row without metadata.
    """
    return _ranged(rows, folder, "width long, height long, depth long", decode_header, ["width", "height", "depth"], whole=False)


def features(rows: DataFrame, folder: str) -> DataFrame:
    """Of the stored bytes read back: the payload's size, digest and tail checksum, the media's digest, and a histogram feature.

    Takes rows as fill_metadata does; media that do not unpack to their header's size are an error.
    """

    def of(data: bytes) -> tuple:
        payload = decode_png(data)
        bins = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
        share = " ".join(str(int(x) * 10_000 // len(payload)) for x in bins)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(data).hexdigest(), share

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "histogram"]
    return _ranged(rows, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, histogram string", of, names, whole=True)


def media(docs: DataFrame, folder: str | None = None, width: int = WIDTH) -> DataFrame:
    """Store each text of docs and read it back: doc_id, n_bytes, digest, shard, offset, length, metadata and features.

    A null text is an empty one, whose payload is one row of bytes 255; so are any two equal texts one payload. Null ids
    and repeated rows keep their rows. Texts of any length make one member; only one is held in memory. An empty table
    gives none. The shards stay in folder (by default one in the shared folder that goes with the session).
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "media")
    index = stored(write_shards(docs.select("doc_id", "text"), folder, width), "media-index")
    own, hot = index.select("doc_id", "n_bytes", "digest"), F.col("n") > max(1, index.count() * HOT_PART)
    read_back = lambda some: features(fill_metadata(in_ranges(some.drop("n")), folder), folder)
    # payloads of more than HOT_PART of all rows are at most 1 / HOT_PART: these meet their rows by broadcast
    many = objects(index).where(hot)
    rest = own.join(F.broadcast(many.select("digest")), "digest", "left_anti").join(read_back(objects(index).where(~hot)), "digest")
    return rest.unionByName(own.join(F.broadcast(read_back(many)), "digest"))
