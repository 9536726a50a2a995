"""Media columns: content-addressed payloads in tar shards.

A payload is padded with zero bytes to a positive multiple of 64 and stored as a
PNG of 8-bit grey samples, 64 a row. Media are appended to tar shards in the
shared folder, named by the digest of their stored form; within a shard equal
media are stored once. Rows carry digest, shard, offset and length. Read tasks are cut by
the bytes of the objects, not by the rows. Metadata
columns are filled by range reads of the header bytes alone; features are
computed from the payload that a range read of the whole object gives back, so
nothing in them comes from the text.

A shard is written under a name of its own by one task and closed before its
rows are given out; a task that is run again writes another shard, and only
rows of the run that counts point anywhere. ``store`` materialises the rows, so
the shards are written once.

Null text is the empty text (one row of zero bytes). Texts of any length are
one object each. Repeated rows give repeated rows with equal values; an empty
table gives an empty table and no shard; other columns are ignored.
"""

from __future__ import annotations

import io
import posixpath
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize, new_path, qualified

ROW, SIGNATURE, SHARD_BYTES = 64, b"\x89PNG\r\n\x1a\n", 256 << 20
#: Stretches of a shard that a read task takes whole, and bytes of objects for a read task.
CHUNK_BYTES, READ_BYTES = 16 << 20, 64 << 20
#: Signature, chunk length and name, and the thirteen bytes of the image header.
HEADER = len(SIGNATURE) + 8 + 13


def payload_of(text: str | None) -> tuple[bytes, int]:
    """Padded payload of a text, and its length before padding."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(payload: bytes) -> bytes:
    """A grey 8-bit PNG, 64 samples a row, rows unfiltered."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int]:
    """(width, rows) from the first bytes of an object."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a media object")
    return struct.unpack(">II", start[16:24])


def decode(media: bytes) -> bytes:
    """The payload; every chunk's checksum is held against its bytes."""
    width, rows = header(media)
    at, packed = 8, b""
    while at < len(media):
        (n,), name = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + body):
            raise ValueError("broken media object")
        packed += body if name == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(rows, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and spread of the samples, and which of 64 even stretches lie above the mean."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    edges = np.linspace(0, len(x), 65).astype(np.int64)[:-1]
    means = np.add.reduceat(x, edges) / np.diff(np.append(edges, len(x)))
    bits = int("".join("1" if b else "0" for b in means > x.mean()), 2)
    return f"{x.mean():.4f}:{x.std():.4f}:{bits:016x}"


class Shard:
    """A tar file that is being written."""

    def __init__(self, where: fs.FileSystem, folder: str, label: str):
        self.name = f"{label}-{uuid.uuid4().hex}.tar"
        self.out = where.open_output_stream(posixpath.join(folder, self.name))
        self.at, self.held = 0, {}

    def add(self, digest: str, media: bytes) -> int:
        """Offset of the object's bytes, which are stored once."""
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + media + bytes(-len(media) % tarfile.BLOCKSIZE))
            self.held[digest] = self.at + len(head)
            self.at += len(head) + len(media) + -len(media) % tarfile.BLOCKSIZE
        return self.held[digest]

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes the shards. Returns rows (id, n_bytes, media_sha256, shard, offset, length) and the folder."""
    spark = docs.sparkSession
    uri = qualified(spark, new_path(spark, "media"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = open_folder(uri)
        shard: Shard | None = None
        waiting: list[pa.RecordBatch] = []  # rows of the open shard: keys and places only
        for batch in batches:
            n, digests, names, offsets, lengths = [], [], [], [], []
            for text in batch.column(1):
                payload, size = payload_of(text.as_py())
                media = encode(payload)
                digest = sha256(media).hexdigest()
                shard = shard or Shard(where, folder, "shard")
                n.append(size)
                digests.append(digest)
                names.append(shard.name)
                offsets.append(shard.add(digest, media))
                lengths.append(len(media))
            waiting.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["id", "n_bytes", "media_sha256", "shard", "offset", "length"]))
            if shard and shard.at >= SHARD_BYTES:
                shard.close()
                shard = None
                yield from waiting
                waiting = []
        if shard:
            shard.close()
        yield from waiting

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = slim.mapInArrow(run, f"id {kind}, n_bytes long, media_sha256 string, shard string, offset long, length long")
    return materialize(rows, "media-rows").withColumnRenamed("id", id_col), uri


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a qualified URI, the one that Spark writes its own tables to."""
    where, folder = fs.FileSystem.from_uri(uri)
    where.create_dir(folder, recursive=True)
    return where, folder


def read_columns(rows: DataFrame, uri: str, id_col: str = "doc_id") -> DataFrame:
    """Metadata columns by header-only range reads; digests and features by range reads of the objects."""
    kind = rows.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = open_folder(uri)
        name, file, at, values = None, None, None, ()
        for batch in batches:  # in the order of shard and offset, so equal objects follow each other
            cols: list[list] = [[] for _ in range(5)]
            for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if shard != name:
                    if file:
                        file.close()
                    name, file, at = shard, where.open_input_file(posixpath.join(folder, shard)), None
                if offset != at:
                    width, lines = header(file.read_at(HEADER, offset))
                    media = file.read_at(length, offset)
                    payload = decode(media)
                    at, values = offset, (width * lines, sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), sha256(media).hexdigest(), feature(payload))
                for col, value in zip(cols, values):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), batch.column(4), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    slim = rows.select(F.col(id_col).alias("id"), "n_bytes", "shard", "offset", "length")
    total = slim.agg(F.sum("length")).first()[0] or 0
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    dealt = slim.repartition(tasks, "shard", F.floor(F.col("offset") / CHUNK_BYTES)).sortWithinPartitions("shard", "offset")
    out = dealt.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
