"""Media columns: a Spark data source over archives of images, read by byte ranges.

The writer stores each payload as an 8-bit grey PNG in ZIP archives in a shared folder. The reader plans partitions as
byte ranges of the archives; a task reads an archive's directory at its end, takes the members whose offset lies in its
range, streams them through Arrow in batches, and tries each member again on its own, by its offset, if it can't be read.
"""

from __future__ import annotations

import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from prismlake.llm.common import documents, new_path

#: Pixels in a row of an image; payloads are filled up to whole rows.
WIDTH = 64
#: Bytes of an archive after which a task begins another, and of a byte range that one task reads.
ARCHIVE, RANGE = 64 << 20, 16 << 20
#: Bytes of payloads in an Arrow batch, and tries for each member.
BATCH, TRIES = 8 << 20, 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"

#: The list of a folder's archives and their sizes; written when all are.
LIST = "_archives.json"
READ = "doc_id bigint, n_bytes bigint, media binary, payload binary, feature string, archive string, offset bigint"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, WIDTH wide, whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; ValueError if it is damaged or of another kind."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if not shape or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit gradient hash of the image's 8 x 9 block means."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256).astype(float)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    deviation = (float(counts @ np.square(np.arange(256) - mean)) / len(samples)) ** 0.5
    at = (np.arange(72) * len(samples)) // 72
    sums = np.concatenate([[0], np.cumsum(samples, dtype=np.int64)])
    edges = np.append(at, len(samples))
    block = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(1, np.diff(edges))
    rows = block.reshape(8, 9)
    bits = np.packbits(rows[:, 1:] > rows[:, :-1]).tobytes().hex()
    return f"{mean:.4f},{deviation:.4f},{max(0.0, -float(share @ np.log2(share))):.4f},{bits}"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class ArchiveWriter(DataSourceArrowWriter):
    """Each try of a task writes archives under names of its own; only those of tries that Spark commits are listed."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path.rstrip("/"), size

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        held = io.BytesIO()
        archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)

        def put() -> None:
            archive.close()
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(held.getbuffer())
            done.append((name, held.getbuffer().nbytes))

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_bytes", "payload")]
            for i in range(batch.num_rows):
                doc_id, n_bytes, payload = (c[i].as_py() for c in columns)
                member = zipfile.ZipInfo(f"{len(archive.filelist):08d}.png")
                member.comment = json.dumps([doc_id, n_bytes]).encode()
                archive.writestr(member, to_png(payload))
                if held.tell() > self.size:
                    put()
                    held = io.BytesIO()
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
        if archive.filelist:
            put()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps([x for m in messages if m for x in m.archives]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                system.delete_file(f"{folder}/{name}")


@dataclass
class ByteRange(InputPartition):
    name: str
    begin: int
    end: int


def member(open_file: Callable[[], pa.NativeFile], offset: int, size: int, crc: int, tries: int = TRIES, wait: float = 0.2) -> bytes:
    """The bytes of the member whose header is at offset; each try opens the archive anew, and the last one's error stands."""
    for left in reversed(range(tries)):
        try:
            with open_file() as f:
                f.seek(offset)
                header = f.read(30)
                if header[:4] != b"PK\x03\x04":
                    raise ValueError("no member there")
                f.seek(offset + 30 + sum(struct.unpack_from("<HH", header, 26)))
                found = f.read(size)
            if len(found) != size or zlib.crc32(found) != crc:
                raise ValueError(f"damaged member at {offset}")
            return found
        except Exception:
            if not left:
                raise
            time.sleep(wait * (tries - left))
    raise ValueError("no try was allowed")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path.rstrip("/"), size

    def partitions(self) -> list[ByteRange]:
        """From the list of archives alone: no directory is read, and nothing of a document reaches the driver."""
        system, folder = _open(self.path)
        with system.open_input_stream(f"{folder}/{LIST}") as f:
            listed = json.loads(f.read())
        return [ByteRange(name, begin, min(n, begin + self.size)) for name, n in listed for begin in range(0, n, self.size)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, folder = _open(self.path)
        open_file = lambda: system.open_input_file(f"{folder}/{partition.name}")
        with open_file() as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.begin <= m.header_offset < partition.end]
        rows: list[tuple] = []
        held = 0
        for m in members:
            media = member(open_file, m.header_offset, m.compress_size, m.CRC)
            payload = from_png(media)
            rows.append((*json.loads(m.comment), media, payload, feature(payload), partition.name, m.header_offset))
            held += len(media) + len(payload)
            if held > BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "payload": pa.binary(), "feature": pa.string(), "archive": pa.string(), "offset": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=[*kinds])


class MediaArchives(DataSource):
    """Format `media_archives`: writes (doc_id, n_bytes, payload), reads these with media, feature, archive and offset.

    Options: `path`, of any file system that Arrow opens; `archiveBytes` and `rangeBytes`, the sizes of an archive and of
    what one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return READ

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE)))

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)))


def store(docs: DataFrame, path: str, **options: int) -> DataFrame:
    """Writes each of docs' texts (null: empty) to archives at path, and returns the table that reads them back.

    Repeated rows and null doc_ids are members like any other. Payloads pass one at a time, whatever their size.
    """
    spark: SparkSession = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    full = (F.greatest(F.lit(1), F.ceil(F.length(raw) / WIDTH)) * WIDTH).cast("int")
    payload = F.rpad(raw, full, F.lit(b"\0"))
    docs.select("doc_id", F.length(raw).cast("long").alias("n_bytes"), payload.alias("payload")).write.format("media_archives").mode("append").options(**options).save(path)
    return spark.read.format("media_archives").options(**options).load(path)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    table = store(documents(spark, sf_dir).select("doc_id", "text"), new_path(spark, "media"))
    return table.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
