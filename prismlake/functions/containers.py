"""What a video file says of itself: duration, frames, size and codec, from the boxes of its container.

Boxes are walked by their headers; of a file only these and the few boxes that are asked for are read, not the media between them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.ordering import size_bins
from prismlake.registry import query
from prismlake.shipping import ship

#: Columns that a probe gives; error is null if the file could be read.
INFO = "codec string, width int, height int, frames bigint, fps double, duration double, error string"
#: Bytes of a box's table that are read at most; a table of 8 million runs of samples is no video's.
TABLE = 64 << 20
#: Boxes of which one after another is looked at in a place, at most.
BOXES = 100_000

Read = Callable[[int, int], bytes]


class Damaged(ValueError):
    """The file isn't what it should be."""


def _take(read: Read, at: int, n: int) -> bytes:
    found = read(at, n)
    if len(found) != n:
        raise Damaged("the file ends within a box")
    return found


def boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the content of the boxes in a part of a file."""
    for _ in range(BOXES):
        if at + 8 > end:
            return
        size, kind = struct.unpack(">I4s", _take(read, at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", _take(read, at + 8, 8))[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Damaged(f"box {kind.decode('latin-1')} of {size} bytes at {at}")
        yield kind, at + head, at + size
        at += size
    raise Damaged("too many boxes")


def _find(read: Read, at: int, end: int, *path: bytes) -> tuple[int, int]:
    for want in path:
        at, end = next(((a, b) for kind, a, b in boxes(read, at, end) if kind == want), (0, 0))
        if not end:
            raise Damaged(f"no box {want.decode()}")
    return at, end


def _table(read: Read, at: int, end: int) -> bytes:
    if end - at > TABLE:
        raise Damaged(f"a table of {end - at} bytes")
    return _take(read, at, end - at)


def probe(read: Read, size: int) -> dict:
    """INFO of a file of so many bytes, of which read(place, n) gives some: that of its first track of video."""
    moov = _find(read, 0, size, b"moov")
    for kind, at, end in boxes(read, *moov):
        if kind != b"trak":
            continue
        media = _find(read, at, end, b"mdia")
        if _table(read, *_find(read, *media, b"hdlr"))[8:12] != b"vide":
            continue
        header = _table(read, *_find(read, *media, b"mdhd"))
        scale = struct.unpack_from(">I", header, 20 if header[:1] == b"\1" else 12)[0]
        samples = _find(read, *media, b"minf", b"stbl")
        entry = _table(read, *_find(read, *samples, b"stsd"))[8:]
        times = _table(read, *_find(read, *samples, b"stts"))
        n = struct.unpack_from(">I", times, 4)[0]
        if len(times) < 8 + 8 * n or len(entry) < 36:
            raise Damaged("a table ends early")
        runs = list(struct.iter_unpack(">II", times[8 : 8 + 8 * n]))
        frames, ticks = sum(c for c, _ in runs), sum(c * d for c, d in runs)
        width, height = struct.unpack_from(">HH", entry, 32)
        fps = frames * scale / ticks if ticks else 0.0
        return {"codec": entry[4:8].decode("latin-1"), "width": width, "height": height, "frames": frames, "fps": fps, "duration": frames / fps if fps else 0.0, "error": None}
    raise Damaged("no track of video")


def _info(read: Read, size: int) -> dict:
    try:
        return probe(read, size)
    except (Damaged, struct.error) as e:
        return dict.fromkeys((x.split()[0] for x in INFO.split(", "))) | {"error": str(e) or "damaged"}


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def _batch(batch: pa.RecordBatch, keep: list[str], found: list[dict]) -> pa.RecordBatch:
    names = [x.split() for x in INFO.split(", ")]
    own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*own, *(pa.array([f[n] for f in found], _KINDS[kind]) for n, kind in names)], names=[*keep, *(n for n, _ in names)])


def probed(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The key and INFO of files whose bytes are a column; no bytes are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = (x.as_py() or b"" for x in batch.column(1))
            yield _batch(batch, [key], [_info(lambda at, n, raw=raw: raw[at : at + n], len(raw)) for raw in raws])

    ship(files.sparkSession)
    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, {INFO}")


def probed_files(files: DataFrame) -> DataFrame:
    """path and INFO of files (path), of any file system that Arrow opens; only the parts that are asked for are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    system, place = pyarrow.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
                    with system.open_input_file(place) as f:
                        found.append(_info(lambda at, n, f=f: f.read_at(n, at), f.size()))
                except OSError as e:
                    found.append(dict.fromkeys((x.split()[0] for x in INFO.split(", "))) | {"error": str(e)})
            yield _batch(batch, ["path"], found)

    ship(files.sparkSession)
    return files.select("path").mapInArrow(run, f"path string, {INFO}")


def _number(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def _box(kind: str, *parts: Column) -> Column:
    """A box as hex digits. Its body stands in the expression once, as boxes lie in boxes: twice would double the work with each level."""
    whole = F.transform(F.array(F.concat(*parts)), lambda body: F.concat(_number(F.length(body) / 2 + 8, 8), F.lit(kind.encode().hex()), body))
    return F.element_at(whole, 1)


_CODES = ("avc1", "hvc1", "mp4v")


def _containers(spark, d) -> DataFrame:
    """A container for each part: tables of samples in two runs, headers of both versions, media before or behind, some cut off or without video."""
    k, zero = F.col("p_partkey"), lambda n: F.lit("00" * n)
    n = k % 300 + 1
    code = F.element_at(F.array(*(F.lit(c.encode().hex()) for c in _CODES)), (k % 3 + 1).cast("int"))
    times = _box("stts", zero(4), _number(F.lit(2), 8), _number(n, 8), _number(k % 50 + 500, 8), _number(F.lit(5), 8), _number(F.lit(1000), 8))
    entry = F.concat(_number(F.lit(86), 8), code, zero(24), _number(k % 1000 + 16, 4), _number(F.col("p_size") + 16, 4), zero(50))
    samples = _box("stbl", _box("stsd", zero(4), _number(F.lit(1), 8), entry), times)
    short = _box("mdhd", zero(12), _number(F.lit(15_000), 8), _number(n * 1000, 8), zero(4))
    long = _box("mdhd", F.lit("01"), zero(19), _number(F.lit(15_000), 8), _number(n * 1000, 16), zero(4))
    track = lambda kind, inside: _box("trak", _box("tkhd", zero(84)), _box("mdia", F.when(k % 7 == 0, long).otherwise(short), _box("hdlr", zero(8), F.lit(kind.encode().hex()), zero(12)), _box("minf", inside)))
    sound = track("soun", _box("stbl", _box("free", zero(3))))
    moov = F.when(k % 11 == 0, _box("moov", sound)).otherwise(_box("moov", _box("mvhd", zero(100)), sound, track("vide", samples)))
    filler = F.repeat(F.lit("5a"), (k % 400 + 20).cast("int"))
    mdat = F.when(k % 2 == 0, F.concat(F.lit("00000001"), F.lit(b"mdat".hex()), _number(F.length(filler) / 2 + 16, 16), filler)).otherwise(_box("mdat", filler))
    whole = F.concat(_box("ftyp", F.lit(b"isom".hex()), zero(4)), F.when(k % 4 < 2, F.concat(mdat, moov)).otherwise(F.concat(moov, mdat)))
    part = fixtures.table(spark, d, "part").select("p_partkey", "p_size")
    part = part.repartition(size_bins(part.count(), least=1), "p_partkey")  # few bytes, much work
    rows = part.select(k.alias("video_id"), whole.alias("whole"))
    return rows.select("video_id", F.unhex(F.when(F.col("video_id") % 13 == 0, F.substring("whole", 1, 400)).otherwise(F.col("whole"))).alias("content"))


@query("container_probe", f"""WITH v AS (SELECT p_partkey AS video_id, p_partkey % 300 + 1 AS n, p_partkey % 50 + 500 AS delta, p_partkey % 1000 + 16 AS w, p_size + 16 AS h, p_partkey % 11 = 0 OR p_partkey % 13 = 0 AS failed FROM part)
    SELECT video_id, CASE WHEN NOT failed THEN {list(_CODES)}[video_id % 3 + 1] END AS codec, CASE WHEN NOT failed THEN w || 'x' || h END AS dimensions, CASE WHEN NOT failed THEN n + 5 END AS frames,
        CASE WHEN NOT failed THEN round((n + 5) * 15000 / (n * delta + 5000)::DOUBLE, 6) END AS fps, CASE WHEN NOT failed THEN round((n * delta + 5000) / 15000::DOUBLE, 6) END AS duration, failed FROM v""")
def container_probe(spark, d):
    """Duration, frames, size and codec of videos, from the bytes of their containers."""
    found = probed(_containers(spark, d), "video_id")
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    return found.select("video_id", "codec", size.alias("dimensions"), "frames", F.round("fps", 6).alias("fps"), F.round("duration", 6).alias("duration"), F.col("error").isNotNull().alias("failed"))
