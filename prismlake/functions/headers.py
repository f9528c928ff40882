"""What an image file's first bytes say: format, size, and EXIF texts; in plain Python over Arrow batches, as no decoder is needed."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of EXIF tags and their names.
TAGS = {
    0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "DateTime", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings",
    0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x920A: "FocalLength", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight",
}
_SUB = 0x8769


def _value(raw: bytes, order: str, kind: int, count: int, slot: int) -> str | None:
    """A tag's value as text: of letters, whole numbers or fractions; None for other kinds."""
    size = {2: 1, 3: 2, 4: 4, 5: 8, 10: 8}.get(kind)
    if not size or not count:
        return None
    at = slot if size * count <= 4 else struct.unpack_from(f"{order}I", raw, slot)[0]
    if kind == 2:
        return raw[at : at + count].split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        up, down = struct.unpack_from(f"{order}{'II' if kind == 5 else 'ii'}", raw, at)
        return f"{up}/{down}"
    return str(struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", raw, at)[0])


def exif(raw: bytes) -> dict[str, str]:
    """exif_<name> of a TIFF block's known tags, those of its EXIF part included; what can't be read is left out."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order:
        return {}
    found, open_ = {}, [struct.unpack_from(f"{order}I", raw, 4)[0]]
    seen = set()
    while open_ and (at := open_.pop()) not in seen:
        seen.add(at)
        for i in range(struct.unpack_from(f"{order}H", raw, at)[0] if at + 2 <= len(raw) else 0):
            slot = at + 2 + 12 * i
            if slot + 12 > len(raw):
                break
            tag, kind, count = struct.unpack_from(f"{order}HHI", raw, slot)
            if tag == _SUB:
                open_.append(struct.unpack_from(f"{order}I", raw, slot + 8)[0])
            elif tag in TAGS:
                try:
                    value = _value(raw, order, kind, count, slot + 8)
                except struct.error:
                    value = None
                if value is not None:
                    found[f"exif_{TAGS[tag]}"] = value
    return found


def _jpeg(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    at = 2
    while at + 4 <= len(raw):
        marker, n = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        if raw[at] != 0xFF:
            break
        if marker == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            out |= exif(raw[at + 10 : at + 2 + n])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return out | {"format": "JPEG", "dimensions": f"{width}x{height}"}
        at += 2 + n
    raise ValueError("no frame")


def header(raw: bytes | None) -> dict[str, str]:
    """format, dimensions and exif_… of an image's bytes; `error` for what isn't an image that is known here."""
    raw = raw or b""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            width, height = struct.unpack_from(">II", raw, 16)
            return {"format": "PNG", "dimensions": f"{width}x{height}"}
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            width, height = struct.unpack_from("<HH", raw, 6)
            return {"format": "GIF", "dimensions": f"{width}x{height}"}
        if raw[:2] == b"\xff\xd8":
            return _jpeg(raw)
        if raw[:4] in (b"II*\0", b"MM\0*"):
            return {"format": "TIFF"} | exif(raw)
        raise ValueError("not an image")
    except (ValueError, struct.error) as wrong:
        return {"error": f"Could not read: {wrong}"}


def _headers(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(header)


def header_of(content: Column) -> Column:
    """header() as a map column; the caller ships the package."""
    return F.pandas_udf(_headers, "map<string,string>")(content)
