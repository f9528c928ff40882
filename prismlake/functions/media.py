"""Scalar functions of media features, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file types that count as images and as videos.
IMAGE_TYPES = [".jpg", ".jpeg", ".png", ".heic", ".cr2", ".nef", ".arw", ".dng", ".gif", ".webp"]
VIDEO_TYPES = [".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v", ".wmv", ".flv", ".mpg", ".mpeg", ".3gp", ".mts"]


def hamming(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Differing bits of hashes given as words."""
    bits = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    return sum(bits[1:], bits[0]).cast("long")


def video_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """From a to b: mean over a's frames of the nearest frame of b, thumbnails, and a penalty for unequal durations; 64 at most."""
    nearest = F.transform(a["frames"], lambda x: F.array_min(F.transform(b["frames"], lambda y: F.bit_count(x.bitwiseXOR(y)))))
    mean = F.aggregate(nearest, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(a["frames"])
    thumb = F.coalesce(F.bit_count(a["thumb"].bitwiseXOR(b["thumb"])).cast("double"), mean)
    known = (a["duration"] > 0) & (b["duration"] > 0)
    penalty = F.when(known, (1 - F.least(a["duration"], b["duration"]) / F.greatest(a["duration"], b["duration"])) * 10).otherwise(0.0)
    empty = (F.coalesce(F.size(a["frames"]), F.lit(0)) < 1) | (F.coalesce(F.size(b["frames"]), F.lit(0)) < 1)
    return F.when(empty, 64.0).otherwise(F.least(mean * 0.6 + thumb * 0.3 + penalty * 0.1, F.lit(64.0)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def eye_aspect_ratio(points: Column) -> Column:
    """Of six (x, y); 1 if there are fewer or the eye has no width."""
    far = lambda i, j: F.sqrt(F.pow(points[i]["x"] - points[j]["x"], 2) + F.pow(points[i]["y"] - points[j]["y"], 2))
    return F.when((F.size(points) < 6) | (far(0, 3) == 0), 1.0).otherwise((far(1, 5) + far(2, 4)) / (2 * far(0, 3)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    return F.when(extension(path).isin(VIDEO_TYPES), "VIDEO").when(extension(path).isin(IMAGE_TYPES), "IMAGE")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def pixels(dimensions: Column) -> Column:
    """Of text such as 640x480; 0 if it is malformed."""
    parts = F.split(dimensions, "x")
    return F.when(F.size(parts) == 2, F.coalesce(parts[0].try_cast("long") * parts[1].try_cast("long"), F.lit(0))).otherwise(0).cast("long")


def size_number(text: Column) -> Column:
    """Of text with thousands' commas; 0 if it is malformed."""
    return F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def exposure(text: Column) -> Column:
    """Of a fraction or a number; null if malformed or divided by 0."""
    parts = F.split(text, "/")
    fraction = F.try_divide(parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    return F.when(F.size(parts) == 2, fraction).when(F.size(parts) == 1, text.try_cast("double"))


def album_part(name: Column) -> Column:
    """Letters, digits, underscores and blanks of a name."""
    return F.trim(F.regexp_replace(name, r"(?U)[^\w ]", ""))
