"""Scan of a photo library's own table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.registry import query
from prismlake.sources.catalogue import available, in_dates, known_people


def scan(
    rows: DataFrame, album: str | None = None, kind: str = "image", start: Column | None = None, end: Column | None = None, local_only: bool = True, limit: int | None = None
) -> DataFrame:
    """(photo_id, metadata, cached_path): a library's photos or movies, with 19 fields of metadata and the original's path.

    rows: ord, uuid, original_filename, date, title, description, keywords, albums, persons, favorite, hidden, latitude,
    longitude, uti, score (overall, curation), duplicates, burst, burst_key_photo, isphoto, ismovie; path and derivatives are
    those that are on disk. Undated rows are within any dates; rows without any local data are left out, and without their
    original as well if local_only. All predicates are on columns, so a store that has them applies them itself.
    """
    if kind not in ("image", "video"):
        raise ValueError(f"no kind {kind}")
    found = rows.where("isphoto" if kind == "image" else "ismovie")
    found = found.where(F.array_contains("albums", album)) if album else found
    low, high = start if start is not None else F.lit("0001-01-01").cast("timestamp"), end if end is not None else F.lit("9999-12-31").cast("timestamp")
    found = in_dates(found, "date", low, high)
    found = found.where("path IS NOT NULL") if local_only else available(found)
    found = found.orderBy("ord").limit(limit) if limit else found
    return found.select(F.col("uuid").alias("photo_id"), metadata(kind).alias("metadata"), F.col("path").alias("cached_path"))


def metadata(kind: str) -> Column:
    return F.struct(
        F.col("original_filename").alias("filename"), F.col("path").alias("filepath"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "title", "description", "keywords", "albums",
        known_people(F.col("persons")).alias("persons"), "favorite", "hidden", "latitude", "longitude", "uti", F.lit(kind).alias("media_type"), F.col("score.overall").alias("library_score"),
        F.col("score.curation").alias("library_curation"), F.get("duplicates", F.lit(0)).alias("duplicate_group"), F.col("burst").alias("is_burst"), F.col("burst_key_photo").alias("burst_key"),
    )


_LIBRARY = """lib AS (
    SELECT ord, photo_id, filename, media_type, person, CASE WHEN ord % 4 = 0 THEN '_UNKNOWN_' END AS other, CASE WHEN ord % 3 <> 0 THEN '/p/' || filename END AS path, CASE WHEN ord % 6 = 0 THEN 'thumb' END AS thumb,
        taken_us, ['trip', 'home'][ord % 2 + 1] AS album, is_favorite, score FROM media)"""


def _rows(spark, d) -> DataFrame:
    o = F.col("ord")
    text = lambda value: F.lit(value).cast("string")
    return fixtures.media(spark, d).select(
        "ord", F.col("photo_id").alias("uuid"), F.col("filename").alias("original_filename"), F.timestamp_micros("taken_us").alias("date"), text(None).alias("title"), F.concat(F.lit("no. "), o).alias("description"),
        F.array(F.lit("k")).alias("keywords"), F.array(F.when(o % 2 == 0, "trip").otherwise("home")).alias("albums"), F.array("person", F.when(o % 4 == 0, "_UNKNOWN_")).alias("persons"), F.col("is_favorite").alias("favorite"),
        F.lit(False).alias("hidden"), F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"), F.lit("public.jpeg").alias("uti"), F.when(o % 5 != 0, F.struct(F.col("score").alias("overall"), F.lit(0.5).alias("curation"))).alias("score"),
        F.when(o % 7 == 0, F.array(F.concat(F.lit("p"), o - o % 14))).otherwise(F.array().cast("array<string>")).alias("duplicates"), (o % 8 == 0).alias("burst"), (o % 16 == 0).alias("burst_key_photo"),
        (F.col("media_type") == "IMAGE").alias("isphoto"), (F.col("media_type") == "VIDEO").alias("ismovie"), F.when(o % 3 != 0, F.concat(F.lit("/p/"), "filename")).alias("path"), F.array(F.when(o % 6 == 0, "thumb")).alias("derivatives"),
    )


_OUT = """SELECT photo_id, filename, path AS cached_path, strftime(make_timestamp(taken_us), '%Y-%m-%dT%H:%M:%S') AS date, 'no. ' || ord AS description, array_to_string(list_filter([person, other], lambda x: x IS NOT NULL AND x <> '_UNKNOWN_'), ',') AS persons,
    is_favorite AS favorite, CASE WHEN ord % 5 <> 0 THEN score END AS library_score, CASE WHEN ord % 7 = 0 THEN 'p' || (ord - ord % 14) END AS duplicate_group, ord % 8 = 0 AS is_burst, ord % 16 = 0 AS burst_key FROM lib"""


def _flat(found: DataFrame) -> DataFrame:
    m = F.col("metadata")
    return found.select("photo_id", m["filename"].alias("filename"), "cached_path", F.array_join(m["persons"], ",").alias("persons"), *(m[c].alias(c) for c in ("date", "description", "favorite", "library_score", "duplicate_group", "is_burst", "burst_key")))


@query("scan_library", with_views("media") + f", {_LIBRARY} {_OUT} WHERE media_type = 'IMAGE' AND album = 'trip' AND path IS NOT NULL AND (taken_us IS NULL OR make_timestamp(taken_us) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-10 23:59:59')")
def scan_library(spark, d):
    """Photos of an album and of some weeks, whose originals are there."""
    bound = lambda s: F.lit(s).cast("timestamp")
    return _flat(scan(_rows(spark, d), "trip", "image", bound("2024-01-05 00:00:00"), bound("2024-02-10 23:59:59")))


@query("scan_library_movies", with_views("media") + f", {_LIBRARY} {_OUT} WHERE media_type = 'VIDEO' AND (path IS NOT NULL OR thumb IS NOT NULL)")
def scan_library_movies(spark, d):
    """Movies of which there is anything."""
    return _flat(scan(_rows(spark, d), kind="video", local_only=False))
