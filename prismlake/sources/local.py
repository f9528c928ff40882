"""Files of a folder, and JSON documents of reports and states."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.config import GroupingConfig
from prismlake import fixtures, versions
from prismlake.fixtures import with_views
from prismlake.functions.headers import header_of
from prismlake.functions.media import extension, media_type
from prismlake.registry import query
from prismlake.shipping import ship
from prismlake.storage import exists, new_path


def scan(spark: SparkSession, root: str, types: list[str] | None = None, kind: str | None = None, folder: str = "", limit: int | None = None) -> DataFrame:
    """(photo_id, filename, filesize, modified_us, media_type) of a folder's files; ids are paths below it. Bytes are not read.

    None as limit is all; otherwise the first in order of id.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/{folder}".rstrip("/"))
    place = F.split_part("path", F.lit(root.rstrip("/").split("://")[-1] + "/"), F.lit(-1))
    found = files.select(place.alias("photo_id"), F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("filesize"), F.unix_micros("modificationTime").alias("modified_us"), media_type(F.col("path")).alias("media_type"))
    found = found.where(extension(F.col("filename")).isin(types)) if types else found.where("media_type IS NOT NULL")
    found = found.where(F.col("media_type") == kind) if kind else found
    return found.orderBy("photo_id").limit(limit) if limit is not None else found


def contents(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """(photo_id, content) for the ids wanted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    place = F.split_part("path", F.lit(root.rstrip("/").split("://")[-1] + "/"), F.lit(-1))
    return files.select(place.alias("photo_id"), "content").join(ids, "photo_id", "left_semi")


def first_available(photos: DataFrame, files: DataFrame) -> DataFrame:
    """(photo_id, path, content) of photos (photo_id, path, derivatives): the first that files (path, content) have of the
    original and its derivatives in order; a photo of which none is there has nulls.

    Only the candidates' paths are joined with the files, so other contents are not shuffled.
    """
    candidates = photos.select("photo_id", F.posexplode(F.concat(F.array("path"), F.coalesce("derivatives", F.array().cast("array<string>")))).alias("place", "path")).where("path <> ''")
    there = candidates.join(files.select("path"), "path", "left_semi").groupBy("photo_id").agg(F.min_by("path", "place").alias("path"))
    return photos.select("photo_id").join(there.join(files, "path"), "photo_id", "left").select("photo_id", "path", "content")


def file_metadata(files: DataFrame) -> DataFrame:
    """(path, metadata) of files (path, length, modificationTime, content): name, path, size and time of the file, what its header says, and `error` if it says nothing."""
    ship(files.sparkSession)
    own = {"filename": F.substring_index("path", "/", -1), "filepath": F.col("path"), "filesize": F.col("length").cast("string"), "modified_time": F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss")}
    fixed = F.create_map(*(x for name, value in own.items() for x in (F.lit(name), value)))
    return files.select("path", F.map_concat(fixed, header_of(F.col("content"))).alias("metadata"))


STATE = "version int, processed_hashes map<string,string>, completed_groups array<bigint>, discovered bigint, hashed bigint, last_sync string, fingerprint string"


def state(spark: SparkSession, path: str) -> DataFrame:
    """A state document with fields of older versions filled in: the last that was committed, or what is at path where nothing was."""
    found = spark.read.schema(STATE).option("multiLine", True).json(versions.folder(spark, path) or path)
    empty = {"version": F.lit(1), "processed_hashes": F.create_map().cast("map<string,string>"), "completed_groups": F.array().cast("array<bigint>"), "discovered": F.lit(0), "hashed": F.lit(0)}
    return found.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


def fingerprint(source: str, path: str, config: GroupingConfig) -> str:
    """What a run's checkpoint belongs to: all that its result depends on. A run resumes only one of the same fingerprint."""
    return hashlib.sha256(json.dumps([source, path, asdict(config)], sort_keys=True).encode()).hexdigest()


def resume(spark: SparkSession, path: str, wanted: str) -> DataFrame | None:
    """The state at path if a run of the fingerprint `wanted` wrote it; None if there is none, ValueError if another run's is there."""
    if versions.folder(spark, path) is None and (not exists(spark, path) or versions.listed(spark, f"{path.rstrip('/')}/v*")):
        return None  # also where the first write died
    found = state(spark, path)
    others = {r["fingerprint"] for r in found.select("fingerprint").distinct().limit(2).collect()} - {wanted}
    if others:
        raise ValueError("the state is of a run with other settings")
    return found


def write_state(df: DataFrame, path: str) -> int:
    """Commits the document as the next version of the state at path; until then readers see the one before, and after a crash as well."""
    return versions.replace(df.coalesce(1), path)


@query("state_committed", with_views("media") + "SELECT photo_id, printf('%08x%08x', hash_hi, hash_lo) AS hash, 2::BIGINT AS version FROM media")
def state_committed(spark, d):
    """Hashes of the library from its state: half of them were committed first, then all; a third write dies on the way, and changes nothing."""
    word = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    found = fixtures.media(spark, d).select("photo_id", F.concat(word("hash_hi"), word("hash_lo")).alias("hash"), "ord")
    path = new_path(spark, "state")
    saved = lambda rows: rows.select(F.col("photo_id").alias("id"), "hash")
    for rows in (found.where("ord % 2 = 0"), found):
        versions.replace(saved(rows), path, "parquet")
    try:
        versions.replace(saved(found).withColumn("hash", F.when(F.col("id") != "", F.raise_error(F.lit("dies")))), path, "parquet")
    except SparkRuntimeException:
        pass
    number = versions.current(spark, path)["number"]
    return spark.read.parquet(versions.folder(spark, path)).select(F.col("id").alias("photo_id"), "hash", F.lit(number).cast("long").alias("version"))


@query("content_fallback", """WITH p AS (SELECT page_id, ['o' || page_id || '.jpg', CASE WHEN page_id % 4 = 0 THEN '' ELSE 'd1_' || page_id END, 'd2_' || page_id] AS c FROM pages),
    f AS (SELECT 'o' || page_id || '.jpg' AS path, length(html) AS n FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'd1_' || page_id, 7 FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT 'd2_' || page_id, 5 FROM pages WHERE page_id % 2 = 0),
    x AS (SELECT page_id, unnest(c) AS path, generate_subscripts(c, 1) AS i FROM p), m AS (SELECT page_id, path, n FROM x JOIN f USING (path) WHERE path <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) = 1)
    SELECT 'a' || p.page_id AS photo_id, m.path, m.n::BIGINT AS n FROM p LEFT JOIN m USING (page_id)""")
def content_fallback(spark, d):
    """Original, else the first derivative that is there."""
    k, pages = F.col("page_id"), fixtures.table(spark, d, "pages")
    name = lambda start, end="": F.concat(F.lit(start), k, F.lit(end))
    photos = pages.select(name("a").alias("photo_id"), name("o", ".jpg").alias("path"), F.array(F.when(k % 4 == 0, "").otherwise(name("d1_")), name("d2_")).alias("derivatives"))
    files = pages.where(k % 3 == 0).select(name("o", ".jpg").alias("path"), F.col("html").alias("content"))
    for start, n, content in (("d1_", k % 3 == 1, "seven 7"), ("d2_", k % 2 == 0, "five5")):
        files = files.union(pages.where(n).select(name(start), F.lit(content)))
    return first_available(photos, files).select("photo_id", "path", F.length("content").cast("long").alias("n"))


@query("file_metadata", """WITH f AS (SELECT p_partkey AS k, 16 + p_partkey % 600 AS w, 9 + p_size AS h FROM part)
    SELECT 'x/' || k || '.img' AS path, k || '.img' AS filename, CASE WHEN k % 3 < 2 THEN w || 'x' || h END AS dimensions, CASE k % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'GIF' END AS format, k % 3 = 2 AS failed, CASE k % 3 WHEN 0 THEN '24' WHEN 1 THEN '10' ELSE '4' END AS filesize FROM f""")
def file_metadata_query(spark, d):
    """Headers of three kinds, made of numbers."""
    k, part = F.col("p_partkey"), fixtures.table(spark, d, "part")
    number = lambda value, digits: F.lpad(F.hex(value), digits, "0")
    little = lambda value: F.concat(F.substring(number(value, 4), 3, 2), F.substring(number(value, 4), 1, 2))
    w, h = (F.lit(16) + k % 600).cast("long"), (F.lit(9) + F.col("p_size")).cast("long")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w, 8), number(h, 8))
    content = F.unhex(F.when(k % 3 == 0, png).when(k % 3 == 1, F.concat(F.hex(F.lit("GIF89a")), little(w), little(h))).otherwise(F.hex(F.lit("text"))))
    files = part.select(F.concat(F.lit("x/"), k, F.lit(".img")).alias("path"), content.alias("content"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"))
    m = F.col("metadata")
    found = file_metadata(files.withColumn("length", F.length("content")))
    return found.select("path", *(F.try_element_at(m, F.lit(c)).alias(c) for c in ("filename", "dimensions", "format", "filesize")), F.map_contains_key(m, "error").alias("failed"))


@query("scan_local")
def scan_local(spark, d):
    """The input's own files."""
    return scan(spark, d, types=[".parquet"]).select("photo_id", "filename", "filesize", "media_type")
