"""Scans of a media server's answers: pages of assets, tags and albums, landed as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.registry import query
from prismlake.storage import new_path

#: One item of a page.
ITEM = (
    "id string, type string, originalFileName string, originalPath string, fileCreatedAt string, fileModifiedAt string, updatedAt string, isFavorite boolean, isArchived boolean, "
    "duplicateId string, exifInfo struct<fileSizeInByte:bigint,exifImageWidth:int,exifImageHeight:int,dateTimeOriginal:string,exposureTime:string,make:string,model:string,latitude:double,longitude:double>, "
    "people array<struct<id:string,name:string>>, tags array<struct<id:string,name:string,value:string>>"
)
#: A page's document.
PAGE = f"page bigint, size bigint, assets struct<items:array<struct<{', '.join(f'{name}:{kind}' for name, kind in (x.split(' ', 1) for x in ITEM.split(', ')))}>>>"
TAG, ALBUM = "id string, name string, value string", "id string, albumName string, assetCount bigint"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON document a line; each page is a row, so pages are read in parallel."""
    return spark.read.schema(PAGE).json(path)


def items(pages: DataFrame) -> DataFrame:
    """(page, place, an item's fields) up to the first page that is empty or shorter than its size, which is where a server's list ends.

    Pages behind that one are of an older, longer listing and don't count.
    """
    n = F.coalesce(F.size("assets.items"), F.lit(0))
    last = pages.agg(F.min(F.when(n < F.col("size"), F.col("page"))).alias("_last"))
    listed = pages.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("page") <= F.col("_last")))  # one row
    return listed.select("page", F.posexplode("assets.items").alias("place", "item")).select("page", "place", "item.*")


def scan(pages: DataFrame, kind: str | None = "IMAGE", skip_archived: bool = True, limit: int | None = None) -> DataFrame:
    """scan_items() of landed pages."""
    return scan_items(items(pages), kind, skip_archived, limit)


def scan_items(found: DataFrame, kind: str | None = "IMAGE", skip_archived: bool = True, limit: int | None = None) -> DataFrame:
    """The canonical columns of the items of a kind; with a limit the first in the server's order."""
    found = found.where(F.col("type") == kind) if kind else found
    found = found.where(~F.coalesce("isArchived", F.lit(False))) if skip_archived else found
    found = found.orderBy("page", "place").limit(limit) if limit is not None else found
    e = F.col("exifInfo")
    return found.select(
        F.lit("server").alias("source"), F.col("id").alias("photo_id"), F.col("type").alias("media_type"), F.col("originalFileName").alias("filename"), F.col("originalPath").alias("filepath"),
        e["fileSizeInByte"].alias("filesize"), e["exifImageWidth"].alias("width"), e["exifImageHeight"].alias("height"), F.coalesce(e["dateTimeOriginal"], "fileCreatedAt").alias("taken"),
        F.coalesce("isFavorite", F.lit(False)).alias("is_favorite"), F.coalesce("isArchived", F.lit(False)).alias("is_archived"), F.transform("people", lambda p: p["name"]).alias("persons"),
        F.transform("tags", lambda t: t["name"]).alias("keywords"), F.col("duplicateId").alias("duplicate_group"),
    )


def tag_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAG).json(path)


def album_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALBUM).json(path)


_SIZE = 40


def _landed(spark, d) -> str:
    """The fixture's assets as pages of 40, and one page of an older listing behind the last."""
    k = F.col("ord")
    exif = F.struct(F.col("filesize").alias("fileSizeInByte"), F.lit(640).alias("exifImageWidth"), F.lit(480).alias("exifImageHeight"))
    people = F.array(F.struct(F.concat(F.lit("u"), k % 3).alias("id"), F.concat(F.lit("Zoé "), k % 3).alias("name")))
    item = F.struct(F.col("asset_id").alias("id"), F.col("media_type").alias("type"), F.substring_index("path", "/", -1).alias("originalFileName"), F.col("path").alias("originalPath"), F.col("is_archived").alias("isArchived"), F.when(k % 2 == 0, True).alias("isFavorite"), exif.alias("exifInfo"), people.alias("people"))
    rows = fixtures.assets(spark, d).select(F.floor(k / _SIZE).cast("long").alias("page"), F.struct("ord", item.alias("item")).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["item"])
    pages = rows.groupBy("page").agg(F.struct(listed.alias("items")).alias("assets"))
    old = pages.where("page = 0").withColumn("page", F.lit(1_000_000).cast("long"))
    path = new_path(spark, "pages")
    pages.union(old).withColumn("size", F.lit(_SIZE).cast("long")).write.json(path)
    return path


@query("scan_server_pages", with_views("assets") + f""", n AS (SELECT ord // {_SIZE} AS page, count(*) AS n FROM assets GROUP BY 1), l AS (SELECT min(page) AS last FROM n WHERE n < {_SIZE})
    SELECT asset_id AS photo_id, regexp_extract(path, '[^/]*$') AS filename, filesize, ord % 2 = 0 AS is_favorite, 'Zoé ' || (ord % 3) AS persons FROM assets, l WHERE media_type = 'IMAGE' AND NOT is_archived AND (last IS NULL OR ord // {_SIZE} <= last)""")
def scan_server_pages(spark, d):
    return scan(read_pages(spark, _landed(spark, d))).select("photo_id", "filename", "filesize", "is_favorite", F.array_join("persons", ",").alias("persons"))


@query("scan_server_limit", with_views("assets") + "SELECT asset_id AS photo_id FROM assets WHERE media_type = 'IMAGE' ORDER BY ord LIMIT 30")
def scan_server_limit(spark, d):
    """The first 30, archived ones as well."""
    return scan(read_pages(spark, _landed(spark, d)), skip_archived=False, limit=30).select("photo_id")


@query("tag_list", "SELECT '' || n_nationkey AS id, n_name AS name, lower(n_name) AS value FROM nation")
def tag_list_query(spark, d):
    path = new_path(spark, "tags")
    fixtures.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("value")).write.json(path)
    return tag_list(spark, path)


@query("album_list", "SELECT '' || (page_id % 20) AS id, 'Album ' || (page_id % 20) AS albumName, count(*) AS assetCount FROM pages GROUP BY page_id % 20")
def album_list_query(spark, d):
    path, k = new_path(spark, "albums"), F.col("page_id") % 20
    fixtures.table(spark, d, "pages").groupBy(k.cast("string").alias("id"), F.concat(F.lit("Album "), k).alias("albumName")).agg(F.count("*").alias("assetCount")).write.json(path)
    return album_list(spark, path)
