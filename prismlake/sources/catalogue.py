"""Scans of a catalogue: assets, albums, tags and people, each with the predicates that a store can apply itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.registry import query

UNKNOWN = "_UNKNOWN_"


def active(assets: DataFrame, kind: str | None = "IMAGE", skip_archived: bool = True) -> DataFrame:
    found = assets.where("NOT is_archived") if skip_archived else assets
    return found.where(F.col("media_type") == kind) if kind else found


def modified_since(assets: DataFrame, micros: int) -> DataFrame:
    return assets.where(F.col("updated_us") > micros)


def in_album(assets: DataFrame, members: DataFrame, albums: DataFrame, name: str) -> DataFrame:
    """Assets of the first album of exactly this name; none if there is no such album."""
    first = albums.where(F.col("name") == name).agg(F.min("album_id").alias("album_id"))
    return assets.join(members.join(F.broadcast(first), "album_id", "left_semi"), "asset_id", "left_semi")  # one row


def by_tag(assets: DataFrame, tagged: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Assets of the first tag of this name, or else of this value."""
    first = tags.where((F.col("name") == tag) | (F.col("value") == tag)).agg(F.min_by("tag_id", F.struct(F.col("name") != tag, "tag_id")).alias("tag_id"))
    return assets.join(tagged.join(F.broadcast(first), "tag_id", "left_semi"), "asset_id", "left_semi")  # one row


def in_dates(rows: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    """Rows within the bounds; those without a date pass."""
    return rows.where(F.col(column).isNull() | F.col(column).between(low, high))


def available(rows: DataFrame) -> DataFrame:
    """Rows whose original or any derivative is at hand."""
    return rows.where(F.col("path").isNotNull() | F.exists("derivatives", lambda p: p.isNotNull() & (p != "")))


def known_people(persons: Column) -> Column:
    return F.filter(persons, lambda x: x.isNotNull() & (x != UNKNOWN))


_ALBUMS = """albums AS (SELECT c_custkey AS album_id, c_mktsegment AS name FROM customer), album_asset AS (SELECT page_id % 20 + 1 AS album_id, 'a' || page_id AS asset_id FROM pages)"""


@query("scan_active_assets", with_views("assets") + "SELECT asset_id, path, filesize FROM assets WHERE NOT is_archived AND media_type = 'IMAGE'")
def scan_active_assets(spark, d):
    return active(fixtures.assets(spark, d)).select("asset_id", "path", "filesize")


@query("assets_in_album", with_views("assets") + f", {_ALBUMS} SELECT asset_id, path FROM assets WHERE asset_id IN (SELECT asset_id FROM album_asset WHERE album_id = (SELECT min(album_id) FROM albums WHERE name = 'MACHINERY'))")
def assets_in_album(spark, d):
    albums = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_mktsegment").alias("name"))
    members = fixtures.table(spark, d, "pages").select((F.col("page_id") % 20 + 1).alias("album_id"), F.concat(F.lit("a"), "page_id").alias("asset_id"))
    return in_album(fixtures.assets(spark, d), members, albums, "MACHINERY").select("asset_id", "path")


@query("assets_by_tag", with_views("assets") + """, tags AS (SELECT n_nationkey AS tag_id, n_name AS name, lower(n_name) AS value FROM nation), tagged AS (SELECT page_id % 25 AS tag_id, 'a' || page_id AS asset_id FROM pages)
    SELECT asset_id FROM assets WHERE asset_id IN (SELECT asset_id FROM tagged WHERE tag_id = (SELECT tag_id FROM tags WHERE name = (SELECT lower(min(n_name)) FROM nation) OR value = (SELECT lower(min(n_name)) FROM nation) ORDER BY name <> (SELECT lower(min(n_name)) FROM nation), tag_id LIMIT 1))""")
def assets_by_tag(spark, d):
    nation = fixtures.table(spark, d, "nation")
    tag = nation.agg(F.lower(F.min("n_name"))).first()[0]
    tags = nation.select(F.col("n_nationkey").cast("long").alias("tag_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("value"))
    tagged = fixtures.table(spark, d, "pages").select((F.col("page_id") % 25).alias("tag_id"), F.concat(F.lit("a"), "page_id").alias("asset_id"))
    return by_tag(fixtures.assets(spark, d), tagged, tags, tag).select("asset_id")


@query("modified_since", "SELECT event_id, event_type FROM events WHERE ts > (SELECT min(ts) + INTERVAL 10 DAY FROM events) AND event_type <> 'click'")
def modified_since_query(spark, d):
    events = fixtures.table(spark, d, "events").withColumn("updated_us", fixtures.micros("ts"))
    since = events.agg(F.min("updated_us")).first()[0] + 10 * 86_400_000_000
    return modified_since(events, since).where("event_type <> 'click'").select("event_id", "event_type")


@query("asset_lookup", with_views("assets") + "SELECT asset_id, path FROM assets WHERE asset_id IN (SELECT 'a' || n_nationkey FROM nation)")
def asset_lookup(spark, d):
    wanted = fixtures.table(spark, d, "nation").select(F.concat(F.lit("a"), "n_nationkey").alias("asset_id"))
    return fixtures.assets(spark, d).join(wanted, "asset_id", "left_semi").select("asset_id", "path")


@query("apple_date_range", with_views("media") + "SELECT ord, taken_us FROM media WHERE taken_us IS NULL OR taken_us BETWEEN epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(TIMESTAMP '2024-02-10 23:59:59')")
def apple_date_range(spark, d):
    bound = lambda s: fixtures.micros(F.lit(s).cast("timestamp_ntz"))
    return in_dates(fixtures.media(spark, d), "taken_us", bound("2024-01-05 00:00:00"), bound("2024-02-10 23:59:59")).select("ord", "taken_us")


@query("local_only", "SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 4 = 1")
def local_only(spark, d):
    k = F.col("page_id")
    rows = fixtures.table(spark, d, "pages").select("page_id", F.when(k % 3 == 0, F.col("url")).alias("path"), F.array(F.when(k % 4 == 1, "thumb.jpg"), F.lit("")).alias("derivatives"))
    return available(rows).select("page_id")


@query("known_people", with_views("media") + "SELECT ord, array_to_string(list_filter([person, CASE WHEN ord % 3 = 0 THEN '_UNKNOWN_' END, 'z'], lambda x: x IS NOT NULL AND x <> '_UNKNOWN_'), ',') AS persons FROM media")
def known_people_query(spark, d):
    persons = F.array("person", F.when(F.col("ord") % 3 == 0, UNKNOWN), F.lit("z"))
    return fixtures.media(spark, d).select("ord", F.array_join(known_people(persons), ",").alias("persons"))


@query("canonical_projection", with_views("assets", "local_files") + """SELECT 'server' AS source, asset_id AS photo_id, path AS filepath, regexp_extract(path, '[^/]*$') AS filename, filesize FROM assets
    UNION ALL SELECT 'local', path, path, regexp_extract(path, '[^/]*$'), filesize FROM local_files""")
def canonical_projection(spark, d):
    """Rows of two sources in the columns of one."""
    row = lambda source, key: [F.lit(source).alias("source"), F.col(key).alias("photo_id"), F.col("path").alias("filepath"), F.substring_index("path", "/", -1).alias("filename"), "filesize"]
    return fixtures.assets(spark, d).select(*row("server", "asset_id")).unionByName(fixtures.local_files(spark, d).select(*row("local", "path")))


@query("metadata_map", "SELECT event_id, json_extract_string(props, '$.k') AS exif_k, event_type AS exif_type, 2 AS n FROM events")
def metadata_map(spark, d):
    """Open metadata as a map of strings whose keys say where they come from."""
    parsed = F.from_json("props", "map<string,string>")
    exif = F.transform_keys(F.map_concat(parsed, F.create_map(F.lit("type"), "event_type")), lambda k, v: F.concat(F.lit("exif_"), k))
    return fixtures.table(spark, d, "events").select("event_id", exif.alias("m")).select("event_id", F.col("m")["exif_k"].alias("exif_k"), F.col("m")["exif_type"].alias("exif_type"), F.size("m").alias("n"))
