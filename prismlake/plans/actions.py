"""What a run would do to albums, tags, flags and files, as tables; a dry run is to look at one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.operators.people import ALBUMS_SQL, album_names
from prismlake.operators.ranking import REPORT, report_rows
from prismlake.registry import query

TAGS = "organized"


def tag_plan(photos: DataFrame, modifications: list[str], prefix: str = TAGS) -> DataFrame:
    """(tag, asset_id): the group's tag and its person's on all, best and changes on the best, non-best on the rest."""
    tag = lambda text, rows: rows.select(F.concat(F.lit(f"{prefix}/"), text).alias("tag"), "asset_id")
    best = photos.where("is_best")
    parts = [
        tag(F.format_string("group-%04d", "group_index"), photos), tag(F.lit("best"), best), tag(F.lit("non-best"), photos.where("NOT is_best")),
        tag(F.concat(F.lit("person-"), "person"), photos.where("person IS NOT NULL")), *(tag(F.lit(f"modified/{m}"), best) for m in modifications),
    ]
    return reduce(DataFrame.unionByName, parts)


def album_plan(photos: DataFrame, albums: DataFrame) -> DataFrame:
    """(album, asset_id): all photos of a group into the album (group_index, album) that it is to have."""
    return photos.join(albums, "group_index").select("album", "asset_id")


def flag_plan(photos: DataFrame) -> DataFrame:
    """(asset_id, favorite, archived): the best is a favourite, the others are archived; null leaves a flag as it is.

    An update is a row of the fields that change: with_description adds a text to it.
    """
    return photos.select("asset_id", F.when(F.col("is_best"), True).alias("favorite"), F.when(~F.col("is_best"), True).alias("archived"))


def with_description(plan: DataFrame, texts: DataFrame) -> DataFrame:
    """A plan of updates (asset_id, …) with `description`, where texts (asset_id, description) have one; assets that only have a text are added."""
    return plan.join(texts.select("asset_id", "description"), "asset_id", "full")


def destinations(photos: DataFrame) -> DataFrame:
    """(group_index, ordinal, target): paths in a group's folder. All photos go to originals/, the best beside it once more as best_….

    In originals/ the second of a name gets _1, the third _2; a name that a file has of itself, such as a_1.jpg, is not
    looked for among those given. The best's copy keeps its name, as it is the only one.
    """
    again = F.row_number().over(Window.partitionBy("group_index", "filename").orderBy("ordinal")) - 1
    stem, end = F.regexp_replace("filename", r"(\.[^.]*)$", ""), F.regexp_extract("filename", r"(\.[^.]*)$", 1)
    target = F.when(again > 0, F.concat(stem, F.lit("_"), again, end)).otherwise(F.col("filename"))
    placed = photos.withColumn("_target", target)
    paths = F.array(F.concat(F.lit("originals/"), "_target"), F.when(F.col("is_best"), F.concat(F.lit("best_"), "filename")))
    return placed.select("group_index", "ordinal", F.explode(F.filter(paths, lambda p: p.isNotNull())).alias("target"))


def import_plan(outputs: DataFrame, wanted: tuple[str, ...], album: str) -> DataFrame:
    """(group_index, path, album): of each group's files (group_index, path) the first of the wanted names, to be taken into the library."""
    name = F.substring_index("path", "/", -1)
    place = F.array_position(F.array(*map(F.lit, wanted)), name)
    found = outputs.where(name.isin(*wanted)).groupBy("group_index").agg(F.min_by("path", place).alias("path"))
    return found.withColumn("album", F.lit(album))


def with_prefix(names: DataFrame, prefix: str) -> DataFrame:
    return names.where(F.startswith("name", F.lit(prefix)))


def missing_tags(plan: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of a plan that are to be made first."""
    return plan.select(F.col("tag").alias("name")).distinct().join(tags.select("name"), "name", "left_anti")


def cleanup_plan(photos: DataFrame, tags: DataFrame, albums: DataFrame, prefix: str) -> DataFrame:
    """(step, action, target): what undoes a run, in order."""
    row = lambda step, action, rows, key: rows.select(F.lit(step).alias("step"), F.lit(action).alias("action"), F.col(key).alias("target"))
    parts = [row(1, "unfavorite", photos.where("is_best"), "asset_id"), row(2, "unarchive", photos.where("NOT is_best"), "asset_id"), row(3, "delete_tag", with_prefix(tags, prefix), "name"), row(4, "delete_album", with_prefix(albums, prefix), "name")]
    return reduce(DataFrame.unionByName, parts)


def keyworded(rows: DataFrame, keywords: Column, prefix: str) -> DataFrame:
    return rows.where(F.exists(keywords, lambda k: F.startswith(k, F.lit(prefix))))


_VIEWS = with_views("media") + f", {REPORT}"


@query("tag_plan", _VIEWS + f""" SELECT '{TAGS}/group-' || printf('%04d', group_index) AS tag, asset_id FROM report UNION ALL SELECT '{TAGS}/best', asset_id FROM report WHERE is_best
    UNION ALL SELECT '{TAGS}/non-best', asset_id FROM report WHERE NOT is_best UNION ALL SELECT '{TAGS}/person-' || person, asset_id FROM report WHERE person IS NOT NULL
    UNION ALL SELECT '{TAGS}/modified/hdr', asset_id FROM report WHERE is_best""")
def tag_plan_query(spark, d):
    return tag_plan(report_rows(spark, d), ["hdr"])


@query("album_plan", _VIEWS + f", {ALBUMS_SQL} SELECT album, asset_id FROM report JOIN named USING (group_index)")
def album_plan_query(spark, d):
    return album_plan(report_rows(spark, d), album_names(spark, d))


@query("favorite_archive_plan", _VIEWS + " SELECT asset_id, CASE WHEN is_best THEN true END AS favorite, CASE WHEN NOT is_best THEN true END AS archived FROM report")
def favorite_archive_plan(spark, d):
    return flag_plan(report_rows(spark, d))


@query("dest_filenames", _VIEWS + """, f AS (SELECT group_index, ordinal, is_best, 'IMG_' || (ordinal % 2) || '.jpg' AS filename FROM report), r AS (SELECT *, row_number() OVER (PARTITION BY group_index, filename ORDER BY ordinal) - 1 AS k FROM f)
    SELECT group_index, ordinal, 'originals/' || CASE WHEN k > 0 THEN regexp_replace(filename, '\\.[^.]*$', '') || '_' || k || '.jpg' ELSE filename END AS target FROM r
    UNION ALL SELECT group_index, ordinal, 'best_' || filename FROM f WHERE is_best""")
def dest_filenames(spark, d):
    return destinations(report_rows(spark, d).withColumn("filename", F.concat(F.lit("IMG_"), F.col("ordinal") % 2, F.lit(".jpg"))))


@query("import_plan", """SELECT p_partkey AS group_index, 'group_' || printf('%04d', p_partkey) || CASE WHEN p_partkey % 3 = 0 THEN '/face_swapped.jpg' ELSE '/face_swapped_reprocessed.jpg' END AS path, 'Face Swapped' AS album FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0""")
def import_plan_query(spark, d):
    k = F.col("p_partkey")
    folder = F.format_string("group_%04d", k)
    names = F.array(F.lit("best_a.jpg"), F.when(k % 2 == 0, "face_swapped_reprocessed.jpg"), F.when(k % 3 == 0, "face_swapped.jpg"))
    files = fixtures.table(spark, d, "part").select(k.alias("group_index"), folder.alias("folder"), F.explode(names).alias("name")).where("name IS NOT NULL")
    return import_plan(files.select("group_index", F.concat_ws("/", "folder", "name").alias("path")), ("face_swapped.jpg", "face_swapped_reprocessed.jpg"), "Face Swapped")


@query("update_plan", _VIEWS + """ SELECT r.asset_id, CASE WHEN is_best THEN true END AS favorite, CASE WHEN NOT is_best THEN true END AS archived, CASE WHEN group_index % 5 = 0 THEN 'group ' || group_index END AS description FROM report r""")
def update_plan(spark, d):
    """Flags with the descriptions of some groups' photos."""
    rows = report_rows(spark, d)
    texts = rows.where("group_index % 5 = 0").select("asset_id", F.concat(F.lit("group "), "group_index").alias("description"))
    return with_description(flag_plan(rows), texts)


@query("tags_by_prefix", "SELECT n_name AS name FROM nation WHERE starts_with(n_name, 'NATION_1')")
def tags_by_prefix(spark, d):
    return with_prefix(fixtures.table(spark, d, "nation").select(F.col("n_name").alias("name")), "NATION_1")


@query("missing_tags", _VIEWS + f" SELECT DISTINCT '{TAGS}/group-' || printf('%04d', group_index) AS name FROM report WHERE group_index % 2 = 0")
def missing_tags_query(spark, d):
    plan = tag_plan(report_rows(spark, d), []).where(F.contains("tag", F.lit("/group-")))
    there = report_rows(spark, d).where("group_index % 2 <> 0").select(F.format_string(f"{TAGS}/group-%04d", "group_index").alias("name")).distinct()
    return missing_tags(plan, there)


@query("albums_by_prefix", "SELECT count(*) AS matched, count(*) FILTER (c_acctbal > 0) AS deleted FROM customer WHERE starts_with(c_mktsegment, 'MA')")
def albums_by_prefix(spark, d):
    albums = fixtures.table(spark, d, "customer").withColumn("name", F.col("c_mktsegment"))
    return with_prefix(albums, "MA").agg(F.count("*").alias("matched"), F.count_if(F.col("c_acctbal") > 0).alias("deleted"))


@query("cleanup_plan", _VIEWS + """ SELECT 1 AS step, 'unfavorite' AS action, asset_id AS target FROM report WHERE is_best UNION ALL SELECT 2, 'unarchive', asset_id FROM report WHERE NOT is_best
    UNION ALL SELECT 3, 'delete_tag', n_name FROM nation WHERE starts_with(n_name, 'N') UNION ALL SELECT 4, 'delete_album', r_name FROM region WHERE starts_with(r_name, 'N')""")
def cleanup_plan_query(spark, d):
    name = lambda t, c: fixtures.table(spark, d, t).select(F.col(c).alias("name"))
    return cleanup_plan(report_rows(spark, d), name("nation", "n_name"), name("region", "r_name"), "N")


@query("keyword_prefix_count", "SELECT count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_type, 'Brand#1')")
def keyword_prefix_count(spark, d):
    return keyworded(fixtures.table(spark, d, "part"), F.array("p_brand", "p_type"), "Brand#1").agg(F.count("*").alias("n"))
