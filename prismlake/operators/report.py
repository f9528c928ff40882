"""A report's groups as rows, their edits and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake import fixtures, versions
from prismlake.fixtures import with_views
from prismlake.operators.ranking import REPORT, report_rows
from prismlake.operators.similarity import ALL_GROUPS, groups_of_media
from prismlake.registry import query
from prismlake.storage import new_path

#: Names that a report keeps of an asset's metadata, beside those that begin with exif_; and values that say nothing.
KEPT_NAMES, EMPTY = ["dimensions", "filesize", "filepath", "local_path"], ["", "None", "0"]


def merge_groups(photos: DataFrame, groups: list[int]) -> DataFrame:
    """Photos with the given groups merged into the lowest: in order of group and place, with its best alone; at least two."""
    if len(set(groups)) < 2:
        raise ValueError("at least 2 groups are needed")
    target, inside = min(groups), F.col("group_index").isin(groups)
    at = Window.partitionBy(F.when(inside, target).otherwise(F.col("group_index"))).orderBy("group_index", "ordinal")
    return photos.withColumn("_ordinal", F.row_number().over(at).cast("long")).select(
        F.when(inside, F.lit(target).cast("long")).otherwise(F.col("group_index")).alias("group_index"), F.col("_ordinal").alias("ordinal"), "asset_id", (F.col("is_best") & (~inside | (F.col("group_index") == target))).alias("is_best")
    )


def merge_actions(actions: DataFrame, groups: list[int]) -> DataFrame:
    """(group_index, actions): sets of actions, united where groups are merged."""
    into = F.when(F.col("group_index").isin(groups), F.lit(min(groups)).cast("long")).otherwise(F.col("group_index"))
    return actions.groupBy(into.alias("group_index")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("actions")))).alias("actions"))


def split_group(photos: DataFrame, group: int, moved: Column) -> DataFrame:
    """Photos with those of a group for which `moved` holds in a new last group, the first of them its best.

    If the source loses its best, its first photo is it. A group from which all or none would move stays as it is.
    """
    goes = (F.col("group_index") == group) & moved
    marked, own = photos.withColumn("_goes", goes), Window.partitionBy("group_index")
    last, n, left = marked.agg(F.max("group_index"), F.count_if(F.col("_goes")), F.count_if((F.col("group_index") == group) & ~F.col("_goes"))).first()
    if not n or not left:
        return photos
    placed = marked.withColumn("group_index", F.when(F.col("_goes"), F.lit(last + 1).cast("long")).otherwise(F.col("group_index")))
    at = own.orderBy("ordinal")
    first = F.row_number().over(at) == 1
    has_best = F.max(F.col("is_best") & ~F.col("_goes")).over(own)
    best = F.when(F.col("_goes") | ((F.col("group_index") == group) & ~has_best), first).otherwise(F.col("is_best"))
    return placed.select("group_index", F.row_number().over(at).cast("long").alias("ordinal"), "asset_id", best.alias("is_best"))


def set_best(photos: DataFrame, group: int, asset: str) -> DataFrame:
    return photos.withColumn("is_best", F.when(F.col("group_index") == group, F.col("asset_id") == asset).otherwise(F.col("is_best")))


def select_metadata(meta: Column) -> Column:
    """Of a map the entries that a report keeps."""
    return F.map_filter(meta, lambda k, v: (k.startswith("exif_") | k.isin(KEPT_NAMES)) & v.isNotNull() & ~v.isin(EMPTY))


def actions_taken(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in flags.items())), lambda x: x.isNotNull())


def report_groups(members: DataFrame) -> DataFrame:
    """Nested groups of a report, of (group_index, ordinal, photo_id, filename, score): best and photos in order."""
    photo = F.struct("ordinal", "photo_id", "filename")
    best = F.min_by(F.struct("photo_id", "filename"), F.struct((-F.col("score")).alias("s"), "ordinal")).alias("best_photo")
    return members.groupBy("group_index").agg(F.count("*").alias("photo_count"), best, F.array_sort(F.collect_list(photo)).alias("photos"))


def write_report(groups: DataFrame, path: str, settings: dict[str, str]) -> int:
    """One JSON document for each group, with the run's settings, as the next version of the report at path; its number.

    A report may be written again after every group: readers see the version before until the new one is whole.
    """
    return versions.replace(groups.withColumn("settings", F.create_map(*(F.lit(x) for pair in settings.items() for x in pair))), path)


#: A report's group as JSON.
GROUP = (
    "group_index bigint, photo_count bigint, settings map<string,string>, generated_at string, "
    "photos array<struct<ordinal:bigint,asset_id:string,filename:string,filepath:string,local_path:string>>"
)


def save_report(groups: DataFrame, folder: str, name: str, settings: dict[str, str], generated_at: str) -> None:
    """Groups (group_index, photo_count, photos) as JSON lines in folder/report_<name>, each with the run's settings and time; then the folder's latest report is this one."""
    spark = groups.sparkSession
    write_report(groups.withColumn("generated_at", F.lit(generated_at)), f"{folder}/report_{name}", settings)
    versions.commit(spark, folder, (versions.current(spark, folder) or {"number": 0})["number"] + 1, report=f"report_{name}")


def _read_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    read = spark.read.schema(f"{GROUP}, broken string").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", True)
    found = read.json(paths) if paths else spark.createDataFrame([], f"{GROUP}, broken string")
    return found.withColumn("report", F.regexp_extract(F.input_file_name(), r"/(report_[^/]*)/", 1))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(report, and a group's fields) of the last versions of all reports of a folder; lines that aren't JSON have only `broken`."""
    paths = versions.listed(spark, f"{folder}/report_*")
    return _read_reports(spark, [versions.folder(spark, p) or p for p in paths])


def latest_report(spark: SparkSession, folder: str) -> DataFrame:
    """read_reports of the report that was saved last."""
    found = versions.current(spark, folder)
    path = f"{folder}/{found['report']}" if found else None
    return _read_reports(spark, [versions.folder(spark, path) or path] if path else [])


def list_reports(reports: DataFrame, wanted: tuple[str, ...] = ("source_type", "threshold", "limit")) -> DataFrame:
    """(report, generated_at, total_groups, total_photos, one column for each setting, error), newest first; names sort by time."""
    setting = [F.max(F.col("settings")[k]).alias(k) for k in wanted]
    broken = F.when(F.count("broken") > 0, F.lit("Could not parse")).alias("error")
    found = reports.groupBy("report").agg(F.max("generated_at").alias("generated_at"), F.count("group_index").alias("total_groups"), F.coalesce(F.sum("photo_count"), F.lit(0)).alias("total_photos"), *setting, broken)
    return found.orderBy(F.col("report").desc())


def report_paths(reports: DataFrame) -> DataFrame:
    """(asset_id, path): where a report says that an asset's file is; the last group that names one counts."""
    photos = reports.select("report", "group_index", F.inline("photos"))
    path = F.coalesce(F.nullif("filepath", F.lit("")), F.nullif("local_path", F.lit("")))
    named = photos.select("asset_id", path.alias("path"), F.struct("report", "group_index", "ordinal").alias("at")).where("asset_id <> '' AND path IS NOT NULL")
    return named.groupBy("asset_id").agg(F.max_by("path", "at").alias("path"))


def reprocessed(photos: DataFrame, group: int, scores: DataFrame) -> DataFrame:
    """Photos with the group's best chosen anew by scores (asset_id, score): the first of the highest; without any score it stays."""
    own = photos.where(F.col("group_index") == group).join(scores.where("score IS NOT NULL"), "asset_id")
    best = own.agg(F.max_by("asset_id", F.struct("score", (-F.col("ordinal")).alias("o"))).alias("_best"))
    with_best = photos.crossJoin(F.broadcast(best))  # one row
    return with_best.withColumn("is_best", F.when((F.col("group_index") == group) & F.col("_best").isNotNull(), F.col("asset_id") == F.col("_best")).otherwise(F.col("is_best"))).drop("_best")


_P = "p AS (SELECT group_index, ordinal, asset_id, is_best FROM report)"


def _photos(spark, d) -> DataFrame:
    return report_rows(spark, d).select("group_index", "ordinal", "asset_id", "is_best")


@query("report_groups", ALL_GROUPS + """, m AS (SELECT g.group_index, g.ordinal, x.photo_id, x.score FROM groups g JOIN media x USING (ord))
    SELECT group_index, count(*) AS photo_count, first(photo_id ORDER BY score DESC, ordinal) AS best_photo, string_agg(photo_id, ',' ORDER BY ordinal) AS photos FROM m GROUP BY 1""")
def report_groups_query(spark, d):
    members = groups_of_media(spark, d).join(fixtures.media(spark, d).select("ord", "photo_id", "filename", "score"), "ord")
    nested = report_groups(members)
    return nested.select("group_index", "photo_count", F.col("best_photo.photo_id").alias("best_photo"), F.array_join(F.transform("photos", lambda p: p["photo_id"]), ",").alias("photos"))


@query("merge_groups", with_views("media") + f""", {REPORT}, {_P} SELECT CASE WHEN group_index IN (2, 5, 9) THEN 2 ELSE group_index END AS group_index,
    row_number() OVER (PARTITION BY CASE WHEN group_index IN (2, 5, 9) THEN 2 ELSE group_index END ORDER BY group_index, ordinal) AS ordinal, asset_id, is_best AND group_index NOT IN (5, 9) AS is_best FROM p""")
def merge_groups_query(spark, d):
    return merge_groups(_photos(spark, d), [5, 2, 9])


_ACTIONS = "acts AS (SELECT DISTINCT group_index, CASE WHEN group_index % 2 = 0 THEN 'tagged' ELSE 'album_created' END AS a FROM report UNION ALL SELECT DISTINCT group_index, 'best_favorited' FROM report WHERE group_index % 3 = 0)"


@query("merge_actions", with_views("media") + f", {REPORT}, {_ACTIONS} SELECT CASE WHEN group_index IN (2, 5, 9) THEN 2 ELSE group_index END AS group_index, string_agg(DISTINCT a, ',' ORDER BY a) AS actions FROM acts GROUP BY 1")
def merge_actions_query(spark, d):
    g = F.col("group_index")
    acts = actions_taken({"tagged": g % 2 == 0, "album_created": g % 2 != 0, "best_favorited": g % 3 == 0})
    rows = report_rows(spark, d).select("group_index").distinct().withColumn("actions", acts)
    return merge_actions(rows, [2, 5, 9]).select("group_index", F.array_join("actions", ",").alias("actions"))


@query("split_group", with_views("media") + f""", {REPORT}, {_P}, q AS (SELECT *, group_index = 4 AND ordinal IN (1, 3, 4) AS goes, max(group_index) OVER () + 1 AS new FROM p),
    r AS (SELECT CASE WHEN goes THEN new ELSE group_index END AS g, * FROM q)
    SELECT g AS group_index, row_number() OVER (PARTITION BY g ORDER BY ordinal) AS ordinal, asset_id,
        CASE WHEN goes OR g = 4 THEN row_number() OVER (PARTITION BY g ORDER BY ordinal) = 1 ELSE is_best END AS is_best FROM r""")
def split_group_query(spark, d):
    return split_group(_photos(spark, d), 4, F.col("ordinal").isin(1, 3, 4))


@query("set_best", with_views("media") + f", {REPORT}, {_P} SELECT group_index, ordinal, asset_id, CASE WHEN group_index = 3 THEN asset_id = 'p15' ELSE is_best END AS is_best FROM p")
def set_best_query(spark, d):
    return set_best(_photos(spark, d), 3, "p15")


@query("non_best", with_views("media") + f", {REPORT}, {_P} SELECT group_index, asset_id FROM p WHERE NOT is_best")
def non_best(spark, d):
    return _photos(spark, d).where("NOT is_best").select("group_index", "asset_id")


@query("bulk_counts", with_views("media") + f", {REPORT}, {_P} SELECT CASE group_index % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'trash' ELSE 'discard' END AS action, count(*) FILTER (NOT is_best) AS photos, count(DISTINCT group_index) AS groups FROM p GROUP BY 1")
def bulk_counts(spark, d):
    action = F.when(F.col("group_index") % 3 == 0, "archive").when(F.col("group_index") % 3 == 1, "trash").otherwise("discard")
    return _photos(spark, d).groupBy(action.alias("action")).agg(F.count_if(~F.col("is_best")).alias("photos"), F.count_distinct("group_index").alias("groups"))


@query("run_totals", with_views("media") + f", {REPORT} SELECT count(DISTINCT group_index) AS groups, count(*) AS photos FROM report")
def run_totals(spark, d):
    return report_rows(spark, d).agg(F.count_distinct("group_index").alias("groups"), F.count("*").alias("photos"))


@query("report_search", with_views("media") + f""", {REPORT}, t AS (SELECT group_index, lower(concat_ws(' ', max(person), string_agg(filename, ' ' ORDER BY ordinal))) AS t FROM report GROUP BY 1)
    SELECT group_index FROM t WHERE contains(t, 'img_3') AND contains(t, 'person')""")
def report_search(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "filename"))), lambda x: x["filename"])
    text = report_rows(spark, d).groupBy("group_index").agg(F.lower(F.concat_ws(" ", F.max("person"), names)).alias("t"))
    return text.where(F.contains("t", F.lit("img_3")) & F.contains("t", F.lit("person"))).select("group_index")


@query("actions_taken", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'tagged' END, CASE WHEN c_custkey % 3 = 0 THEN 'album_created' END, CASE WHEN c_acctbal > 0 THEN 'best_favorited' END], lambda x: x IS NOT NULL), ',') AS actions FROM customer")
def actions_taken_query(spark, d):
    k = F.col("c_custkey")
    taken = actions_taken({"tagged": k % 2 == 0, "album_created": k % 3 == 0, "best_favorited": F.col("c_acctbal") > 0})
    return fixtures.table(spark, d, "customer").select("c_custkey", F.array_join(taken, ",").alias("actions"))


@query("meta_select", """WITH m AS (SELECT event_id, unnest(['exif_n', 'dimensions', 'filesize', 'other']) AS k, unnest([json_extract_string(props, '$.k'), CASE WHEN event_id % 2 = 0 THEN '1x1' ELSE 'None' END, '' || (event_id % 3), 'x']) AS v FROM events)
    SELECT event_id, string_agg(k || '=' || v, ',' ORDER BY k) AS kept FROM m WHERE k <> 'other' AND v IS NOT NULL AND v NOT IN ('', 'None', '0') GROUP BY event_id""")
def meta_select(spark, d):
    k = F.col("event_id")
    meta = F.create_map(F.lit("exif_n"), F.get_json_object("props", "$.k"), F.lit("dimensions"), F.when(k % 2 == 0, "1x1").otherwise("None"), F.lit("filesize"), (k % 3).cast("string"), F.lit("other"), F.lit("x"))
    kept = select_metadata(meta)
    entries = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return fixtures.table(spark, d, "events").select("event_id", kept.alias("m"), F.array_join(entries, ",").alias("kept")).where(F.size("m") > 0).select("event_id", "kept")


@query("meta_columns", "SELECT DISTINCT k AS name, CASE WHEN starts_with(k, 'exif_') THEN 0 ELSE 1 END AS rank FROM (SELECT unnest(['exif_n', 'dimensions', CASE WHEN event_id % 2 = 0 THEN 'filesize' END]) AS k FROM events) WHERE k IS NOT NULL")
def meta_columns(spark, d):
    """Names of the metadata that any row has, those from EXIF first."""
    names = F.array(F.lit("exif_n"), F.lit("dimensions"), F.when(F.col("event_id") % 2 == 0, "filesize"))
    found = fixtures.table(spark, d, "events").select(F.explode(names).alias("name")).where("name IS NOT NULL").distinct()
    return found.select("name", F.when(F.startswith("name", F.lit("exif_")), 0).otherwise(1).alias("rank")).orderBy("rank", "name")


#: Three reports of the fixture's groups, by the rest of their number; paths are of one kind, of the other, or of neither.
_REPORTS = """x AS (SELECT *, 'report_2024010' || (group_index % 3 + 1) AS report, CASE WHEN ordinal % 3 = 1 THEN '/a/' || filename WHEN ordinal % 3 = 0 THEN '' END AS filepath, CASE WHEN ordinal % 2 = 0 THEN '/b/' || filename END AS local_path FROM report)"""


def _saved(spark, d) -> str:
    folder = new_path(spark, "reports")
    k = F.col("ordinal")
    path, other = F.when(k % 3 == 1, F.concat(F.lit("/a/"), "filename")).when(k % 3 == 0, ""), F.when(k % 2 == 0, F.concat(F.lit("/b/"), "filename"))
    rows = report_rows(spark, d).select("group_index", F.struct("ordinal", "asset_id", "filename", path.alias("filepath"), other.alias("local_path")).alias("photo"))
    groups = rows.groupBy("group_index").agg(F.count("*").alias("photo_count"), F.array_sort(F.collect_list("photo")).alias("photos"))
    for i in range(3):
        save_report(groups.where(F.col("group_index") % 3 == i), folder, f"2024010{i + 1}", {"source_type": "server", "threshold": str(5 + i)}, f"2024-01-0{i + 1}T00:00:00")
    return folder


def _reports(spark, d) -> DataFrame:
    return read_reports(spark, _saved(spark, d))


@query("report_latest", with_views("media") + f", {REPORT} SELECT 'report_20240103' AS report, group_index, count(*) AS photo_count FROM report WHERE group_index % 3 = 2 GROUP BY group_index")
def report_latest(spark, d):
    """The groups of the report that was saved last."""
    return latest_report(spark, _saved(spark, d)).select("report", "group_index", "photo_count")


@query("report_list", with_views("media") + f""", {REPORT}, {_REPORTS} SELECT report, '2024-01-0' || right(report, 1) || 'T00:00:00' AS generated_at, count(DISTINCT group_index) AS total_groups, count(*) AS total_photos,
    'server' AS source_type, '' || (4 + right(report, 1)::INT) AS threshold, NULL::VARCHAR AS "limit", NULL::VARCHAR AS error FROM x GROUP BY report""")
def report_list(spark, d):
    return list_reports(_reports(spark, d))


@query("report_paths", with_views("media") + f", {REPORT}, {_REPORTS} SELECT asset_id, coalesce(nullif(filepath, ''), nullif(local_path, '')) AS path FROM x WHERE coalesce(nullif(filepath, ''), nullif(local_path, '')) IS NOT NULL")
def report_paths_query(spark, d):
    return report_paths(_reports(spark, d))


@query("reprocess_group", with_views("media") + f""", {REPORT}, {_P}, s AS (SELECT 'p' || vec_id AS asset_id, CASE WHEN vec_id % 4 <> 1 THEN vec_id * 7 % 5 END AS score FROM embeddings),
    b AS (SELECT asset_id FROM p JOIN s USING (asset_id) WHERE group_index = 6 AND score IS NOT NULL ORDER BY score DESC, ordinal LIMIT 1)
    SELECT group_index, ordinal, asset_id, CASE WHEN group_index = 6 THEN asset_id = (SELECT asset_id FROM b) ELSE is_best END AS is_best FROM p""")
def reprocess_group(spark, d):
    v = F.col("vec_id")
    scores = fixtures.table(spark, d, "embeddings").select(F.concat(F.lit("p"), v).alias("asset_id"), F.when(v % 4 != 1, v * 7 % 5).alias("score"))
    return reprocessed(_photos(spark, d), 6, scores)
