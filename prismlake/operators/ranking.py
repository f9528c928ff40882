"""Best member of a group, by one criterion or another; the first of equals wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.functions.media import exposure, l2, pixels, size_number
from prismlake.operators.similarity import ALL_GROUPS, groups_of_media
from prismlake.ordering import dealt_pairs
from prismlake.registry import query


def first_of(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_at = 1").drop("_at")


def face_score(smiles: Column, eyes: Column) -> Column:
    return smiles + 2 * F.least(eyes, F.lit(2))


@query("best_of_groups", ALL_GROUPS + """SELECT group_index, size, photo_id AS best_photo FROM groups g JOIN media m USING (ord)
    QUALIFY row_number() OVER (PARTITION BY group_index ORDER BY score DESC, ord) = 1""")
def best_of_groups(spark, d):
    rows = groups_of_media(spark, d).join(fixtures.media(spark, d).select("ord", "photo_id", "score"), "ord")
    return first_of(rows, "group_index", F.col("score").desc(), F.col("ord")).select("group_index", "size", F.col("photo_id").alias("best_photo"))


_BY_PHOTO = """all_photos AS (SELECT DISTINCT l_orderkey AS asset_id, l_orderkey // 32 AS group_index FROM lineitem),
scored AS (
    SELECT p.asset_id, p.group_index, coalesce(avg(smiles + 2 * least(eyes, 2)), 0) AS score, sum(abs(rgt - lft) * abs(bottom - top))::BIGINT AS area
    FROM all_photos p LEFT JOIN faces f ON f.asset_id = p.asset_id GROUP BY ALL
)"""


def scored_photos(spark, d) -> DataFrame:
    """Each photo with the mean score of its faces, 0 without any, and their total area, null without any."""
    photos = fixtures.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id")).distinct()
    area = F.sum(F.abs(F.col("rgt") - F.col("lft")) * F.abs(F.col("bottom") - F.col("top")))
    by = fixtures.faces(spark, d).groupBy("asset_id").agg(F.avg(face_score(F.col("smiles"), F.col("eyes"))).alias("score"), area.alias("area"))
    return photos.join(by, "asset_id", "left").select("asset_id", F.floor(F.col("asset_id") / 32).cast("long").alias("group_index"), F.coalesce("score", F.lit(0.0)).alias("score"), "area")


@query("face_score", with_views("faces") + "SELECT asset_id, smiles + 2 * least(eyes, 2) AS score, count(*) AS n FROM faces GROUP BY ALL")
def face_scores(spark, d):
    return fixtures.faces(spark, d).groupBy("asset_id", face_score(F.col("smiles"), F.col("eyes")).alias("score")).agg(F.count("*").alias("n"))


@query("best_by_face", with_views("faces") + f""", {_BY_PHOTO} SELECT group_index, asset_id, round(score, 6) AS score FROM scored
    QUALIFY row_number() OVER (PARTITION BY group_index ORDER BY score DESC, asset_id) = 1""")
def best_by_face(spark, d):
    return first_of(scored_photos(spark, d), "group_index", F.col("score").desc(), F.col("asset_id")).select("group_index", "asset_id", F.round("score", 6).alias("score"))


def by_area(area: Column, score: Column) -> list[Column]:
    """Order of a group's photos by the area of their faces, null for those without one, which go by their score."""
    return [area.desc_nulls_last(), F.when(area.isNull(), score).desc_nulls_last()]


@query("best_by_area", with_views("faces") + f""", {_BY_PHOTO} SELECT group_index, asset_id, area FROM scored
    QUALIFY row_number() OVER (PARTITION BY group_index ORDER BY area DESC NULLS LAST, CASE WHEN area IS NULL THEN score END DESC NULLS LAST, asset_id) = 1""")
def best_by_area(spark, d):
    """Photos without faces come last, the first of equal areas wins; only a group without any face falls back on scores."""
    return first_of(scored_photos(spark, d), "group_index", *by_area(F.col("area"), F.col("score")), F.col("asset_id")).select("group_index", "asset_id", "area")


@query("quality_gate", with_views("media") + "SELECT ord, CASE WHEN ord % 4 = 0 THEN NULL ELSE score * 10 END AS brisque FROM media WHERE coalesce(CASE WHEN ord % 4 = 0 THEN NULL ELSE score * 10 END, 0) <= 50")
def quality_gate(spark, d):
    rows = fixtures.media(spark, d).select("ord", F.when(F.col("ord") % 4 != 0, F.col("score") * 10).alias("brisque"))
    return rows.where(F.coalesce("brisque", F.lit(0)) <= 50)


_EXPOSURE = """CASE len(string_split({c}, '/')) WHEN 2 THEN try_cast(string_split({c}, '/')[1] AS DOUBLE) / nullif(try_cast(string_split({c}, '/')[2] AS DOUBLE), 0)
    WHEN 1 THEN try_cast({c} AS DOUBLE) END"""
_SHUTTER = "coalesce(nullif(exposure, ''), exposure2)"


@query("exposure_value", with_views("exif") + f"SELECT asset_id, round({_EXPOSURE.format(c=_SHUTTER)}, 9) AS seconds FROM exif")
def exposure_value(spark, d):
    text = F.coalesce(F.nullif("exposure", F.lit("")), "exposure2")
    return fixtures.exif(spark, d).select("asset_id", F.round(exposure(text), 9).alias("seconds"))


@query("hdr_brackets", with_views("exif") + f""", e AS (SELECT group_index, {_EXPOSURE.format(c=_SHUTTER)} AS s FROM exif)
    SELECT group_index, count(s) AS n, count(DISTINCT s) AS n_distinct FROM e GROUP BY 1 HAVING count(s) >= 2 AND count(DISTINCT s) > 1""")
def hdr_brackets(spark, d):
    text = F.coalesce(F.nullif("exposure", F.lit("")), "exposure2")
    rows = fixtures.exif(spark, d).select("group_index", exposure(text).alias("s"))
    return rows.groupBy("group_index").agg(F.count("s").alias("n"), F.count_distinct("s").alias("n_distinct")).where("n >= 2 AND n_distinct > 1")


@query("closed_eyes", with_views("face_encoding") + "SELECT face_id, round((left_ear + right_ear) / 2, 6) AS ear FROM face_encoding WHERE (left_ear + right_ear) / 2 < 0.2")
def closed_eyes(spark, d):
    ear = (F.col("left_ear") + F.col("right_ear")) / 2
    return fixtures.face_encoding(spark, d).where(ear < 0.2).select("face_id", F.round(ear, 6).alias("ear"))


#: Closed eyes of a group that one task looks at.
FACES = 5_000


def best_replacement(faces: DataFrame, same: float, least_ear: float = 0.2) -> DataFrame:
    """For each face that looks closed the open face of the same person in another photo of its group with the best score.

    The closed faces of a group with over FACES of them are dealt over several tasks.
    """
    look = (F.col("left_ear") + F.col("right_ear")) / 2
    face = F.struct("face_id", "asset_id", "enc", "left_ear", "right_ear")
    closed, open_ = faces.where(look < least_ear).select("group_index", face.alias("a")), faces.where(look > least_ear).select("group_index", face.alias("b"))
    closed, open_, keys = dealt_pairs(closed, open_, ["group_index"], FACES, ["a.face_id"])
    pairs = closed.join(open_, keys).where(F.col("a.asset_id") != F.col("b.asset_id"))
    ear = (F.col("b.left_ear") + F.col("b.right_ear")) / 2
    pairs = pairs.select(F.col("a.face_id").alias("face_id"), F.col("b.face_id").alias("replacement"), l2(F.col("a.enc"), F.col("b.enc")).alias("distance"), ear.alias("ear"))
    open_ = pairs.where(F.col("distance") < same).withColumn("score", F.col("ear") * (1 - F.col("distance")))
    return first_of(open_.where("score > -1"), "face_id", F.round("score", 9).desc(), F.col("replacement"))


#: Encodings of the fixture are unit vectors whose nearest pairs are about this far apart.
SAME = 1.35
_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.enc[i]::DOUBLE - b.enc[i]::DOUBLE, 2))))"


@query("best_replacement_face", with_views("face_encoding") + f""", p AS (
    SELECT a.face_id, b.face_id AS replacement, {_DIST} AS distance, (b.left_ear + b.right_ear) / 2 AS ear FROM face_encoding a JOIN face_encoding b
        ON a.group_index = b.group_index AND a.asset_id <> b.asset_id WHERE (a.left_ear + a.right_ear) / 2 < 0.2)
    SELECT face_id, replacement, round(ear * (1 - distance), 6) AS score FROM p WHERE distance < {SAME} AND ear > 0.2 AND ear * (1 - distance) > -1
    QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY round(ear * (1 - distance), 9) DESC, replacement) = 1""")
def best_replacement_face(spark, d):
    return best_replacement(fixtures.face_encoding(spark, d), SAME).select("face_id", "replacement", F.round("score", 6).alias("score"))


#: A report's rows: six assets a group, texts as a report has them, some malformed or missing.
REPORT = """report AS (
    SELECT ord // 6 + 1 AS group_index, ord % 6 + 1 AS ordinal, photo_id AS asset_id, filename, ord % 6 = 0 AS is_best, CASE WHEN (ord // 6) % 4 <> 0 THEN person END AS person, score,
        CASE ord % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '1,' || filesize ELSE '' || filesize END AS filesize,
        CASE ord % 8 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '1x2x3' ELSE dimensions END AS dimensions,
        CASE WHEN ord % 3 <> 0 THEN '2023:0' || (ord % 9 + 1) || ':1' || (ord % 7) END AS taken
    FROM media)"""


def report_rows(spark, d) -> DataFrame:
    o = F.col("ord")
    first = F.floor(o / 6).cast("long")
    return fixtures.media(spark, d).select(
        (first + 1).alias("group_index"), (o % 6 + 1).alias("ordinal"), F.col("photo_id").alias("asset_id"), "filename", (o % 6 == 0).alias("is_best"), F.when(first % 4 != 0, F.col("person")).alias("person"), "score",
        F.when(o % 7 == 1, "n/a").when(o % 7 == 2, F.concat(F.lit("1,"), "filesize")).when(o % 7 != 0, F.col("filesize").cast("string")).alias("filesize"),
        F.when(o % 8 == 0, "x").when(o % 8 == 2, "1x2x3").when(o % 8 != 1, F.col("dimensions")).alias("dimensions"),
        F.when(o % 3 != 0, F.concat(F.lit("2023:0"), o % 9 + 1, F.lit(":1"), o % 7)).alias("taken"),
    )


def repick(report: DataFrame, criterion: str) -> DataFrame:
    """Each group's best by filesize, dimensions, date_oldest, date_newest or score; groups of one are left out."""
    rows = report.withColumn("_n", F.count("*").over(Window.partitionBy("group_index"))).where("_n > 1").drop("_n")
    order = {
        "filesize": size_number(F.coalesce("filesize", F.lit("0"))).desc(),
        "dimensions": pixels(F.coalesce("dimensions", F.lit("0x0"))).desc(),
        "date_oldest": F.coalesce("taken", F.lit("9999")).asc(),
        "date_newest": F.coalesce("taken", F.lit("")).desc(),
        "score": F.col("score").desc_nulls_last(),
    }[criterion]
    return first_of(rows, "group_index", order, F.col("ordinal")).select("group_index", "asset_id", "filename")


_PIXELS = "CASE WHEN len(string_split(dimensions, 'x')) = 2 THEN coalesce(try_cast(string_split(dimensions, 'x')[1] AS BIGINT) * try_cast(string_split(dimensions, 'x')[2] AS BIGINT), 0) ELSE 0 END"
_ORDERS = {
    "filesize": "coalesce(try_cast(replace(filesize, ',', '') AS DOUBLE), 0) DESC", "dimensions": f"coalesce({_PIXELS}, 0) DESC",
    "date_oldest": "coalesce(taken, '9999')", "date_newest": "coalesce(taken, '') DESC", "score": "score DESC NULLS LAST",
}


def _repick_query(criterion: str):
    sql = with_views("media") + f""", {REPORT} SELECT group_index, asset_id, filename FROM report
        QUALIFY count(*) OVER (PARTITION BY group_index) > 1 AND row_number() OVER (PARTITION BY group_index ORDER BY {_ORDERS[criterion]}, ordinal) = 1"""
    query(f"repick_{criterion}", sql)(lambda spark, d: repick(report_rows(spark, d), criterion))


for _criterion in _ORDERS:
    _repick_query(_criterion)
