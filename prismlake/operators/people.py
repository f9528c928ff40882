"""People: filters, merged counts, and who names an album."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.functions.media import album_part
from prismlake.operators.ranking import REPORT, first_of, report_rows
from prismlake.registry import query
from prismlake.storage import kept

WANTED, EXCLUDED = ["SUPPLIER#000000003", "supplier#000000007"], ["SUPPLIER#000000001", "supplier#000000004"]


def _compose(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in names:
        yield batch.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(name: Column) -> Column:
    """Unicode's composed form; Spark has no such function."""
    return F.pandas_udf(_compose, "string")(name)


def named(people: DataFrame, wanted: list[str]) -> DataFrame:
    """People whose name is among the wanted ones, in either case."""
    return people.where(F.lower("name").isin([w.lower() for w in wanted]))


def without(people: DataFrame, excluded: list[str]) -> DataFrame:
    """Named people, but for the excluded ones, in either case."""
    return people.where((F.col("name") != "") & ~F.lower("name").isin([w.lower() for w in excluded]))


def merged(people: DataFrame, compose: bool = True) -> DataFrame:
    """(name, photo_count, is_favorite, key_photo) of (name, photo_count, is_favorite, key_photo, ord); names are trimmed and composed, none without photos."""
    name = F.trim("name")
    by = people.withColumn("name", composed(name) if compose else name).groupBy("name")
    found = by.agg(F.sum("photo_count").alias("photo_count"), F.bool_or("is_favorite").alias("is_favorite"), F.min_by("key_photo", F.when(F.col("key_photo").isNotNull(), F.col("ord"))).alias("key_photo"))
    return found.where("photo_count > 0")


def parse_names(lines: DataFrame) -> DataFrame:
    """(name) from (value): what stands before a #, trimmed and in lower case, once each."""
    return lines.select(F.lower(F.trim(F.split_part("value", F.lit("#"), F.lit(1)))).alias("name")).where("name <> ''").distinct()


def _names(key: str, names: list[str]) -> str:
    return f"lower({key}) IN ({', '.join(repr(n.lower()) for n in names)})"


@query("people_filter", with_views("people") + f"SELECT person_id, name FROM people WHERE {_names('name', WANTED)}")
def people_filter(spark, d):
    return named(fixtures.people(spark, d), WANTED).select("person_id", "name")


@query("people_excluded", with_views("people") + f"SELECT person_id, name FROM people WHERE name <> '' AND NOT ({_names('name', EXCLUDED)})")
def people_excluded(spark, d):
    return without(fixtures.people(spark, d), EXCLUDED).select("person_id", "name")


@query("people_list", with_views("people") + "SELECT person_id, name FROM people WHERE NOT hidden")
def people_list(spark, d):
    return fixtures.people(spark, d).where("NOT hidden").select("person_id", "name")


@query("photos_by_person", with_views("people", "person_asset") + "SELECT name, count(*) AS n, min(asset_id) AS first_asset FROM people JOIN person_asset USING (person_id) WHERE name <> '' GROUP BY name")
def photos_by_person(spark, d):
    rows = fixtures.people(spark, d).where("name <> ''").join(fixtures.person_asset(spark, d), "person_id")
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min("asset_id").alias("first_asset"))


_COUNTED = """counted AS (
    SELECT CASE c_custkey % 3 WHEN 0 THEN ' ' || c_mktsegment WHEN 1 THEN c_mktsegment || '  ' ELSE c_name END AS name, c_custkey % 4 AS photo_count, c_custkey % 50 = 0 AS is_favorite,
        CASE WHEN c_custkey % 7 = 0 THEN 'k' || c_custkey END AS key_photo, c_custkey AS ord FROM customer)"""


def _counted(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit(" "), "c_mktsegment")).when(k % 3 == 1, F.concat("c_mktsegment", F.lit("  "))).otherwise(F.col("c_name"))
    return fixtures.table(spark, d, "customer").select(name.alias("name"), (k % 4).alias("photo_count"), (k % 50 == 0).alias("is_favorite"), F.when(k % 7 == 0, F.concat(F.lit("k"), k)).alias("key_photo"), k.alias("ord"))


@query("people_merged", f"""WITH {_COUNTED} SELECT trim(name) AS name, sum(photo_count)::BIGINT AS photo_count, bool_or(is_favorite) AS is_favorite,
    arg_min(key_photo, ord) FILTER (key_photo IS NOT NULL) AS key_photo FROM counted GROUP BY 1 HAVING sum(photo_count) > 0""")
def people_merged(spark, d):
    from prismlake.shipping import ship

    ship(spark)
    return merged(_counted(spark, d))


@query("people_dedup", f"WITH {_COUNTED} SELECT trim(name) AS name, photo_count, ord FROM counted QUALIFY row_number() OVER (PARTITION BY trim(name) ORDER BY photo_count DESC, ord) = 1")
def people_dedup(spark, d):
    rows = _counted(spark, d).withColumn("name", F.trim("name"))
    return first_of(rows, "name", F.col("photo_count").desc(), F.col("ord")).select("name", "photo_count", "ord")


_REPORT_COUNTS = "totals AS (SELECT person, count(*) AS photos FROM report WHERE person IS NOT NULL GROUP BY person)"


@query("people_counts", with_views("media") + f""", {REPORT}, {_REPORT_COUNTS}, served AS (SELECT DISTINCT 'person' || (c_custkey % 15) AS name, c_custkey % 15 * 10 AS photo_count FROM customer)
    SELECT name, coalesce(photos, photo_count) AS photos FROM served LEFT JOIN totals ON name = person""")
def people_counts(spark, d):
    k = F.col("c_custkey") % 15
    served = fixtures.table(spark, d, "customer").select(F.concat(F.lit("person"), k).alias("name"), (k * 10).alias("photo_count")).distinct()
    totals = report_rows(spark, d).where("person IS NOT NULL").groupBy(F.col("person").alias("name")).agg(F.count("*").alias("photos"))
    return served.join(totals, "name", "left").select("name", F.coalesce("photos", "photo_count").alias("photos"))


#: Who is in a photo: a list of names from its metadata, some empty, and the name of the run that found it.
_PERSONS = """pics AS (
    SELECT ord // 6 + 1 AS group_index, ord, [CASE WHEN ord % 4 = 0 THEN '' ELSE person END, 'Zoé ' || (ord % 3), CASE WHEN ord % 5 = 0 THEN 'Hidden One' END] AS persons,
        CASE WHEN (ord // 6) % 4 <> 0 THEN 'person' || (ord // 6 % 10) END AS person_name, CASE WHEN ord % 2 = 0 AND ord // 6 % 3 = 0 THEN taken_us END AS taken_us,
        CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN '2022-03-1' || (ord % 9) || 'T10:00:00' END AS date, CASE WHEN ord % 5 = 0 THEN '2021-0' || (ord % 8 + 1) || '-02' END AS file_created_at FROM media),
seen AS (SELECT DISTINCT group_index, ord, name FROM (SELECT group_index, ord, unnest(list_append(persons, person_name)) AS name FROM pics) WHERE name <> ''),
freq AS (SELECT group_index, name, count(*) AS n FROM seen GROUP BY ALL)"""
FAVOURITES = ["Zoé 1", "person3"]
_FAVOURITE = "name IN ('Zoé 1', 'person3')"
_PEOPLE_OF_ALBUM = f"""top AS (SELECT group_index, name, n, row_number() OVER (PARTITION BY group_index ORDER BY NOT ({_FAVOURITE}), n DESC, lower(name), name) AS r FROM freq WHERE lower(name) <> 'hidden one' QUALIFY r <= 6)"""


def pictures(spark, d) -> DataFrame:
    o = F.col("ord")
    persons = F.array(F.when(o % 4 == 0, "").otherwise(F.col("person")), F.concat(F.lit("Zoé "), o % 3), F.when(o % 5 == 0, "Hidden One"))
    run = F.when(F.floor(o / 6) % 4 != 0, F.concat(F.lit("person"), F.floor(o / 6) % 10))
    taken = F.when((o % 2 == 0) & (F.floor(o / 6) % 3 == 0), F.col("taken_us"))
    date = F.when(o % 4 == 0, "").when(o % 4 == 1, F.concat(F.lit("2022-03-1"), o % 9, F.lit("T10:00:00")))
    created = F.when(o % 5 == 0, F.concat(F.lit("2021-0"), o % 8 + 1, F.lit("-02")))
    return fixtures.media(spark, d).select(
        (F.floor(o / 6) + 1).cast("long").alias("group_index"), "ord", persons.alias("persons"), run.alias("person_name"), taken.alias("taken_us"), date.alias("date"), created.alias("file_created_at")
    )


def people_of_groups(pictures: DataFrame) -> DataFrame:
    """(group_index, name, n): in how many of a group's photos each person is."""
    names = F.explode(F.array_union("persons", F.array("person_name"))).alias("name")
    return pictures.select("group_index", "ord", names).where("name <> ''").groupBy("group_index", "name").agg(F.count_distinct("ord").alias("n"))


def album_people(counts: DataFrame, favourites: list[str], excluded: list[str], most: int = 6) -> DataFrame:
    """The first people of each group's album, with their rank: favourites, then by count, then by name; excluded ones not."""
    order = [~F.col("name").isin(favourites), F.col("n").desc(), F.lower("name"), F.col("name")]
    rank = F.row_number().over(Window.partitionBy("group_index").orderBy(*order)).cast("long")
    return counts.where(~F.lower("name").isin([e.lower() for e in excluded])).withColumn("rank", rank).where(F.col("rank") <= most)


def label_people(counts: DataFrame, excluded: list[str]) -> DataFrame:
    """Three at most of the six most frequent, who may be fewer as excluded ones are taken from the six."""
    at = Window.partitionBy("group_index")
    six = counts.withColumn("_r", F.row_number().over(at.orderBy(F.col("n").desc(), F.col("name")))).where("_r <= 6")
    some = six.where(~F.lower("name").isin([e.lower() for e in excluded]))
    return some.withColumn("rank", F.row_number().over(at.orderBy("_r")).cast("long")).where("rank <= 3").drop("_r")


def album_name(day: Column, people: Column, index: Column, prefix: str = "Organized") -> Column:
    """prefix-day-A+B-0001; the number takes more digits where it has them."""
    names = F.when(F.size(people) > 0, F.array_join(F.transform(people, album_part), "+"))
    return F.concat_ws("-", F.lit(prefix), day, names, F.format_string("%04d", index))


@query("group_people", with_views("media") + f", {_PERSONS} SELECT * FROM freq")
def group_people(spark, d):
    return people_of_groups(pictures(spark, d))


@query("album_people", with_views("media") + f", {_PERSONS}, {_PEOPLE_OF_ALBUM} SELECT group_index, name, n, r AS rank FROM top")
def album_people_query(spark, d):
    return album_people(people_of_groups(pictures(spark, d)), FAVOURITES, ["hidden one"])


@query("label_people", with_views("media") + f""", {_PERSONS}, six AS (SELECT *, row_number() OVER (PARTITION BY group_index ORDER BY n DESC, name) AS r FROM freq QUALIFY r <= 6)
    SELECT group_index, name, n, row_number() OVER (PARTITION BY group_index ORDER BY r) AS rank FROM six WHERE lower(name) <> 'hidden one' QUALIFY rank <= 3""")
def label_people_query(spark, d):
    return label_people(people_of_groups(pictures(spark, d)), ["HIDDEN ONE"])


def group_days(pictures: DataFrame) -> DataFrame:
    """(group_index, day): that of the first photo with a capture time, else the first ten characters of the first date that metadata has, else unknown."""
    taken = F.min_by("taken_us", F.when(F.col("taken_us").isNotNull(), F.col("ord"))).alias("us")
    raw = F.coalesce(F.nullif("date", F.lit("")), F.nullif("file_created_at", F.lit("")))
    day = F.date_format(F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("us") / 1_000_000).cast("decimal(18,6)")), "yyyy-MM-dd")
    found = pictures.groupBy("group_index").agg(taken, F.min_by(raw, F.when(raw.isNotNull(), F.col("ord"))).alias("raw"))
    return found.select("group_index", F.coalesce(day, F.substring("raw", 1, 10), F.lit("unknown")).alias("day"))


def group_albums(pictures: DataFrame, favourites: list[str], excluded: list[str], prefix: str = "Organized") -> DataFrame:
    """(group_index, album): each group's album name."""
    top = album_people(people_of_groups(pictures), favourites, excluded)
    who = top.groupBy("group_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("who"))
    rows = group_days(pictures).join(who, "group_index", "left")
    return rows.select("group_index", album_name(F.col("day"), F.coalesce("who", F.array().cast("array<string>")), F.col("group_index"), prefix).alias("album"))


ALBUMS_SQL = f"""{_PERSONS}, {_PEOPLE_OF_ALBUM},
    days AS (SELECT group_index, coalesce(strftime(make_timestamp(arg_min(taken_us, ord) FILTER (taken_us IS NOT NULL)), '%Y-%m-%d'),
        arg_min(coalesce(nullif(date, ''), nullif(file_created_at, ''))[1:10], ord) FILTER (coalesce(nullif(date, ''), nullif(file_created_at, '')) IS NOT NULL), 'unknown') AS day FROM pics GROUP BY 1),
    parts AS (SELECT group_index, string_agg(trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}_ ]', '', 'g')), '+' ORDER BY r) AS who FROM top GROUP BY 1),
    named AS (SELECT group_index, 'Organized-' || day || coalesce('-' || who, '') || '-' || printf('%04d', group_index) AS album FROM days LEFT JOIN parts USING (group_index))"""


@query("album_names", with_views("media") + f", {ALBUMS_SQL} SELECT group_index, album FROM named")
def album_names(spark, d):
    return group_albums(kept(pictures(spark, d), "pictures"), FAVOURITES, ["hidden one"])


@query("parse_name_list", """WITH lines AS (SELECT CASE p_partkey % 4 WHEN 0 THEN '# ' || p_name WHEN 1 THEN ' ' || p_brand || ' # note' WHEN 2 THEN '' ELSE upper(p_brand) END AS value FROM part)
    SELECT DISTINCT lower(trim(string_split(value, '#')[1])) AS name FROM lines WHERE trim(string_split(value, '#')[1]) <> ''""")
def parse_name_list(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 4 == 0, F.concat(F.lit("# "), "p_name")).when(k % 4 == 1, F.concat(F.lit(" "), "p_brand", F.lit(" # note"))).when(k % 4 == 2, "").otherwise(F.upper("p_brand"))
    return parse_names(fixtures.table(spark, d, "part").select(value.alias("value")))
