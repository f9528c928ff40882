"""Grouping strategies: by person, by combination of people, and by duplicate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.config import GroupingConfig
from prismlake.fixtures import with_views
from prismlake.operators.similarity import MICROS, WIDE, leader_sql, near_groups
from prismlake.ordering import in_order
from prismlake.registry import query
from prismlake.storage import kept

#: Assets of one combination are few, so their groups are made with a threshold that some pass.
LOOSE = GroupingConfig(threshold=28, window_s=0, min_size=2)


#: Assets of a combination: at least the group's least size, and at most this many.
def combination_cap(limit: int | None = None) -> int:
    return max(50, (limit or 50) * 3)


def groups_by_key(rows: DataFrame, key: str, config=WIDE) -> DataFrame:
    """(key, leader, ord, ordinal, size): greedy groups among rows of equal key; an asset may be in groups of several keys."""
    placed = kept(in_order(rows, [F.col(key), F.col("ord")], {"_place": F.lit(1)}, rows.count()), "keyed")
    found = near_groups(placed.drop("ord").withColumnRenamed("_place", "ord"), config, key)
    of = lambda name: placed.select(F.col("_place").alias(name), F.col("ord").alias(f"_{name}"), *([key] if name == "ord" else []))
    named = found.join(of("ord"), "ord").join(of("leader"), "leader")
    return named.select(key, F.col("_leader").alias("leader"), F.col("_ord").alias("ord"), "ordinal", "size")


def people_sets(bridge: DataFrame, people: DataFrame, least: int, cap: int) -> DataFrame:
    """(asset_id, names): each asset's set of people, where as many assets as least to cap have the same set."""
    by_asset = bridge.join(people.select("person_id", "name"), "person_id").groupBy("asset_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    counts = by_asset.groupBy("names").agg(F.count("*").alias("n")).where(F.col("n").between(max(least, 2), cap))
    return by_asset.join(counts, "names")


def combination_label(names):
    return F.when(F.size(names) > 5, F.concat(F.size(names), F.lit(" people"))).otherwise(F.array_join(names, ", "))


def duplicate_sizes(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, n): sizes of duplicate groups of at least so many; the row of a null key counts the singletons."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= max(least, 2)) | F.col(key).isNull())


def _person_rows(spark, d):
    media = fixtures.media(spark, d)
    return media.union(media.where("ord % 3 = 0").withColumn("person", F.lit("everyone")))


_PERSON = "pm AS (SELECT * FROM media UNION ALL SELECT * REPLACE ('everyone' AS person) FROM media WHERE ord % 3 = 0)"


def keyed_sql(rows: str, key: str, config=WIDE) -> str:
    """CTEs up to `found`: greedy groups among rows of equal key, whose places are numbered by key and order."""
    return f"""
kr AS (SELECT r.* REPLACE (row_number() OVER (ORDER BY {key}, ord) AS ord), r.ord AS old FROM {rows} r),
kp AS (
    SELECT a.ord AS i, b.ord AS j FROM kr a JOIN kr b ON a.ord < b.ord AND a.{key} = b.{key}
    WHERE bit_count(xor(a.hash_hi, b.hash_hi))::INT + bit_count(xor(a.hash_lo, b.hash_lo))::INT <= {config.threshold} AND {f'coalesce(abs(a.taken_us - b.taken_us) <= {config.window_s * MICROS}, true)' if config.window_s else 'true'}
),
kn AS (SELECT ord, row_number() OVER (ORDER BY ord) AS rn FROM kr),
{leader_sql('kn', 'kp', config.least)},
found AS (SELECT kr.{key}, lr.old AS leader, kr.old AS ord, g.ordinal, g.size FROM groups g JOIN kr USING (ord) JOIN kr lr ON lr.ord = g.leader)"""


@query("groups_by_person", with_views("media").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_PERSON}, {keyed_sql('pm', 'person')} SELECT * FROM found")
def groups_by_person(spark, d):
    return groups_by_key(_person_rows(spark, d), "person")


_SETS = f"""
fav AS (SELECT * FROM people WHERE is_favorite AND name <> ''),
sets AS (SELECT asset_id, list_sort(list(DISTINCT name)) AS names FROM person_asset JOIN fav USING (person_id) GROUP BY asset_id),
combos AS (SELECT names, count(*) AS n FROM sets GROUP BY names HAVING count(*) BETWEEN 2 AND {combination_cap()}),
labelled AS (SELECT *, CASE WHEN len(names) > 5 THEN len(names) || ' people' ELSE array_to_string(names, ', ') END AS label FROM combos)"""


@query("people_combos", with_views("people", "person_asset") + f", {_SETS} SELECT label, n FROM labelled")
def people_combos(spark, d):
    favourites = fixtures.people(spark, d).where("is_favorite AND name <> ''")
    sets = people_sets(fixtures.person_asset(spark, d), favourites, 2, combination_cap())
    return sets.groupBy("names").agg(F.count("*").alias("n")).select(combination_label(F.col("names")).alias("label"), "n")


@query(
    "groups_by_combo",
    with_views("media", "people", "person_asset").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {_SETS}, cl AS (SELECT names, asset_id FROM combos JOIN sets USING (names)),
    cm AS (SELECT names, m.* REPLACE (asset_id AS ord) FROM cl JOIN media m ON m.ord = asset_id % (SELECT count(*) FROM media)), {keyed_sql('cm', 'names', LOOSE)}
    SELECT label, leader, ord, ordinal, size FROM found JOIN labelled USING (names)""",
)
def groups_by_combo(spark, d):
    """Every asset of every combination, each with the features of a media row; combinations are sets of people, not their labels."""
    favourites = fixtures.people(spark, d).where("is_favorite AND name <> ''")
    sets = people_sets(fixtures.person_asset(spark, d), favourites, 2, combination_cap())
    n = fixtures.table(spark, d, "embeddings").count()
    placed = sets.select("names", "asset_id", (F.col("asset_id") % n).alias("ord"))
    rows = fixtures.media(spark, d).join(placed, "ord").withColumn("ord", F.col("asset_id")).drop("asset_id")
    return groups_by_key(rows, "names", LOOSE).withColumn("label", combination_label(F.col("names"))).drop("names")


@query(
    "server_dups",
    """WITH g AS (SELECT md5(text) AS duplicate_id, doc_id, doc_id % 5 <> 0 AS image FROM documents),
    big AS (SELECT duplicate_id FROM g GROUP BY duplicate_id HAVING count(*) >= 2)
    SELECT duplicate_id, count(*) AS n, min(doc_id) AS first_id FROM g JOIN big USING (duplicate_id) WHERE image GROUP BY duplicate_id HAVING count(*) >= 2""",
)
def server_dups(spark, d):
    rows = fixtures.table(spark, d, "documents").select(F.md5("text").alias("duplicate_id"), "doc_id", (F.col("doc_id") % 5 != 0).alias("image"))
    images = F.count_if("image").alias("n")
    found = rows.groupBy("duplicate_id").agg(F.count("*").alias("all"), images, F.min(F.when(F.col("image"), F.col("doc_id"))).alias("first_id"))
    return found.where("`all` >= 2 AND n >= 2").select("duplicate_id", "n", "first_id")


@query("native_dups", with_views("native_dup") + "SELECT duplicate_group, count(*) AS n FROM native_dup GROUP BY 1 HAVING count(*) >= 2 OR duplicate_group IS NULL")
def native_dups(spark, d):
    return duplicate_sizes(fixtures.native_dup(spark, d), "duplicate_group")
