"""Which strategy groups a library: one entry for all, with a fixed precedence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.config import GroupingConfig
from prismlake.fixtures import with_views
from prismlake.operators.grouping import combination_cap, groups_by_key, people_sets
from prismlake.operators.similarity import ALL_GROUPS, WIDE, near_groups
from prismlake.registry import query

#: The first that is asked for is taken; without any, similar assets are grouped over the whole library.
PRECEDENCE = ("native_duplicates", "server_duplicates", "combinations", "person", "similar")


@dataclass(frozen=True)
class Request:
    """What a run is asked for: strategies, by name, and the settings of those that compare assets."""

    wanted: frozenset[str] = frozenset()
    config: GroupingConfig = field(default_factory=GroupingConfig)
    limit: int | None = None


def strategy(wanted: frozenset[str] | set[str]) -> str:
    unknown = set(wanted) - set(PRECEDENCE)
    if unknown:
        raise ValueError(f"no strategy {sorted(unknown)}")
    return next((s for s in PRECEDENCE if s in wanted), PRECEDENCE[-1])


def by_duplicate_key(media: DataFrame, key: str, least: int) -> DataFrame:
    """(name, ord) of assets whose key so many share; a null key is none."""
    some = media.where(F.col(key).isNotNull()).select(F.col(key).alias("name"), "ord")
    sizes = some.groupBy("name").agg(F.count("*").alias("_n")).where(F.col("_n") >= max(least, 2)).select("name")
    return some.join(sizes, "name")


def organize(media: DataFrame, request: Request, bridge: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """(strategy, name, leader, ord): the members of groups, by the strategy that comes first among those asked for.

    media has the columns that strategies look at: `duplicate_group`, `duplicate_id`, and hashes and times. bridge (person_id,
    asset_id) and people (person_id, name) say who is on which asset, whose id is its ord. name is the duplicate's key, the
    person or the combination's people; null where the whole library is compared.
    """
    chosen, config = strategy(request.wanted), request.config
    if chosen in ("native_duplicates", "server_duplicates"):
        members = by_duplicate_key(media, "duplicate_group" if chosen == "native_duplicates" else "duplicate_id", config.least)
        found = members.join(members.groupBy("name").agg(F.min("ord").alias("leader")), "name")
    elif chosen == "similar":
        found = near_groups(media, config).withColumn("name", F.lit(None).cast("string"))
    else:
        if bridge is None or people is None:
            raise ValueError(f"{chosen} needs to know who is on which asset")
        if chosen == "person":
            keyed = bridge.join(people.select("person_id", "name"), "person_id").select("name", F.col("asset_id").alias("ord")).distinct()
        else:
            sets = people_sets(bridge, people, config.least, combination_cap(request.limit))
            keyed = sets.select(F.array_join("names", ", ").alias("name"), F.col("asset_id").alias("ord"))
        found = groups_by_key(media.join(keyed, "ord"), "name", config)
    return found.select(F.lit(chosen).alias("strategy"), "name", "leader", "ord")


_REQUESTS = [{"similar"}, set(), {"person", "similar"}, {"server_duplicates", "person", "combinations"}, set(PRECEDENCE)]
_MEDIA = """lib AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 'n' || (ord // 9) END AS duplicate_group, 's' || (ord // 4) AS duplicate_id FROM media)"""


@query(
    "strategy_dispatch",
    f"""WITH h AS ({ALL_GROUPS} SELECT count(*) AS members, count(DISTINCT leader) AS groups FROM groups), m AS ({with_views('media')}, {_MEDIA} SELECT * FROM lib),
    n AS (SELECT duplicate_group AS k, count(*) AS c FROM m WHERE duplicate_group IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), s AS (SELECT duplicate_id AS k, count(*) AS c FROM m GROUP BY 1 HAVING count(*) >= 3)
    SELECT 0 AS request, 'similar' AS strategy, members, groups FROM h UNION ALL SELECT 1, 'similar', members, groups FROM h
    UNION ALL SELECT 3, 'server_duplicates', sum(c)::BIGINT, count(*) FROM s UNION ALL SELECT 4, 'native_duplicates', sum(c)::BIGINT, count(*) FROM n""",
)
def strategy_dispatch(spark, d):
    """Members and groups that requests of several strategies give; what person gives is in groups_by_person."""
    o = F.col("ord")
    media = fixtures.media(spark, d).withColumn("duplicate_group", F.when(o % 3 == 0, F.concat(F.lit("n"), F.floor(o / 9)))).withColumn("duplicate_id", F.concat(F.lit("s"), F.floor(o / 4)))
    parts = []
    for i, wanted in enumerate(_REQUESTS):
        if strategy(wanted) != "person":
            found = organize(media, Request(frozenset(wanted), WIDE)).groupBy("strategy").agg(F.count("*").alias("members"), F.count_distinct("leader").alias("groups"))
            parts.append(found.select(F.lit(i).alias("request"), "strategy", "members", "groups"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
