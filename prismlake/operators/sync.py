"""Two-way state: what has changed on either side since the last snapshot, and who wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.registry import query
from prismlake.storage import exists, new_path

FIELDS = ["is_favorite", "is_archived"]


def changes(local: DataFrame, remote: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A row for each asset and field that has changed: old, local_new and remote_new (null: no change), and whether they differ.

    A new value that is null is no change. Assets that are missing on a side are left out.
    """
    sides = local.alias("l").join(remote.alias("r"), "asset_id").join(snapshot.alias("s"), "asset_id")
    return sides.select("asset_id", F.inline(field_changes("l", "r", "s")))


def field_changes(local: str, remote: str, snapshot: str) -> Column:
    """An array of a struct for each field that has changed, of three structs or tables: field, old, local_new, remote_new and conflict."""
    found = []
    for f in FIELDS:
        old = F.col(f"{snapshot}.{f}")
        mine, theirs = (F.when(~F.col(f"{side}.{f}").eqNullSafe(old), F.col(f"{side}.{f}")) for side in (local, remote))
        conflict = F.coalesce(mine != theirs, F.lit(False))
        found.append(F.struct(F.lit(f).alias("field"), old.alias("old"), mine.alias("local_new"), theirs.alias("remote_new"), conflict.alias("conflict")))
    return F.filter(F.array(*found), lambda x: x["local_new"].isNotNull() | x["remote_new"].isNotNull())


def resolve(changed: DataFrame, strategy: str) -> DataFrame:
    """(asset_id, field, action, value): 'pull' sets the local value, 'push' the remote one, 'queue' waits for a decision.

    An asset with a conflict in any field is decided as a whole, by 'remote_wins', 'local_wins' or 'manual'.
    """
    rows = changed.where("asset_id IS NOT NULL").withColumn("clash", F.max("conflict").over(Window.partitionBy("asset_id")))
    pull = F.col("remote_new").isNotNull() & (~F.col("clash") | F.lit(strategy == "remote_wins"))
    push = F.col("local_new").isNotNull() & (~F.col("clash") | F.lit(strategy == "local_wins"))
    queue = F.col("clash") & F.col("conflict") & F.lit(strategy == "manual")
    found = ((pull, "pull", F.col("remote_new")), (push, "push", F.col("local_new")), (queue, "queue", F.lit(None).cast("boolean")))
    acts = F.array(*(F.when(when, F.struct(F.lit(action).alias("action"), value.alias("value"))) for when, action, value in found))
    return rows.select("asset_id", "field", F.inline(F.filter(acts, lambda x: x.isNotNull())))


def new_snapshot(remote: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The remote state where there is one, else the old snapshot."""
    joined = snapshot.alias("s").join(remote.withColumn("_there", F.lit(True)).alias("r"), "asset_id", "full")
    return joined.select("asset_id", *(F.when(F.col("_there"), F.col(f"r.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in FIELDS))


def pending_pushes(local: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(asset_id, field, value) of all local values that differ from the snapshot's, or that it lacks; null is no value."""
    sides = local.alias("l").join(snapshot.alias("s"), "asset_id", "left")
    values = [F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").alias("value"), F.col(f"s.{f}").alias("old")) for f in FIELDS]
    return sides.select("asset_id", F.inline(F.array(*values))).where("value IS NOT NULL AND NOT (value <=> old)").drop("old")


def pushed(remote: DataFrame, pushes: DataFrame) -> DataFrame:
    """The remote state once pushes (asset_id, field, value) are applied; assets that it doesn't have are left out."""
    wide = pushes.groupBy("asset_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in FIELDS))
    return remote.join(wide, "asset_id", "left").select("asset_id", *(F.coalesce(f"_{f}", f).alias(f) for f in FIELDS))


def pulled(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The local state once the remote one is taken over, nulls as well; assets that only one side has stay or are added."""
    return new_snapshot(remote, local)


def tracked(remote: DataFrame, placed: DataFrame) -> DataFrame:
    """First records of assets (asset_id, is_best, group_index): state and snapshot are the remote's, which must have them."""
    own = remote.join(placed, "asset_id")
    return own.select("asset_id", *(F.col(f).alias(f"local_{f}") for f in FIELDS), *(F.col(f).alias(f"snapshot_{f}") for f in FIELDS), F.coalesce("is_best", F.lit(False)).alias("is_best"), "group_index")


def sync_status(records: DataFrame, conflicts: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row: tracked assets, assets that wait for a decision, cycles (finished_us, error) so far, when the last one ended, and its error."""
    of = cycles.agg(F.count("*").alias("cycles"), F.max("finished_us").alias("last_sync_us"), F.max_by("error", "finished_us").alias("last_error"))
    return records.agg(F.count("*").alias("tracked")).crossJoin(conflicts.agg(F.count_distinct("asset_id").alias("pending"))).crossJoin(of)  # three rows in all


def updated_state(state: DataFrame, completed: DataFrame, discovered: DataFrame, hashed: DataFrame) -> DataFrame:
    """A run's state (run_id, completed, discovered, hashed, groups) with what has been done since; a group that is completed twice counts once.

    completed (run_id, group_index), discovered and hashed (run_id). Adds percent, of groups that are completed; null without any.
    """
    done = completed.groupBy("run_id").agg(F.collect_set("group_index").alias("_done"))
    more = [df.groupBy("run_id").agg(F.count("*").alias(name)) for df, name in ((discovered, "_discovered"), (hashed, "_hashed"))]
    rows = state.join(done, "run_id", "left").join(more[0], "run_id", "left").join(more[1], "run_id", "left")
    united = F.array_sort(F.array_union("completed", F.coalesce("_done", F.array().cast("array<long>"))))
    new = rows.select("run_id", united.alias("completed"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("discovered", "hashed")), "groups")
    return new.withColumn("percent", F.when(F.col("groups") > 0, F.round(100.0 * F.size("completed") / F.col("groups"), 1)))


def compatible(runs: DataFrame, source: str, path: str, config) -> DataFrame:
    """runs (run_id, fingerprint) with `resumes`: whether such a run would take them up, which one of other settings must not."""
    from prismlake.sources.local import fingerprint

    return runs.withColumn("resumes", F.col("fingerprint").eqNullSafe(F.lit(fingerprint(source, path, config))))


def append_features(features: DataFrame, path: str, key: str = "photo_id") -> DataFrame:
    """Adds to the cache at path the rows whose key it doesn't have, and returns the whole cache.

    Only new rows are written, and only keys of the cache are read for that. A cache that isn't there yet begins with all rows.
    """
    spark = features.sparkSession
    there = exists(spark, path)
    new = features.join(spark.read.parquet(path).select(key), key, "left_anti") if there else features
    new.write.mode("append").parquet(path)
    return spark.read.schema(features.schema).parquet(path)


_CHANGES = " UNION ALL ".join(
    f"SELECT asset_id, '{f}' AS field, s.{f} AS old, CASE WHEN l.{f} IS DISTINCT FROM s.{f} THEN l.{f} END AS local_new, CASE WHEN r.{f} IS DISTINCT FROM s.{f} THEN r.{f} END AS remote_new "
    "FROM sync_local l JOIN sync_remote r USING (asset_id) JOIN sync_snapshot s USING (asset_id)" for f in FIELDS
)
_VIEWS = with_views("sync_local", "sync_remote", "sync_snapshot")
_CHANGED = f"{_VIEWS}, c AS (SELECT *, coalesce(local_new <> remote_new, false) AS conflict FROM ({_CHANGES}) WHERE local_new IS NOT NULL OR remote_new IS NOT NULL)"


def _changed(spark, d) -> DataFrame:
    return changes(fixtures.sync_local(spark, d), fixtures.sync_remote(spark, d), fixtures.sync_snapshot(spark, d))


@query("sync_changes", _CHANGED + " SELECT * FROM c")
def sync_changes(spark, d):
    return _changed(spark, d)


def _resolve_query(strategy: str, name: str):
    pull = "remote_new IS NOT NULL AND " + ("true" if strategy == "remote_wins" else "NOT clash")
    push = "local_new IS NOT NULL AND " + ("true" if strategy == "local_wins" else "NOT clash")
    queue = " UNION ALL SELECT asset_id, field, 'queue', NULL FROM w WHERE clash AND conflict" if strategy == "manual" else ""
    sql = f"{_CHANGED}, w AS (SELECT *, bool_or(conflict) OVER (PARTITION BY asset_id) AS clash FROM c) SELECT asset_id, field, 'pull' AS action, remote_new AS value FROM w WHERE {pull} UNION ALL SELECT asset_id, field, 'push', local_new FROM w WHERE {push}{queue}"
    query(name, sql)(lambda spark, d: resolve(_changed(spark, d), strategy))


for _strategy, _name in (("remote_wins", "sync_resolve_remote"), ("local_wins", "sync_resolve_local"), ("manual", "sync_resolve_manual")):
    _resolve_query(_strategy, _name)


@query("sync_snapshot", _VIEWS + ", r AS (SELECT *, true AS there FROM sync_remote) SELECT asset_id, CASE WHEN there THEN r.is_favorite ELSE s.is_favorite END AS is_favorite, CASE WHEN there THEN r.is_archived ELSE s.is_archived END AS is_archived FROM sync_snapshot s FULL JOIN r USING (asset_id)")
def sync_snapshot_query(spark, d):
    return new_snapshot(fixtures.sync_remote(spark, d), fixtures.sync_snapshot(spark, d))


@query("sync_push", _VIEWS + f"""SELECT asset_id, field, value FROM ({' UNION ALL '.join(f"SELECT asset_id, '{f}' AS field, l.{f} AS value, s.{f} AS old FROM sync_local l LEFT JOIN sync_snapshot s USING (asset_id)" for f in FIELDS)}) WHERE value IS NOT NULL AND value IS DISTINCT FROM old""")
def sync_push(spark, d):
    return pending_pushes(fixtures.sync_local(spark, d), fixtures.sync_snapshot(spark, d))


_PUSHED = ", ".join(f"CASE WHEN l.{f} IS NOT NULL AND l.{f} IS DISTINCT FROM s.{f} THEN l.{f} ELSE r.{f} END AS {f}" for f in FIELDS)


@query("sync_after_push", _VIEWS + f"SELECT r.asset_id, {_PUSHED} FROM sync_remote r LEFT JOIN sync_local l USING (asset_id) LEFT JOIN sync_snapshot s USING (asset_id)")
def sync_after_push(spark, d):
    return pushed(fixtures.sync_remote(spark, d), sync_push(spark, d))


@query("sync_pull", _VIEWS + f"SELECT coalesce(r.asset_id, l.asset_id) AS asset_id, {', '.join(f'CASE WHEN r.asset_id IS NOT NULL THEN r.{f} ELSE l.{f} END AS {f}' for f in FIELDS)} FROM sync_local l FULL JOIN sync_remote r ON l.asset_id = r.asset_id")
def sync_pull(spark, d):
    return pulled(fixtures.sync_local(spark, d), fixtures.sync_remote(spark, d))


@query("sync_track", _VIEWS + f"""SELECT asset_id, {', '.join(f'{f} AS local_{f}, {f} AS snapshot_{f}' for f in FIELDS)}, asset_id % 6 = 0 AS is_best, asset_id // 6 AS group_index FROM sync_remote WHERE asset_id % 4 < 3""")
def sync_track(spark, d):
    k = F.col("o_orderkey")
    placed = fixtures.table(spark, d, "orders").where("o_orderkey % 4 < 3").select(k.alias("asset_id"), F.when(k % 6 == 0, True).alias("is_best"), F.floor(k / 6).cast("long").alias("group_index"))
    return tracked(fixtures.sync_remote(spark, d), placed)


@query("sync_status", _CHANGED + """ SELECT (SELECT count(*) FROM sync_remote) AS tracked, (SELECT count(DISTINCT asset_id) FROM c WHERE conflict) AS pending, count(*) AS cycles,
    epoch_us(max(ts)) AS last_sync_us, arg_max(CASE WHEN event_id % 4 = 0 THEN 'failed at ' || event_id END, ts::TIMESTAMP) AS last_error FROM events WHERE event_type = 'error' OR event_id % 100 = 0""".replace("event_type = 'error' OR ", ""))
def sync_status_query(spark, d):
    cycles = fixtures.table(spark, d, "events").where("event_id % 100 = 0").select(fixtures.micros("ts").alias("finished_us"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("failed at "), "event_id")).alias("error"))
    return sync_status(fixtures.sync_remote(spark, d), _changed(spark, d).where("conflict"), cycles)


@query("state_updates", """WITH e AS (SELECT user_id % 20 AS run_id, event_id, event_id % 30 AS g FROM events),
    d AS (SELECT run_id, list_sort(list(DISTINCT g)) AS done FROM (SELECT run_id, g FROM e WHERE event_id % 7 = 0 UNION ALL SELECT DISTINCT run_id, unnest([2, 3]) FROM e) GROUP BY 1),
    n AS (SELECT run_id, 10 + count(*) AS discovered, 4 + count(*) FILTER (event_id % 3 = 0) AS hashed FROM e GROUP BY 1)
    SELECT run_id, array_to_string(done, ',') AS completed, discovered, hashed, CASE WHEN run_id % 4 <> 0 THEN round(100.0::DOUBLE * len(done) / 30, 1) END AS percent FROM d JOIN n USING (run_id)""")
def state_updates(spark, d):
    rows = fixtures.table(spark, d, "events").select((F.col("user_id") % 20).alias("run_id"), "event_id", (F.col("event_id") % 30).alias("group_index"))
    two = F.array(F.lit(2).cast("long"), F.lit(3).cast("long"))
    state = rows.select("run_id").distinct().select("run_id", two.alias("completed"), F.lit(10).cast("long").alias("discovered"), F.lit(4).cast("long").alias("hashed"), F.when(F.col("run_id") % 4 != 0, 30).otherwise(0).alias("groups"))
    found = updated_state(state, rows.where("event_id % 7 = 0"), rows, rows.where("event_id % 3 = 0"))
    return found.select("run_id", F.array_join(F.transform("completed", lambda x: x.cast("string")), ",").alias("completed"), "discovered", "hashed", "percent")


@query("resume_check", """SELECT c_custkey AS run_id, c_custkey % 3 = 0 AND c_custkey % 2 = 0 AND c_custkey % 5 = 0 AS resumes FROM customer""")
def resume_check(spark, d):
    """Runs of other sources, folders and thresholds aren't taken up."""
    from prismlake.config import GroupingConfig
    from prismlake.sources.local import fingerprint

    known = {(a, b, c): fingerprint(["server", "local"][a], ["/other", "/photos"][b], GroupingConfig(threshold=[8, 5][c])) for a in (0, 1) for b in (0, 1) for c in (0, 1)}
    k = F.col("c_custkey")
    of = F.create_map(*(F.lit(x) for key, print_ in known.items() for x in ("".join(map(str, key)), print_)))
    key = F.concat(*((k % n == 0).cast("int").cast("string") for n in (3, 2, 5)))
    return compatible(fixtures.table(spark, d, "customer").select(k.alias("run_id"), F.element_at(of, key).alias("fingerprint")), "local", "/photos", GroupingConfig(threshold=5)).select("run_id", "resumes")


@query("feature_cache", with_views("media") + "SELECT photo_id, hash_hi, hash_lo, CASE WHEN ord % 3 = 0 THEN 1 ELSE 2 END AS run FROM media")
def feature_cache(spark, d):
    """Two runs over a growing library: the second adds what the first hasn't seen."""
    path = new_path(spark, "features")
    rows = fixtures.media(spark, d).select("photo_id", "hash_hi", "hash_lo", "ord")
    append_features(rows.where("ord % 3 = 0").withColumn("run", F.lit(1)).drop("ord"), path)
    return append_features(rows.withColumn("run", F.lit(2)).drop("ord"), path)


@query("conflict_queue", _CHANGED + " SELECT asset_id, count(*) AS n_fields, min(field) AS first_field FROM c WHERE conflict AND asset_id % 10 <> 0 GROUP BY asset_id")
def conflict_queue(spark, d):
    """Conflicts that wait, without those that have been settled."""
    waiting = _changed(spark, d).where("conflict")
    settled = fixtures.table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("asset_id"))
    return waiting.join(settled, "asset_id", "left_anti").groupBy("asset_id").agg(F.count("*").alias("n_fields"), F.min("field").alias("first_field"))


@query("hash_delta", with_views("media") + "SELECT ord, hash_hi, hash_lo FROM media WHERE ord NOT IN (SELECT event_id FROM events WHERE event_id % 2 = 0)")
def hash_delta(spark, d):
    """Rows whose features aren't in the cache yet."""
    cached = fixtures.table(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("ord"))
    return fixtures.media(spark, d).join(cached, "ord", "left_anti").select("ord", "hash_hi", "hash_lo")


@query("resume_remaining", with_views("media") + "SELECT ord // 6 + 1 AS group_index, count(*) AS n FROM media WHERE (ord // 6 + 1) NOT IN (SELECT DISTINCT n_nationkey FROM nation) GROUP BY 1")
def resume_remaining(spark, d):
    done = fixtures.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("group_index"))
    groups = fixtures.media(spark, d).groupBy((F.floor(F.col("ord") / 6) + 1).cast("long").alias("group_index")).agg(F.count("*").alias("n"))
    return groups.join(done, "group_index", "left_anti")


@query("progress", with_views("media") + "SELECT count(*) AS discovered, count(*) FILTER (ord % 3 <> 0) AS hashed, round(100.0::DOUBLE * count(*) FILTER (ord % 3 <> 0) / count(*), 4) AS percent, max(taken_us) AS newest_us FROM media")
def progress(spark, d):
    hashed = F.count_if(F.col("ord") % 3 != 0)
    return fixtures.media(spark, d).agg(F.count("*").alias("discovered"), hashed.alias("hashed"), F.round(100.0 * hashed / F.count("*"), 4).alias("percent"), F.max("taken_us").alias("newest_us"))
