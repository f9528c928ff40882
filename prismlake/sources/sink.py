"""A sink that acts: plans become chunks of actions, which a Spark data source writer hands to a store, each chunk once.

An action is a row (step, action, value, target): to add `value` as a tag to the asset `target`, and so on. Actions of equal step,
action and value go to the store in chunks of at most so many targets. A chunk's key is a digest of its run and of what it does, so a
task that is tried again, or a run that is applied again after a crash, does nothing twice. The store here is a log in the
shared folder beside landed assets: each try of a task writes a file of its own, and Spark's commit names the files that count. A
store that is elsewhere takes chunks by `send`, which must do a key once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow.fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from prismlake import fixtures, versions
from prismlake.fixtures import with_views
from prismlake.operators.batches import chunked
from prismlake.operators.people import ALBUMS_SQL, album_names
from prismlake.operators.ranking import REPORT, report_rows
from prismlake.plans.actions import TAGS, album_plan, flag_plan, tag_plan, with_description
from prismlake.registry import query
from prismlake.shipping import ship
from prismlake.storage import kept, new_path

#: Targets of a chunk, and tries for each.
SIZE, TRIES = 200, 3
#: What a store can be asked to do; the last two have no target.
ACTIONS = ("favorite", "archived", "description", "add_tag", "remove_tag", "add_to_album", "remove_from_album", "delete_tag", "delete_album")
CHUNK = "key string, step int, action string, value string, targets array<string>"
LOG = f"{CHUNK}, plan bigint, error string"


def _actions(rows: DataFrame, action: str, value: Column, target: Column | None, step: int = 1) -> DataFrame:
    return rows.select(F.lit(step).alias("step"), F.lit(action).alias("action"), value.cast("string").alias("value"), (F.lit(None) if target is None else target).cast("string").alias("target"))


def tag_actions(plan: DataFrame) -> DataFrame:
    """Of a tag plan (tag, asset_id)."""
    return _actions(plan, "add_tag", F.col("tag"), F.col("asset_id"))


def album_actions(plan: DataFrame) -> DataFrame:
    """Of an album plan (album, asset_id)."""
    return _actions(plan, "add_to_album", F.col("album"), F.col("asset_id"))


def update_actions(plan: DataFrame) -> DataFrame:
    """Of a plan of updates (asset_id and any of favorite, archived, description); null leaves a field as it is."""
    fields = [c for c in ("favorite", "archived", "description") if c in plan.columns]
    return reduce(DataFrame.union, (_actions(plan.where(F.col(c).isNotNull()), c, F.col(c), F.col("asset_id")) for c in fields))


def undo_actions(plan: DataFrame) -> DataFrame:
    """Of a cleanup plan (step, action, target), whose steps are done in order."""
    done = {"unfavorite": ("favorite", F.lit("false")), "unarchive": ("archived", F.lit("false")), "delete_tag": ("delete_tag", F.col("target")), "delete_album": ("delete_album", F.col("target"))}
    parts = []
    for name, (action, value) in done.items():
        rows = plan.where(F.col("action") == name)
        found = _actions(rows, action, value, None if action.startswith("delete") else F.col("target"))
        parts.append(found.withColumn("step", F.lit([*done].index(name) + 1)))
    return reduce(DataFrame.union, parts)


@dataclass
class Sent(WriterCommitMessage):
    file: str | None


class ActionWriter(DataSourceWriter):
    """Hands chunks to `send`, each up to TRIES times, and logs what came of them."""

    def __init__(self, path: str, plan: int, send: Callable[[dict], None] | None):
        self.path, self.plan, self.send = path.rstrip("/"), plan, send

    def _system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def _result(self, chunk: dict) -> str | None:
        """None, or the last error."""
        for left in reversed(range(TRIES if self.send else 0)):
            try:
                self.send(chunk)
                return None
            except Exception as e:  # noqa: BLE001  whatever a store raises is the chunk's result
                if not left:
                    return str(e) or type(e).__name__
                time.sleep(0.05 * (TRIES - left))
        return None

    def write(self, iterator: Iterator[Row]) -> Sent:
        lines = []
        for row in iterator:
            chunk = row.asDict()
            lines.append(json.dumps(chunk | {"plan": self.plan, "error": self._result(chunk)}))
        if not lines:
            return Sent(None)
        system, folder = self._system()
        name = f"{uuid.uuid4().hex}.json"
        system.create_dir(f"{folder}/chunks", recursive=True)
        with system.open_output_stream(f"{folder}/chunks/{name}") as out:
            out.write("\n".join(lines).encode())
        return Sent(name)

    def commit(self, messages: list[Sent | None]) -> None:
        """The plan's files count from here on: the list is written aside and renamed."""
        system, folder = self._system()
        system.create_dir(f"{folder}/plans", recursive=True)
        aside = f"{folder}/plans/.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write(json.dumps([m.file for m in messages if m and m.file]).encode())
        system.move(aside, f"{folder}/plans/{self.plan:012d}.json")

    def abort(self, messages: list[Sent | None]) -> None:
        system, folder = self._system()
        for m in messages:
            if m and m.file:
                system.delete_file(f"{folder}/chunks/{m.file}")


class AssetActions(DataSource):
    """Format `asset_actions`: writes CHUNK rows to the log at `path`, as the plan of the number `plan`. A store of another kind is a subclass with a `send`."""

    send: Callable[[dict], None] | None = None

    @classmethod
    def name(cls) -> str:
        return "asset_actions"

    def writer(self, schema, overwrite: bool) -> ActionWriter:
        return ActionWriter(self.options["path"], int(self.options["plan"]), type(self).send)


def log(spark: SparkSession, path: str) -> DataFrame:
    """LOG rows of the plans that were committed to the store at path."""
    files = [f"{path.rstrip('/')}/chunks/{name}" for plan in _plans(spark, path) for name in versions._read(spark, plan)]
    return spark.read.schema(LOG).json(files) if files else spark.createDataFrame([], LOG)


def _plans(spark: SparkSession, path: str) -> list[str]:
    return versions.listed(spark, f"{path.rstrip('/')}/plans/*.json")


def chunks(actions: DataFrame, run: str, size: int = SIZE) -> DataFrame:
    """CHUNK rows of a run's actions (step, action, value, target): targets are distinct and in order, in chunks of at most `size`."""
    unknown = actions.where(~F.col("action").isin(*ACTIONS)).select("action").limit(1).collect()
    if unknown:
        raise ValueError(f"no action {unknown[0][0]}; there are {ACTIONS}")
    own = kept(actions.distinct().withColumn("per", F.sha2(F.to_json(F.struct("step", "action", "value")), 256)), "actions")
    cut = chunked(own, F.col("target"), size, "per")
    held = cut.groupBy("per", "chunk").agg(F.first("step").alias("step"), F.first("action").alias("action"), F.first("value").alias("value"), F.sort_array(F.collect_list("target")).alias("targets"))
    return held.select(F.sha2(F.to_json(F.struct(F.lit(run).alias("run"), "step", "action", "value", "targets")), 256).alias("key"), "step", "action", "value", "targets")


def apply(actions: DataFrame, path: str, run: str, known: DataFrame | None = None, size: int = SIZE, source: type[DataSource] = AssetActions) -> DataFrame:
    """Applies a run's actions (step, action, value, target) to the store at path, and returns those that failed, with `error`.

    known: (asset_id) of all assets there are; actions on others aren't sent, and fail. Steps are sent in order, each as a plan of its
    own. What the run has done already isn't sent again, so after a crash, or for chunks that failed, it is applied once more and does
    only the rest. One run at a time may write to a store.
    """
    spark = ship(actions.sparkSession)
    spark.dataSource.register(source)
    actions, failed = kept(actions, "wanted-actions"), []
    if known is not None:
        ids = known.select(F.col("asset_id").cast("string").alias("target")).distinct()
        lost = kept(actions.where("target IS NOT NULL").join(ids, "target", "left_anti"), "unknown")
        failed.append(lost.select("step", "action", "value", "target", F.lit("no such asset").alias("error")))
        actions = actions.where("target IS NULL").unionByName(actions.join(ids, "target", "left_semi"))
    wanted = kept(chunks(actions, run, size), "chunks")
    first = len(_plans(spark, path)) + 1
    steps = [r["step"] for r in wanted.select("step").distinct().orderBy("step").collect()]  # a few
    for at, step in enumerate(steps):
        done = log(spark, path).where("error IS NULL").select("key")
        rows = wanted.where(F.col("step") == step).join(done, "key", "left_anti")
        rows.select(*(c.split()[0] for c in CHUNK.split(", "))).write.format(source.name()).mode("append").option("plan", first + at).save(path)
    errors = log(spark, path).where(F.col("error").isNotNull() & (F.col("plan") >= first))
    failed.append(errors.select("step", "action", "value", F.explode_outer("targets").alias("target"), "error"))
    return reduce(DataFrame.unionByName, failed)


#: What an action is about, if not a field of its own name.
_FIELD = {"add_tag": "tag", "remove_tag": "tag", "delete_tag": "tag", "add_to_album": "album", "remove_from_album": "album", "delete_album": "album"}


def _field() -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in _FIELD.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, F.col("action")), F.col("action"))


def state(done: DataFrame) -> DataFrame:
    """(asset_id, favorite, archived, description, tags, albums) of the assets that a log has done anything to: what its last plans say."""
    own = done.where("error IS NULL").withColumn("field", _field())
    each = own.withColumn("target", F.explode_outer("targets"))
    latest = lambda rows, *by: rows.groupBy(*by).agg(F.max(F.struct("plan", "action", "value")).alias("last"))
    flags = latest(each.where(~F.col("field").isin("tag", "album")), "target", "field")
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("last.value"))).alias(f)
    single = flags.groupBy("target").agg(*(value(f) for f in ("favorite", "archived", "description")))
    members = latest(each.where(F.col("field").isin("tag", "album") & F.col("target").isNotNull()), "target", "field", "value")
    deleted = own.where(F.startswith("action", F.lit("delete"))).groupBy("field", "value").agg(F.max("plan").alias("gone"))
    held = members.join(deleted, ["field", "value"], "left").where(F.startswith("last.action", F.lit("add")) & F.coalesce(F.col("last.plan") > F.col("gone"), F.lit(True)))
    names = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.col("value")))).alias(f"{f}s")
    several = held.groupBy("target").agg(names("tag"), names("album"))
    found = each.where("target IS NOT NULL").select("target").distinct().join(single, "target", "left").join(several, "target", "left")
    empty = F.array().cast("array<string>")
    return found.select(
        F.col("target").alias("asset_id"), F.col("favorite").cast("boolean").alias("favorite"), F.col("archived").cast("boolean").alias("archived"), "description",
        F.coalesce("tags", empty).alias("tags"), F.coalesce("albums", empty).alias("albums"),
    )


def _planned(spark, d) -> DataFrame:
    """All that a run plans for the report's photos: tags, albums, flags and some descriptions."""
    rows = report_rows(spark, d)
    texts = rows.where("group_index % 5 = 0").select("asset_id", F.concat(F.lit("group "), "group_index").alias("description"))
    return reduce(DataFrame.union, (tag_actions(tag_plan(rows, ["hdr"])), album_actions(album_plan(rows, album_names(spark, d))), update_actions(with_description(flag_plan(rows), texts))))


_VIEWS = with_views("media") + f", {REPORT}, {ALBUMS_SQL}"
_TAGS = f"""t AS (SELECT asset_id, '{TAGS}/group-' || printf('%04d', group_index) AS tag FROM report UNION SELECT asset_id, '{TAGS}/best' FROM report WHERE is_best UNION SELECT asset_id, '{TAGS}/non-best' FROM report WHERE NOT is_best
    UNION SELECT asset_id, '{TAGS}/person-' || person FROM report WHERE person IS NOT NULL UNION SELECT asset_id, '{TAGS}/modified/hdr' FROM report WHERE is_best)"""

@query("apply_plan", _VIEWS + f""", {_TAGS}, a AS (SELECT asset_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM t GROUP BY 1)
    SELECT r.asset_id, CASE WHEN is_best THEN true END AS favorite, CASE WHEN NOT is_best THEN true END AS archived, CASE WHEN group_index % 5 = 0 THEN 'group ' || group_index END AS description, a.tags, coalesce(album, '') AS albums
    FROM report r JOIN a USING (asset_id) LEFT JOIN named USING (group_index) WHERE substr(r.asset_id, length(r.asset_id)) <> '7'""")
def apply_plan(spark, d):
    """What the store's log says of each asset after a run's plans, applied twice; assets whose id ends in 7 are not there."""
    path, known = new_path(spark, "store"), report_rows(spark, d).where("NOT endswith(asset_id, '7')")
    for _ in range(2):
        apply(_planned(spark, d), path, "run", known)
    found = state(log(spark, path))
    return found.select("asset_id", "favorite", "archived", "description", F.array_join("tags", ",").alias("tags"), F.array_join("albums", ",").alias("albums"))


@query("apply_failures", _VIEWS + f""", {_TAGS}, x AS (SELECT 'add_tag' AS action, tag AS value, asset_id FROM t UNION ALL SELECT 'add_to_album', album, asset_id FROM report JOIN named USING (group_index)
    UNION ALL SELECT CASE WHEN is_best THEN 'favorite' ELSE 'archived' END, 'true', asset_id FROM report UNION ALL SELECT 'description', 'group ' || group_index, asset_id FROM report WHERE group_index % 5 = 0)
    SELECT action, value, asset_id AS target, 'no such asset' AS error FROM x WHERE substr(asset_id, length(asset_id)) = '7'""")
def apply_failures(spark, d):
    """The actions that come back: those on assets that are not there."""
    failed = apply(_planned(spark, d), new_path(spark, "store"), "run", report_rows(spark, d).where("NOT endswith(asset_id, '7')"))
    return failed.select("action", "value", "target", "error")
