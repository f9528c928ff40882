"""Polling as a stream: each micro-batch of changed assets is grouped on its own; the checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismlake import fixtures
from prismlake.config import GroupingConfig
from prismlake.fixtures import with_views
from prismlake.operators.grouping import keyed_sql
from prismlake.operators.similarity import near_groups
from prismlake.registry import query
from prismlake.storage import new_path
from prismlake.streaming.changes import changes


def grouped_batch(media: DataFrame, batch_id: int, config: GroupingConfig) -> DataFrame:
    """Groups among a batch's own assets; earlier ones are not looked at."""
    return near_groups(media, config).withColumn("batch_id", F.lit(batch_id).cast("long"))


def poll(
    stream: DataFrame, out: str, checkpoint: str, config: GroupingConfig, every: str | None = None, also: Callable[[DataFrame, int], None] | None = None, from_latest: bool = False
) -> StreamingQuery:
    """Groups a stream of assets batch by batch into out/batch_id=…; the cursor moves when a batch's groups are written.

    A batch that fails is tried again, and overwrites what it has written. `every` polls on; without it what is there now
    is taken and the query ends. `also` sees each batch as well, such as to reconcile the state of its assets. from_latest:
    the first cycle of a new cursor only records where the stream stands, and takes nothing of what is there already.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if from_latest and batch_id == 0:
            return
        grouped_batch(batch, batch_id, config).drop("batch_id").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if also:
            also(batch, batch_id)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def land(media: DataFrame, path: str) -> None:
    """Adds assets to a landing, with their ord as the time of their update, in as many files as there are partitions."""
    media.withColumn("updated", F.col("ord")).write.mode("append").parquet(path)


_STREAMED = GroupingConfig(threshold=22, window_s=0, min_size=2)


@query(
    "stream_batches",
    with_views("media").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", bm AS (SELECT *, ord // (SELECT (count(*) + 2) // 3 FROM media) AS batch_id FROM media), {keyed_sql('bm', 'batch_id', _STREAMED)}
    SELECT batch_id, count(*) AS members, count(DISTINCT leader) AS groups FROM found GROUP BY batch_id""",
)
def stream_batches(spark, d):
    """The library in thirds, which come one after another; each is a micro-batch."""
    media = fixtures.media(spark, d)
    third = (fixtures.table(spark, d, "embeddings").count() + 2) // 3
    path, out, cursor = (new_path(spark, x) for x in ("landing", "stream-groups", "cursor"))
    for i in range(3):
        land(media.where(F.col("ord").between(i * third, (i + 1) * third - 1)), path)
        poll(changes(spark, path, media.schema), out, cursor, _STREAMED).awaitTermination()
    found = spark.read.parquet(out).groupBy("batch_id").agg(F.count("*").alias("members"), F.count_distinct("leader").alias("groups"))
    return found.withColumn("batch_id", F.col("batch_id").cast("long"))


@query("stream_from_latest", "SELECT vec_id AS ord, 1::BIGINT AS batch_id FROM embeddings WHERE vec_id >= (SELECT min(vec_id) + (max(vec_id) - min(vec_id)) // 2 FROM embeddings)")
def stream_from_latest(spark, d):
    """The first cycle records where it stands and takes nothing; the second takes what has come since: the upper half of the ids."""
    media = fixtures.media(spark, d)
    cut = fixtures.table(spark, d, "embeddings").agg(F.min("vec_id") + F.floor((F.max("vec_id") - F.min("vec_id")) / 2)).first()[0]
    path, out, groups, cursor = (new_path(spark, x) for x in ("landing", "stream-latest", "stream-groups", "cursor"))

    def also(batch: DataFrame, batch_id: int) -> None:
        batch.select("ord", F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    for part in (F.col("ord") < cut, F.col("ord") >= cut):
        land(media.where(part), path)
        poll(changes(spark, path, media.schema), groups, cursor, _STREAMED, also=also, from_latest=True).awaitTermination()
    return spark.read.parquet(out).select("ord", "batch_id")
