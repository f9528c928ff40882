"""Two-way state across micro-batches: the last flags and features of each asset on each side are streaming state, compared on arrival.

A record says what a side (local, remote or snapshot) has of an asset, as of `seq`. The state is a streaming aggregation by asset: for
each side the flags of the largest seq, whatever order records come in and however often; it is partly aggregated before it is
shuffled, so an asset with very many records is no single task's work, and it is kept in the checkpoint. A micro-batch gives the
assets that it has touched, with what has changed on either side since the snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismlake import fixtures
from prismlake.operators.sync import _CHANGED, FIELDS, field_changes
from prismlake.registry import query
from prismlake.storage import new_path
from prismlake.streaming.changes import changes

SIDES = ("local", "remote", "snapshot")
RECORD = "asset_id bigint, side string, seq bigint, is_favorite boolean, is_archived boolean, hash string"
FOUND = "asset_id bigint, hash string, rehash boolean, changes array<struct<field:string,old:boolean,local_new:boolean,remote_new:boolean,conflict:boolean>>"


def standing(records: DataFrame) -> DataFrame:
    """(asset_id, local, remote, snapshot, hash, rehash) of records (RECORD): each side's last flags, null for a side that has none yet.

    hash is that of the last record that has one; rehash: an earlier one was another, so what was computed of the asset is out of date.
    """
    last = lambda side: F.max_by(F.when(F.col("side") == side, F.struct(*FIELDS)), F.when(F.col("side") == side, F.col("seq"))).alias(side)
    hashed = F.when(F.col("hash").isNotNull(), F.col("seq"))
    rehash = F.coalesce(F.min("hash") != F.max("hash"), F.lit(False)).alias("rehash")
    return records.groupBy("asset_id").agg(*map(last, SIDES), F.max_by("hash", hashed).alias("hash"), rehash)


def reconciled_batch(assets: DataFrame) -> DataFrame:
    """FOUND of standing() assets that all sides have; no changes is an empty array, as changes that an asset had before may be over."""
    return assets.where(" AND ".join(f"{s} IS NOT NULL" for s in SIDES)).select("asset_id", "hash", "rehash", field_changes(*SIDES).alias("changes"))


def reconcile(records: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Compares a stream of records batch by batch, and writes what it finds of the assets of each to out/batch_id=…; a batch that is tried again overwrites its own."""

    def each(batch: DataFrame, batch_id: int) -> None:
        reconciled_batch(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return standing(records).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """FOUND of each asset as of the last batch that touched it."""
    found = spark.read.schema(f"{FOUND}, batch_id bigint").parquet(out)
    return found.groupBy("asset_id").agg(F.max_by(F.struct("hash", "rehash", "changes"), "batch_id").alias("x")).select("asset_id", "x.*")


def _records(spark, d, side: str) -> DataFrame:
    own = {"local": fixtures.sync_local, "remote": fixtures.sync_remote, "snapshot": fixtures.sync_snapshot}[side](spark, d)
    return own.select("asset_id", F.lit(side).alias("side"), (F.col("asset_id") + 1_000_000_000).alias("seq"), *FIELDS, F.lit(None).cast("string").alias("hash"))


@query("sync_stream", _CHANGED + " SELECT * FROM c")
def sync_stream(spark, d):
    """The rows of sync_changes, from a stream: local flags that are out of date and snapshots come first, then the local ones, then the remote ones, each to a query that goes on from the checkpoint."""
    path, out, cursor = (new_path(spark, x) for x in ("landing", "reconciled", "cursor"))
    local, remote, snapshot = (_records(spark, d, s) for s in SIDES)
    old = local.withColumns({"seq": F.lit(0).cast("long"), **{f: ~F.col(f) for f in FIELDS}})
    for n, rows in enumerate((old.union(snapshot), local, remote)):
        rows.withColumn("updated", F.lit(n).cast("long")).write.mode("append").parquet(path)
        stream = changes(spark, path, old.schema)
        reconcile(stream, out, cursor).awaitTermination()
    return latest(spark, out).select("asset_id", F.inline("changes"))
