from __future__ import annotations

import pytest
from prismlake.config import GroupingConfig
from prismlake.operators import sync
from prismlake.streaming import polling
from prismlake.streaming.changes import changes
from pyspark.errors import StreamingQueryException

SCHEMA = "ord long, hash_hi long, hash_lo long, taken_us long"
CONFIG = GroupingConfig(5, 0, 2)


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_batches_are_grouped_each_on_its_own(spark, tmp_path):
    path, out, cursor = (str(tmp_path / x) for x in ("in", "out", "cursor"))
    land(spark, path, [(0, 0, 0, None), (1, 0, 1, None), (2, 9999, 9999, None)])
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    polling.poll(stream, out, cursor, CONFIG).awaitTermination()
    land(spark, path, [(3, 0, 3, None), (4, 9999, 9998, None), (5, 0, 2, None)])
    polling.poll(stream, out, cursor, CONFIG).awaitTermination()
    found = {(r.batch_id, r.ord): r.leader for r in spark.read.parquet(out).collect()}
    assert found == {(0, 0): 0, (0, 1): 0, (1, 3): 3, (1, 5): 3}


def test_the_cursor_moves_only_when_a_batch_succeeds(spark, tmp_path):
    path, out, cursor = (str(tmp_path / x) for x in ("in", "out", "cursor"))
    land(spark, path, [(0, 0, 0, None), (1, 0, 1, None)])
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    tries = []

    def also(batch, batch_id):
        tries.append(batch_id)
        if len(tries) == 1:
            raise RuntimeError("the store is away")

    with pytest.raises(StreamingQueryException):
        polling.poll(stream, out, cursor, CONFIG, also=also).awaitTermination()
    polling.poll(stream, out, cursor, CONFIG, also=also).awaitTermination()
    assert tries == [0, 0] and spark.read.parquet(out).count() == 2


def test_polled_assets_are_reconciled_with_their_batch(spark, tmp_path):
    path, out, cursor = (str(tmp_path / x) for x in ("in", "out", "cursor"))
    land(spark, path, [(1, 0, 0, None), (2, 0, 1, None)])
    flags = "asset_id long, is_favorite boolean, is_archived boolean"
    mine = spark.createDataFrame([(1, True, False), (3, True, False)], flags)
    theirs, last = (spark.createDataFrame([(i, False, False) for i in (1, 2, 3)], flags) for _ in range(2))
    done = []

    def reconcile(batch, batch_id):
        ids = batch.selectExpr("ord AS asset_id")
        changed = sync.changes(mine.join(ids, "asset_id", "left_semi"), theirs, last)
        done.extend((r.asset_id, r.field, r.action) for r in sync.resolve(changed, "manual").collect())

    polling.poll(spark.readStream.schema(SCHEMA).parquet(path), out, cursor, CONFIG, also=reconcile).awaitTermination()
    assert done == [(1, "is_favorite", "push")]


def test_all_that_came_since_the_first_cycle_is_taken(spark):
    folder = "/root/testdata/sf0.001"
    ids = [r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()]
    cut = min(ids) + (max(ids) - min(ids)) // 2
    found = [tuple(r) for r in polling.stream_from_latest(spark, folder).collect()]
    assert sorted(found) == [(i, 1) for i in sorted(ids) if i >= cut]


def land_changes(spark, path, rows, files=3):
    spark.createDataFrame(rows, "ord long, updated long").repartition(files).write.mode("append").parquet(path)


def test_the_cursor_is_a_time_and_a_batch_has_many_tasks(spark, tmp_path):
    """Restarts go on from the checkpoint; files before the cursor aren't read, and rows after it come once."""
    path, cursor, seen = str(tmp_path / "in"), str(tmp_path / "cursor"), []

    def take():
        stream = changes(spark, path, spark.createDataFrame([], "ord long").schema)

        def each(batch, batch_id):
            rows = batch.selectExpr("ord", "spark_partition_id() AS p").collect()
            seen.append((batch_id, sorted(r.ord for r in rows), len({r.p for r in rows})))

        stream.writeStream.foreachBatch(each).option("checkpointLocation", cursor).trigger(availableNow=True).start().awaitTermination()

    land_changes(spark, path, [(i, 100 + i) for i in range(30)])
    take()
    assert seen == [(0, [*range(30)], 3)]
    take()
    assert len(seen) == 1
    land_changes(spark, path, [(50, 5), (51, 129), (52, 130), (53, 200), (54, None)], 2)
    take()
    assert seen[1:] == [(1, [52, 53], 2)] or seen[1:] == [(1, [52, 53], 1)]
    assert len(changes_reader(path).partitions({"until": 129}, {"until": 200})) <= 2 and changes_reader(path).latestOffset() == {"until": 200}


def changes_reader(path):
    from prismlake.streaming.changes import ChangesReader

    return ChangesReader(path, "updated", ["ord"])


def test_a_landing_that_is_not_there_yet(tmp_path):
    reader = changes_reader(str(tmp_path / "none"))
    assert reader.latestOffset() == reader.initialOffset()
