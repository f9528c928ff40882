from __future__ import annotations

import random

import pytest
from prismlake.operators import sync
from prismlake.streaming import reconcile
from prismlake.streaming.changes import changes
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

FLAGS = "asset_id long, is_favorite boolean, is_archived boolean"


def land(spark, path, rows, updated):
    spark.createDataFrame(rows, reconcile.RECORD).withColumn("updated", F.lit(updated).cast("long")).write.mode("append").parquet(path)


def state_of(rows):
    """The last flags of each asset on each side."""
    held = {}
    for asset, side, seq, favorite, archived, _ in rows:
        if seq >= held.get((side, asset), (-1,))[0]:
            held[side, asset] = (seq, favorite, archived)
    return held


def test_the_stream_has_the_rows_of_the_batch_after_each_restart(spark, tmp_path):
    path, out, cursor = (str(tmp_path / x) for x in ("in", "out", "cursor"))
    rng, rows = random.Random(4), []
    flag = lambda: rng.choice([True, False, None])
    for cycle in range(3):
        new = [(rng.randrange(25), rng.choice(reconcile.SIDES), 1000 * rng.randrange(3) + cycle * 200 + i, flag(), flag(), None) for i in range(120)]
        rows += new
        land(spark, path, new, cycle)
        reconcile.reconcile(changes(spark, path, spark.createDataFrame([], reconcile.RECORD).schema), out, cursor).awaitTermination()
        held = state_of(rows)
        sides = [spark.createDataFrame([(a, *flags[1:]) for (s, a), flags in held.items() if s == side], FLAGS) for side in reconcile.SIDES]
        want = sorted(map(str, sync.changes(*sides).collect()))
        assert sorted(map(str, reconcile.latest(spark, out).select("asset_id", F.inline("changes")).collect())) == want and want
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3


def test_a_batch_that_fails_is_tried_again_with_the_state_before_it(spark, tmp_path, monkeypatch):
    path, out, cursor = (str(tmp_path / x) for x in ("in", "out", "cursor"))
    schema = spark.createDataFrame([], reconcile.RECORD).schema
    run = lambda: reconcile.reconcile(changes(spark, path, schema), out, cursor).awaitTermination()
    land(spark, path, [(1, s, 1, False, False, "a") for s in reconcile.SIDES], 0)
    run()
    land(spark, path, [(1, "local", 2, True, False, "b")], 1)
    batch = reconcile.reconciled_batch

    def dies(assets):
        raise OSError("the store is away")

    with monkeypatch.context() as m:
        m.setattr(reconcile, "reconciled_batch", dies)
        with pytest.raises(StreamingQueryException):
            run()
    assert reconcile.reconciled_batch is batch and reconcile.latest(spark, out).first().changes == []
    run()
    found = reconcile.latest(spark, out).collect()
    assert [(r.asset_id, r.hash, r.rehash, [(c.field, c.local_new) for c in r.changes]) for r in found] == [(1, "b", True, [("is_favorite", True)])]
