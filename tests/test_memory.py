"""What a task holds and a plan repeats must not grow with the table."""

from __future__ import annotations

import random

import numpy as np
from prismlake.functions import containers, scalars
from prismlake.operators import sync
from pyspark.sql import functions as F


def test_a_task_gives_its_own_best_not_those_of_each_batch(spark, monkeypatch):
    monkeypatch.setattr(scalars, "SCORES", 90)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        rng = random.Random(3)
        rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(400)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(2)
        queries = np.array([r[1] for r in rows[::50]])
        assert scalars._best_of_batches(df, [r[0] for r in rows[::50]], queries, 5).count() <= 2 * 8 * 5
        score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        want = [(q[0], i, score(q[1], v)) for q in rows[::50] for i, v in sorted(rows, key=lambda r: (-score(q[1], r[1]), r[0]))[:5]]
        found = scalars.nearest(df, df.where("vec_id % 50 = 0"), 5, 3).collect()
        assert sorted(map(tuple, found)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_changes_are_made_once_for_all_actions(spark):
    rows = [(i, f, False, [None, True, False][i % 3], [None, False, True][i // 3 % 3], False) for i in range(30) for f in ("is_favorite", "is_archived")]
    changed = spark.createDataFrame(rows, "asset_id long, field string, old boolean, local_new boolean, remote_new boolean, conflict boolean")
    changed = changed.withColumn("conflict", F.coalesce(F.col("local_new") != F.col("remote_new"), F.lit(False)))
    found = sync.resolve(changed, "manual")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    clash = {r.asset_id for r in changed.where("conflict").collect()}
    want = []
    for r in changed.collect():
        want += [(r.asset_id, r.field, "pull", r.remote_new)] if r.remote_new is not None and r.asset_id not in clash else []
        want += [(r.asset_id, r.field, "push", r.local_new)] if r.local_new is not None and r.asset_id not in clash else []
        want += [(r.asset_id, r.field, "queue", None)] if r.conflict else []
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and want


def test_boxes_in_boxes_hold_their_bodies_once(spark):
    box = F.col("x")
    for _ in range(8):
        box = containers._box("free", box)
    plan = spark.range(1).select(F.lit("5a").alias("x")).select(box.alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lpad(") == 8
