from __future__ import annotations

import random

import pytest
from prismlake import ordering, storage
from prismlake.ordering import copies, fresh, in_order, key_of, numbered, per_key, running, size_bins, spread_join
from prismlake.storage import Kept, Scratch, small
from pyspark.sql import functions as F


def test_running_sums_are_those_of_one_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(5), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, b long, v long")
    found = {r.i: r.before for r in running(df, ["k"], "b", [F.col("i")], F.col("v"), "before").collect()}
    for k in ("a", "b", None):
        total = 0
        for _, i, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            assert found[i] == total
            total += v
    assert running(df.where("false"), ["k"], "b", [F.col("i")], F.col("v"), "before").count() == 0


def test_numbers_have_no_gap(spark):
    ids = random.Random(5).sample(range(-1000, 10_000_000), 300)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert [r.n for r in numbered(df, "id", "n", 300).orderBy("id").collect()] == [*range(1, 301)]
    assert numbered(df.where("false"), "id", "n", 0).count() == 0


def test_keys_keep_the_order_of_code_points_with_null_last(spark):
    names = ["", "-", "a", "z", "~", "~~", "é", "\U0001f600", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r.s for r in df.orderBy(key_of("s")).collect()] == names
    assert size_bins(0) == 16 and size_bins(1_000_000) == 50


def test_kept_tables_are_read_back_and_small_ones_marked(spark):
    kept = Kept(spark.range(10), "test")
    assert kept.df.count() == 10
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small(kept.df, 10)) and "broadcast" not in plan(small(kept.df, 9))
    kept.drop()


def test_what_a_settled_table_was_made_of_is_deleted(spark):
    import os

    seen = []

    def make():
        seen.append(Kept(spark.range(5), "inner"))
        return seen[0].df.selectExpr("id + 1 AS id")

    outer = Kept(spark.range(3), "outer")
    table = storage.settled(spark, make, "settled")
    there = lambda t: os.path.exists(t.path.removeprefix("file://"))
    assert sorted(r.id for r in table.df.collect()) == [1, 2, 3, 4, 5] and there(table) and there(outer) and not there(seen[0])
    outer.drop()
    assert not there(outer)


def test_scratch_tables_go_with_their_block(spark):
    import os

    with Scratch() as keep:
        df = keep(spark.range(5), "scratch")
        assert df.count() == 5
        path = keep.tables[0].path.removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_bytes_bound_what_is_sent_as_well(spark):
    df = Kept(spark.createDataFrame([(1, "x" * 100, [1, 2, 3])], "a long, b string, c array<long>"), "wide").df
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small(df, 5, 200)) and "broadcast" not in plan(small(df, 5, 100))


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert storage.shared_folder(Session()).startswith("file://")


def test_sums_in_any_order(spark):
    rng = random.Random(9)
    rows = [(f"s{rng.randrange(10**9)}", i, rng.randrange(7)) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, i long, v long")
    found = {r.i: (r.n, r.held) for r in in_order(df, [F.col("s")], {"n": F.lit(1), "held": F.col("v")}, 100_000).collect()}
    held = 0
    for n, (_, i, v) in enumerate(sorted(rows)):
        assert found[i] == (n, held)
        held += v


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_are_dealt_and_joined_whole(spark, monkeypatch, how):
    monkeypatch.setattr(ordering, "LEAST", 10)
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(600)] + [(1000, None)], "i long, k string")
    one = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 600, 6)], "k string, v long")
    got, want = (sorted(map(str, x.select(sorted(x.columns)).collect())) for x in (spread_join(many, one, "k", ["i"], 600, how), many.join(one, "k", how)))
    assert got == want


def test_copies_are_numbered_and_many_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES", 7)
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 100), ("d", 0)], "k string, n long")
    found = copies(df, "n", "at", 5_000)
    assert sorted((r.k, r.at) for r in found.collect()) == sorted((k, i) for k, n in (("a", 1), ("b", 7), ("c", 100)) for i in range(n))
    assert len({r.p for r in found.where("k = 'c'").select(F.spark_partition_id().alias("p")).collect()}) > 3


def test_working_names_are_new(spark):
    assert fresh(spark.range(1).selectExpr("id AS _A", "id AS _a_"), "_a", "_b", "_b") == ["_a__", "_b", "_b_"]


@pytest.mark.parametrize("rows", [500, 100_000])
def test_sums_within_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "A_KEY", 1_000)
    monkeypatch.setattr(ordering, "LEAST", 50)
    rng = random.Random(3)
    data = [(rng.choice("aaaab"), i, rng.randrange(9)) for i in range(500)]
    found = {r.i: r.held for r in per_key(spark.createDataFrame(data, "k string, i long, v long"), "k", [F.col("i").desc()], F.col("v"), "held", rows).collect()}
    held = {"a": 0, "b": 0}
    for k, i, v in reversed(data):
        assert found[i] == held[k]
        held[k] += v


def test_starts_of_ranges_in_two_levels(spark, monkeypatch):
    """Also where starts are too many to be sent."""
    monkeypatch.setattr(ordering, "BLOCK", 3)
    monkeypatch.setattr(ordering, "STARTS", 0)
    df = spark.createDataFrame([(i * 37 % 500, i) for i in range(500)], "s long, v long")
    dealt = df.repartitionByRange(11, "s").sortWithinPartitions("s")
    assert all(r.s + 1 == r.n for r in ordering.placed(dealt, "n").collect())
    assert {r.s: r.held for r in in_order(df, [F.col("s")], {"held": F.lit(2)}, 250_000).collect()} == {i: 2 * i for i in range(500)}


def test_pairs_of_hot_keys_are_dealt_and_whole(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i long, k string")
    right = spark.createDataFrame([(j, "hot" if j % 2 else f"k{j}") for j in range(60)], "j long, k string")
    want = sorted((r.i, r.j) for r in left.join(right, "k").collect())
    for most in (10, 1_000):
        a, b, keys = ordering.dealt_pairs(left, right, ["k"], most, ["i"])
        found = a.join(b, keys)
        assert sorted((r.i, r.j) for r in found.collect()) == want and (len(keys) == 2) == (most == 10)
