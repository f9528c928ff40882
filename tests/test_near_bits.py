from __future__ import annotations

import random

import pytest
from prismlake.config import GroupingConfig
from prismlake.operators import near_bits, similarity
from pyspark.sql import functions as F


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(seed, n=120):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(4)]
    found = []
    for _ in range(n):
        x = rng.choice(bases)
        for k in rng.sample(range(64), rng.randrange(30)):
            x ^= 1 << k
        found.append(x)
    return [*found, 0, 0, (1 << 64) - 1, 1 << 63]


def test_radii_cannot_all_be_exceeded():
    for t in range(64):
        for n in range(1, t + 2):
            found = near_bits.bands(t, n, n % 2 == 0)
            assert sum(b.radius + 1 for b in found) == t + 1 and sum(b.width for b in found) == 64 and all(b.radius >= 0 for b in found)
            assert [b.low for b in found] == [0, *(b.low + b.width for b in found[:-1])]


def test_more_rows_make_wider_bands():
    rows = [10, 1_000, 100_000, 10_000_000, 1_000_000_000]
    assert near_bits.layout(5, 10, 10) == [] and len(near_bits.layout(5, rows[-1], rows[-1])) == 2
    found = [near_bits.layout(10, n, n) for n in rows[2:]]
    by_chance = [near_bits.chance(f) for f in found]
    assert by_chance == sorted(by_chance, reverse=True) and by_chance[-1] < 1e-3
    assert near_bits.layout(63, 500, 500) == []


@pytest.mark.parametrize("half", [True, False])
@pytest.mark.parametrize(("threshold", "n"), [(0, 1), (1, 2), (3, 2), (5, 3), (8, 3), (10, 4), (13, 4), (20, 7), (33, 12), (20, 0), (64, 0)])
def test_every_near_pair_is_found_once(spark, monkeypatch, threshold, n, half):
    """Whatever the bands; also where values are hot."""
    if n % 2:
        monkeypatch.setattr(near_bits, "HOT", 3)
    values = hashes(threshold)
    rows = spark.createDataFrame([(i, signed(x), "ab"[i % 2]) for i, x in enumerate(values)] + [(1000, None, "a")], "ord long, bits long, k string")
    found = near_bits.near(rows, rows, threshold, near_bits.bands(threshold, n, half) if n else [], ["k"] if threshold == 13 else [])
    got = [(r.i, r.j) for r in found.where("a.ord < b.ord").select(F.col("a.ord").alias("i"), F.col("b.ord").alias("j")).collect()]
    same = lambda i, j: threshold != 13 or i % 2 == j % 2
    want = [(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if i < j and (x ^ y).bit_count() <= threshold and same(i, j)]
    assert sorted(got) == want and want


@pytest.mark.parametrize(("threshold", "window_s"), [(20, 0), (20, 300), (12, 40), (30, 300)])
def test_wide_thresholds_lose_no_pair(spark, monkeypatch, threshold, window_s):
    """With bands even where few rows would be compared with all; undated rows are near all in time."""
    monkeypatch.setattr(near_bits, "EMITTED", 0.001)
    rng = random.Random(threshold)
    rows = [(i, x >> 32, x & 0xFFFFFFFF, None if rng.random() < 0.2 else rng.randrange(600) * 1_000_000) for i, x in enumerate(hashes(7))]
    media = spark.createDataFrame(rows, "ord long, hash_hi long, hash_lo long, taken_us long")
    found = similarity.similar_pairs(media, GroupingConfig(threshold, window_s))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    near = lambda a, b: not window_s or a[3] is None or b[3] is None or abs(a[3] - b[3]) <= window_s * 1_000_000
    bits = lambda a, b: (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count()
    want = [(a[0], b[0], bits(a, b)) for a in rows for b in rows if a[0] < b[0] and bits(a, b) <= threshold and near(a, b)]
    assert sorted((r.i, r.j, r.bits) for r in found.collect()) == want


def test_bands_compare_few_of_all_pairs(spark):
    """Rows that meet at a value, counted before they are compared: far fewer than all pairs."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, signed(rng.getrandbits(64))) for i in range(3_000)], "ord long, bits long")
    found = near_bits.layout(8, 3_000, 3_000)
    side = lambda s: rows.select(F.explode(near_bits._keys(F.col("bits"), found, s)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    met = side("left").alias("x").join(side("right").alias("y"), "key").agg(F.sum(F.col("x.n") * F.col("y.n"))).first()[0]
    assert met < 0.15 * 3_000**2
