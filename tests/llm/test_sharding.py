from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from prismlake import ordering
from prismlake.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def check(found, rows, shards):
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1, counts
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want


def cut(found):
    """Links between the shards, as a share of all links."""
    groups = defaultdict(Counter)
    for r in found:
        groups[r.text_crc32, r.size][r.shard] += 1
    pairs = sum(sum(c.values()) ** 2 for c in groups.values()) - len(found)
    kept = sum(x * x for c in groups.values() for x in c.values()) - len(found)
    return 1 - kept / pairs if pairs else 0


def table(kind):
    rng = random.Random(11)
    if kind == "hot":
        sizes = [300, 40, 2, 2, 3, 5, 17] + [1] * 500
    elif kind == "pairs":
        sizes = [2] * 300 + [7] * 20
    elif kind == "all one":
        sizes = [203]
    else:
        sizes = [rng.choice([1, 1, 1, 2, 3, 9]) for _ in range(400)]
    rows = [(len(sizes) * k + g, f"text é {g}") for g, n in enumerate(sizes) for k in range(n)]
    return rows + [(-1, None), (-2, ""), (None, "text é 1"), (0, "text é 0"), (0, "text é 0")]


@pytest.mark.parametrize("kind, most", [("hot", 0.7), ("pairs", 0.15), ("all one", 0.9), ("mixed", 0.02)])
def test_counts_are_even_and_few_links_are_cut(spark, kind, most):
    rows = table(kind)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", "1 AS shard", "2 AS slot", "3 AS `group`")
    found = sharding.shard(docs).collect()
    check(found, rows, 8)
    assert cut(found) <= most, cut(found)
    if kind == "mixed":
        again = sharding.shard(docs.repartition(9)).collect()
        assert sorted(map(str, again)) == sorted(map(str, found))


def test_empty_and_tiny_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 0), (2, "a", "en", "s", 0), (3, "b", "en", "s", 0)], SCHEMA)
    check(sharding.shard(docs).collect(), [(1, "a"), (2, "a"), (3, "b")], 8)
    assert sharding.shard(docs.where("false")).count() == 0


def test_rows_repeated_as_they_are_are_dealt_like_others(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES", 50)
    rows = [(None, "same")] * 2000 + [(5, "same")] * 7 + [(i, f"t{i % 900}") for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    found = sharding.shard(docs).collect()
    check(found, rows, 8)
    assert sorted(map(str, sharding.shard(docs.repartition(5)).collect())) == sorted(map(str, found))
