from __future__ import annotations

import random

import pytest
from prismlake import fixtures
from prismlake.functions.scalars import nearest
from prismlake.operators import vector_index

SCHEMA = "vec_id long, embedding array<float>"


def recall(found, exact):
    true = {(r.query_id, r.vec_id) for r in exact.collect()}
    return len(true & {(r.query_id, r.vec_id) for r in found.collect()}) / len(true)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_index_against_the_exact_scan(spark, folder):
    e = fixtures.table(spark, f"/root/testdata/{folder}", "embeddings")
    asked = e.where("vec_id % 50 = 0")
    index = vector_index.build(e)
    assert sum(len(r.ids) for r in index.blocks.collect()) == e.count() and len(index.centroids) > 10
    tuned = index.tuned(e, asked)
    assert tuned.probes < len(index.centroids)
    assert recall(tuned.search(asked), nearest(e, asked)) >= 0.9


def table(spark, n=600):
    rng = random.Random(4)
    centers = [[rng.gauss(0, 5) for _ in range(8)] for _ in range(15)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centers)]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, [0.0] * 8)], SCHEMA)


def test_rows_of_any_length_are_found_by_their_dot_product(spark, monkeypatch):
    """Also in small blocks of lists that are dealt over tasks; reading all lists is exact."""
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    monkeypatch.setattr(vector_index, "DEALT", 20)
    e = table(spark)
    asked = e.where("vec_id % 20 = 0 AND embedding IS NOT NULL")
    index = vector_index.build(e, 15)
    assert max(len(r.ids) for r in index.blocks.collect()) == 7
    exact = nearest(e.where("embedding IS NOT NULL"), asked, 5)
    tuned = index.tuned(e.where("embedding IS NOT NULL"), asked, 5)
    assert tuned.probes < 8 and recall(tuned.search(asked, 5), exact) >= 0.9
    index.probes = len(index.centroids)
    assert sorted(map(tuple, index.search(asked, 5).collect())) == sorted(map(tuple, exact.collect()))


def test_few_rows_and_none(spark):
    e = table(spark, 2)
    found = vector_index.build(e).tuned(e.where("embedding IS NOT NULL"), e.where("vec_id = 0")).search(e.where("vec_id = 0"))
    assert found.count() == 3
    none = vector_index.build(e.where("false"))
    assert none.search(e.where("false")).count() == 0 and none.tuned(e.where("false"), e.where("false")).probes == 1
