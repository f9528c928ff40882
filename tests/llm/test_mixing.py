from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from prismlake import ordering
from prismlake.llm import mixing

from tests.oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        open_ = total - sum(3 * sizes[s] for s in full)
        goal = {s: 3 * sizes[s] if s in full else open_ * weight[s] / rest for s in order}
        over = {s for s in order if s not in full and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        full |= over


def test_targets_are_met_within_a_document(spark):
    rng = random.Random(5)
    rows, sizes = [], defaultdict(int)
    for i in range(1500):
        source = rng.choice(["a", "a", "a", "b", "c", "é", "tiny", None]) if i % 40 else "Z"
        n = rng.choice([0, 1, 5, 40, 100]) if source != "tiny" else 2
        sizes[source] += n
        rows.append((i, " ".join(["w"] * n) if i % 77 else "w\x1cw\tw \n" + " w" * max(n - 2, 0), "en", source, n))
        if i % 77 == 0:
            sizes[source] += 2 + max(n - 2, 0) - n
    rows += [(9000, None, None, "a", None), (9001, "", None, "none", 0)]
    sizes["none"] = 0
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS size", "2 AS s")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and {r.s for r in found} == {2}
    goal, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in found:
        assert 0 <= r.taken_copies <= 3 and r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        taken[r.source] += r.size * r.taken_copies
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes), (taken, goal)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken_copies) for r in again) == sorted((r.doc_id, r.taken_copies) for r in found)
    assert mixing.mix(docs.where("false")).count() == 0


def test_longer_documents_are_wanted_more_often_and_repeated_rows_agree(spark):
    rows = [(i, " ".join(["w"] * (3 if i % 2 else 300)), "en", s, 0) for s in "ab" for i in range(1000)] + [(5, "w w w", "en", "a", 0)] * 3
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).where("source = 'a'").collect()
    rate = lambda n: sum(r.taken_copies for r in found if r.size == n) / sum(r.size == n for r in found)
    assert rate(300) > rate(3) > 0
    assert sum(r.doc_id == 5 for r in found) == 4


@pytest.mark.parametrize("rows", [
    [(None, f"{'w ' * 49}x{i}", "en", "abc"[i % 3], 0) for i in range(3000)],
    [(7, "w " * 50, "en", "abc"[i % 3], 0) for i in range(3000)],
    [(7 if i % 3 else i, "w " * 50 if i % 3 else f"{'w ' * 49}x{i}", "en" if i % 5 else None, "ab"[i % 2], 0) for i in range(3000)],
])
def test_null_and_repeated_ids_meet_the_targets_within_half_a_document(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "COPIES", 100)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in found) == Counter(r[:4] for r in rows)
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r.taken_copies <= 3
        taken[r.source, r.target] += r.size * r.taken_copies
    assert all(abs(n - target) <= 25 for (_, target), n in taken.items()), taken
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(str, again)) == Counter(map(str, found))


def test_sql_agrees_where_ids_are_null_or_repeated(spark, tmp_path):
    rows = [(None if i % 4 else i % 8, " ".join(["w"] * (i % 7)), "en", [None, "a", "b", ""][i % 5 % 4], 0) for i in range(500)] + [(1, None, "en", "a", 0)] * 3
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(spark, mixing.op2_pareto_mix, mixing.OP2_SQL, str(tmp_path)) == len(rows)
