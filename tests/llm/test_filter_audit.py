from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from prismlake import ordering
from prismlake.llm import filter_audit

from ..oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    texts = [(r[0], r[1] or "", r[3] or "") for r in rows]
    fails = []
    for doc_id, text, _ in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append({
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and t == text for i, t, _ in texts),
        })
    good, toxic = ({r[0] for r in labels if r[k] == 1} - {None} for k in (1, 2))
    out = {}
    for part in {p for _, _, p in texts}:
        own = [(i, f) for (i, _, p), f in zip(texts, fails, strict=True) if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone, stay = [x for x in left if x[1][letter]], [x for x in left if not x[1][letter]]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(stay), len(gone), sum(x[1][letter] for x in own) - len(gone), sum(x[1][letter] and sum(x[1].values()) == 1 for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)
                ]
                left = stay
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(shapley[letter])
    return out


def rows(rng):
    words = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    texts = [words(60, 1000) for _ in range(6)] + [words(80, 9), words(20, 99), words(70, 1000).upper(), words(70, 1000) + " 5 $", "", "x" * 200_000, "é" * 60, "a\x1cb " * 60]
    found = [(rng.choice([None, *range(40)]), rng.choice([*texts, texts[0], texts[0], texts[0], None]), "en", rng.choice(["a", "b", "", None]), 0) for _ in range(150)]
    return [*found, *found[:20], *(3 * [(7, texts[0], "en", "a", 0)]), *(3 * [(None, texts[0], "en", None, 0)])]


@pytest.mark.parametrize(("seed", "size", "shared"), [(1, 64 << 20, 2_000_000), (2, 300, 2_000_000), (3, 300, 0)])
def test_every_count_agrees_with_brute_force(spark, monkeypatch, seed, size, shared):
    """Also where a text's copies fill many ranges, and where fingerprints are too many to be sent."""
    monkeypatch.setattr(filter_audit, "RANGE", size)
    monkeypatch.setattr(filter_audit, "ROWS", max(10, size))
    monkeypatch.setattr(filter_audit, "SHARED", shared)
    monkeypatch.setattr(ordering, "LEAST", 7)
    rng = random.Random(seed)
    docs = rows(rng)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), 4, 6, None, None]]
    found = filter_audit.interactions(spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS mask", "2 AS part", "3 AS edge"), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    assert len(found) == len(want) == 600 * len({k[0] for k in want})
    for r in found:
        assert list(r[3:]) == want[r.part, r.filter_order, r.step], r


def test_a_range_gives_its_ends_to_others():
    import pyarrow as pa

    def run(*found):
        names = ["doc_id", "part", "mask", "fp", "text"]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int64()), pa.array(["p"]), pa.array([0], pa.int32()), pa.array([r[1]], pa.int64()), pa.array([r[2]], pa.string())], names=names) for r in found]
        return [tuple(r.values()) for b in filter_audit._judge(iter(batches)) for r in b.to_pylist()]

    a, b = filter_audit._digest(1, "a"), filter_audit._digest(2, "b")
    assert run() == []
    assert sorted(run((1, 1, "a"), (2, 1, "a"), (2, 2, "b"), (3, 2, "b"))) == [(1, "p", 0, a), (2, "p", 0, b), (2, "p", 16, a), (3, "p", 16, None)]
    # the least id of the last group is an edge even where rows without one come before it
    assert sorted(run((1, 1, None), (None, 2, "b"), (5, 2, "b")), key=str) == sorted([(1, "p", 0, filter_audit._digest(1, None)), (None, "p", 0, None), (5, "p", 0, b)], key=str)


def test_counters_of_parts_of_a_table_add_up(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "ab"[i % 2], 0) for i in range(40)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(40)], LABELS)
    whole = {r.part: r for r in filter_audit.counters(filter_audit.masks(docs), labels).collect()}
    halves = [{r.part: r for r in filter_audit.counters(filter_audit.masks(docs.where(f"doc_id % 4 {op} 1")), labels).collect()} for op in ("<=", ">")]
    for part, row in whole.items():
        for c in ("n", "good", "toxic"):
            assert row[c] == [x + y for x, y in zip(*(h[part][c] for h in halves), strict=True)]


def test_empty_tables_and_the_query(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.interactions(docs, labels).count() == 0
    assert compare(spark, filter_audit.op13_filter_audit, filter_audit.OP13_SQL) % 600 == 0
