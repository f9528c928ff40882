from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from prismlake import ordering
from prismlake.llm import vector_codes
from prismlake.llm.vector_codes import Codebook

from ..oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, parts=4, rounds=4):
    """Counter of (vec_id, code, error, label_error), and the digest, by plain loops over Python's numbers."""
    good = [(i, [math.floor(np.float32(x).item() * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) if good else 0
    top = vector_codes.limit(width)
    odd = [r for r in good if len(r[1]) != width or any(abs(x) > top for x in r[1])]
    good = [r for r in good if len(r[1]) == width and all(abs(x) <= top for x in r[1])]
    cut = [p * width // parts for p in range(parts + 1)]
    part = lambda v, p: v[cut[p] : cut[p + 1]]
    books = [[part(r[1], p) for r in good[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(part(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in good]
    for _ in range(rounds):
        held = defaultdict(list)
        for (_, v, _), found in zip(good, assign(), strict=True):
            for p, (_, e) in enumerate(found):
                held[p, e].append(part(v, p))
        for (p, e), own in held.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    coded = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), label) for (i, _, label), f in zip(good, assign(), strict=True)]
    errors = Counter()
    for _, _, error, label in coded:
        errors[label] += error
    out = Counter((i, code, error, errors[label]) for i, code, error, label in coded) + Counter((i, None, None, None) for i, _, _ in odd)
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def check(spark, rows, **settings):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS error", "3 AS key", "4 AS ints")
    found = vector_codes.compress(table, **settings).collect()
    want, digest = brute(rows, **settings)
    assert Counter((r.vec_id, r.code.hex() if r.code is not None else None, r.error, r.label_error) for r in found) == want
    assert {r.codebooks_sha256 for r in found} <= {digest}


@pytest.mark.parametrize("width", [8, 6, 3, 0])
def test_codes_agree_with_brute_force(spark, monkeypatch, width):
    """Nulls, numbers that aren't finite or too large, other widths, ties, repeated rows; widths that parts don't divide."""
    monkeypatch.setattr(ordering, "LEAST", 7)
    rng = random.Random(width)
    vector = lambda: [rng.choice([rng.uniform(-1, 1), float(rng.randint(-2, 2)), 0.0]) for _ in range(width)]
    rows = [(i, vector(), rng.choice([1, 2, None])) for i in range(300)]
    rows += rows[:30] + [rows[5]] * 20 + [(None, vector(), 3), (None, vector(), None), (7, vector(), 1), (400, None, 1), (401, [0.5] * (width + 1), 2)]
    if width:
        rows += [(-5, [None] + vector()[1:], 1), (402, [math.nan] * width, 1), (403, [math.inf] * width, 1), (404, [-math.inf] * width, 1), (405, [1e30] * width, 1), (406, [-1e6] * width, 1)]
    check(spark, rows)
    check(spark, rows[:120], entries=5, parts=2)


def test_fewer_rows_than_entries_and_none(spark):
    check(spark, [(3, [1.0, 2.0, 3.0, 4.0], None), (1, [0.0, 0.0, 0.0, -0.0001], 1), (2, [9.0, 0.0, 0.0, 0.0], 1)])
    check(spark, [])
    check(spark, [(1, None, 1), (2, [None, 1.0], 1)])
    with pytest.raises(ValueError, match="one byte"):
        vector_codes.compress(spark.createDataFrame([], SCHEMA), entries=257)


@pytest.mark.parametrize("scale", [1, 50, 1_000_000, 1 << 27])
def test_the_annulus_loses_nothing(scale):
    """Nearest entries and ties are those of all comparisons; far fewer are made where norms differ."""
    rng = np.random.default_rng(scale)
    spread = rng.uniform(0, 1, (600, 1)) ** 3
    parts = (rng.normal(size=(600, 8)) * spread * scale / 8).astype(np.int64)
    entries = np.concatenate([parts[:200], parts[:20], -parts[20:40], np.zeros((16, 8), np.int64)])
    book = Codebook(entries)
    code, best, compared = book.nearest(parts)
    exact = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, c, strict=True)) for c in entries] for p in parts[:150]]
    assert [min((d, i) for i, d in enumerate(row)) for row in exact] == list(zip(best[:150].tolist(), code[:150].tolist(), strict=True))
    everything = book.distances(parts, np.arange(len(entries)))
    assert (everything.argmin(axis=1) == code).all() and (everything.min(axis=1) == best).all()
    if scale > 1:
        assert compared < 0.7 * everything.size


def test_codes_stand_for_vectors_within_their_error(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(100)]
    table = vector_codes.whole_numbers(spark.createDataFrame(rows, SCHEMA))
    books = vector_codes.fit(table, 8, entries=16)
    ints = {r.vec_id: r.ints for r in table.collect()}
    for r in vector_codes.encode(table, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(ints[r.vec_id], vector_codes.decode(r.code, books), strict=True)) == r.error


def test_the_query_agrees_with_its_sql(spark):
    assert compare(spark, vector_codes.op11_vector_codes, vector_codes.OP11_SQL) == 500
