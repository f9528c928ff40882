from __future__ import annotations

import random
import re

import pytest
import xxhash
from prismlake import ordering
from prismlake.llm import graph, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(ids))]


def test_fingerprints_agree_with_brute_force():
    rng = random.Random(6)
    texts = [None, "", " \n", "One", "a B c", "a b c d", "É x\x1cy z"] + [" ".join(rng.choice("aBcdEFghÉ") * rng.randrange(1, 4) for _ in range(rng.randrange(80))) for _ in range(200)]
    for text in texts:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [500, 3])
def test_links_connect_exactly_what_is_near(spark, monkeypatch, hot):
    monkeypatch.setattr(ordering, "LEAST", hot)
    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 1, (1 << 64) - 1, 0b11111, 0b1111100000, 1 << 63} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    label = {r.node: r.label for r in graph.components(edges).collect()}
    want = brute_components(signed, fps)
    linked = {x for i, x in enumerate(fps) for j, y in enumerate(fps) if i != j and (x ^ y).bit_count() <= 4}
    emitting = {r.fp for r in simhash.candidates(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps)).collect()}
    assert {x - (1 << 64) if x >> 63 else x for x in linked} <= emitting
    assert [label.get(s, s) for s in signed] == want


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 502), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in graph.components(edges).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys((500, 501, 502), 500)}
    assert graph.components(edges.where("false")).count() == 0


def documents(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows = []
    for g in range(20):
        base = [rng.choice(words) for _ in range(200)]
        for k in range(rng.choice([1, 2, 12])):
            text = list(base)
            for _ in range(k % 3):
                text[rng.randrange(200)] = "zzz"
            rows.append((len(rows) + 100, " ".join(text), "en", "s", g))
    rows += [(5, "", "en", "s", 0), (6, None, None, None, None), (7, "one", "en", "s", 0), (8, "ONE", "en", "s", 0), (7, "one", "en", "s", 0), (None, "solo row", "en", "s", 0), (None, "solo row", "en", "s", 0), (None, "one", "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS fp", "1 AS component_id", "2 AS text_key", "3 AS _key", "4 AS _id", "5 AS _stays", "6 AS _row", "7 AS _other"), rows


def test_groups_agree_with_brute_force_and_one_of_each_stays(spark):
    docs, rows = documents(spark)
    want = brute_components([r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows])
    found = simhash.groups(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, str(r.component_id)) for r in found) == sorted((r[0] is None, r[0] or 0, str(w)) for r, w in zip(rows, want, strict=True))
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns
    ids = [r.doc_id for r in stay.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({w for w in want if w is not None}) and ids.count(None) == 1
    assert simhash.groups(docs.where("false")).count() == 0 and simhash.one_of_each(docs.where("false")).count() == 0


def test_the_filter_of_fingerprints_loses_no_link(spark, monkeypatch):
    """Components are the same if every fingerprint emits its ball."""
    rng = random.Random(11)
    bases = [rng.getrandbits(64) for _ in range(12)]
    prints = {b for b in bases} | {rng.getrandbits(64) for _ in range(40)}
    for b in bases:
        for n in (1, 2, 3, 4, 4, 5, 6):
            x = b
            for k in rng.sample(range(64), n):
                x ^= 1 << k
            prints.add(x)
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in sorted(prints)], "fp long")
    found = []
    for every in (False, True):
        if every:
            monkeypatch.setattr(simhash, "candidates", lambda distinct, n, keep=None: distinct)
        labels = {r.node: r.label for r in simhash.components(simhash.links(distinct)).collect()}
        found.append(labels)
    assert found[0] == found[1] and len(found[0]) > 50
