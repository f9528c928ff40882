from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from prismlake import ordering
from prismlake.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts):
    """For each text: removed bytes, spans and the digest of the rest."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        keep = np.frombuffer(r, np.uint8)[~gone[1:-1]].tobytes()
        out.append((len(r), len(r) - len(keep), spans, hashlib.sha256(keep).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 1 else "abcdefgh é\n"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [some(rng.randrange(150, 900)) for _ in range(8)]
    texts = [None, "", "x", some(199), "a" * 1000, "a" * 199, "ab" * 300, "a" * 700 + some(50) + "a" * 230]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(base)
            lo = rng.randrange(len(b))
            parts += [some(rng.randrange(300)), b[lo : lo + rng.randrange(500)]]
        texts.append("".join(parts))
        if i % 9 == 0:
            texts.append(texts[-1])
        if i % 7 == 0 and texts[-1]:
            t = list(texts[-1])
            for _ in range(3):
                t[rng.randrange(len(t))] = "Z"
            texts.append("".join(t))
    return texts


def test_triggers_partition_the_starts_and_depend_on_content_alone():
    rng = random.Random(5)
    for raw in [b"a" * 900, bytes(rng.choice(b"ab") for _ in range(3000)), bytes(rng.randrange(256) for _ in range(5000)), b"abc" * 500]:
        h = sd.Hashes(raw)
        rows = sd.triggers(raw, h)
        owner = {i: t for t, low, high in rows.tolist() for i in range(low, high + 1)}
        assert sorted(owner) == [*range(len(raw) - 199)] and sum(high - low + 1 for _, low, high in rows.tolist()) == len(owner)
        hashes = h.of(np.arange(len(raw) - 15), np.arange(16, len(raw) + 1))
        assert all(t == i + int(np.argmin(hashes[i : i + sd.WIDTH])) for i, t in owner.items())
        assert sd._unpacked(sd._packed(rows)).tolist() == rows.tolist()


@pytest.mark.parametrize("block", [500, 4, 1])
def test_classes_are_those_of_equal_beginnings(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "RANGE", 7)
    monkeypatch.setattr(sd, "BLOCK", block)
    rng = random.Random(6)
    strings = sorted({bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(9))) for _ in range(300)})
    found = {bytes(r.s): r.stack for r in sd.classes(spark.createDataFrame([(bytearray(x),) for x in strings], "s binary")).collect()}
    assert len(found) == len(strings)
    for n in range(9):
        of = lambda x: [e.start for e in found[x] if e.depth < n][-1]  # noqa: B023, E731
        long = [x for x in strings if len(x) >= n]
        starts = {}
        assert all(starts.setdefault(x[:n], of(x)) == of(x) for x in long) and len(set(starts.values())) == len(starts)


@pytest.mark.parametrize("seed, small", [(1, False), (2, False), (3, True)])
def test_what_is_removed_agrees_with_brute_force(spark, tmp_path, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(sd, "RANGE", 50)
        monkeypatch.setattr(sd, "BLOCK", 3)
        monkeypatch.setattr(sd, "KEYS", 0)
        monkeypatch.setattr(ordering, "LEAST", 5)
    texts = corpus(seed)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS removed", "1 AS core", "2 AS _uid", "3 AS _spans").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in sd.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, want in enumerate(brute(texts)):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == want, (i, texts[i])


def test_repeated_rows_repeat_each_other_and_empty_tables_pass(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (1, text, "en", "s", 0), (None, text[:250], "en", "s", 0), (None, "short", None, None, None)], SCHEMA)
    found = sd.remove_repeats(docs).collect()
    assert sorted(bytes(r.kept_bytes) for r in found) == [b"", b"", b"", b"short"]
    assert sd.remove_repeats(docs.where("false")).count() == 0


@pytest.mark.parametrize(("keys", "least"), [(1_000_000, 500), (0, 5)])
def test_mixed_repeats_agree_with_brute_force(spark, tmp_path, monkeypatch, keys, least):
    """Rows equal in id and text, also of a null id, beside equal texts of other ids and texts that have parts of them."""
    monkeypatch.setattr(sd, "KEYS", keys)
    monkeypatch.setattr(ordering, "LEAST", least)
    texts = corpus(2)
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(20)]), rng.choice(texts)) for _ in range(60)]
    rows += rows[:20] + [(None, texts[20])] * 9 + [(None, None)] * 3 + [(5, "short")] * 4
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op5_suffix_dedup(spark, str(tmp_path)).collect())
    assert found == Counter((i, *want) for (i, _), want in zip(rows, brute([t for _, t in rows]), strict=True))


def test_long_texts_agree_with_brute_force(spark, tmp_path):
    """Of half a megabyte: a few bytes over and over, and text with a part of another."""
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefgh \n") for _ in range(400_000))
    texts = ["abcdef" * 60_000, "x" * 300_000, letters, letters[1_000:1_500] + "y" * 250 + letters[300_000:300_199], "abcdef" * 40]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_a_text_leaves_its_task_as_one_row_of_each_kind():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["abcdef" * 10_000, "x" * 5_000, None, "short"])], names=["text"])
    place, _, _, _, times, inside = sd._parsed(batch)
    assert [len(x) for x in place.to_pylist()] <= [40, 20, 0, 0] and sum(times.to_pylist()[0]) > 5_000
    spans = inside.to_pylist()
    assert [len(x) for x in spans] == [1, 1, 0, 0] and spans[0][0]["s"] == spans[1][0]["s"] == 0 and spans[0][0]["e"] > 59_900 and spans[1][0]["e"] > 4_900


def test_very_many_equal_rows_are_one_text(spark):
    """200,000 of one id, and of none: spans stay one run, and rows are joined in parts."""
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))
    docs = spark.range(200_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 END AS doc_id", f"'{text}' AS text").union(spark.range(3).selectExpr("id + 100 AS doc_id", f"concat('other ', id, substr('{text}', 1, 150)) AS text"))
    found = sd.remove_repeats(docs).selectExpr("doc_id", "size(removed) AS spans", "octet_length(kept_bytes) AS n").groupBy("doc_id", "spans", "n").count().collect()
    assert {(r.doc_id, r.spans, r.n, r["count"]) for r in found} >= {(7, 1, 0, 100_000), (None, 1, 0, 100_000), (100, 0, 157, 1)}


def test_texts_that_are_hashed_together_are_parsed_as_each_alone(monkeypatch):
    texts = [*corpus(1), *corpus(2)]
    batch = lambda some: pa.RecordBatch.from_pydict({"text": pa.array(some, pa.string())})
    rows = lambda found: [(sorted(zip(*row[:5], strict=True)), row[5]) for row in zip(*(x.to_pylist() for x in found), strict=True)]
    alone = [rows(sd._parsed(batch([x])))[0] for x in texts]
    made = []
    hashes = sd.Hashes.__init__
    monkeypatch.setattr(sd.Hashes, "__init__", lambda self, raw, which=0: (made.append(len(raw)), hashes(self, raw, which))[1])
    for at_once in (1, 3_000, 1 << 15):
        monkeypatch.setattr(sd, "TOGETHER", at_once)
        assert rows(sd._parsed(batch(texts))) == alone
    made.clear()
    sd._parsed(batch(texts))
    long = [len(x.encode()) for x in texts if x and len(x.encode()) >= 200]
    assert len(made) < len(long) and sum(made) == 2 * sum(long)


def test_pieces_are_those_of_a_loop_over_triggers():
    rng = random.Random(8)
    stack = lambda top: [{"depth": d, "start": rng.randrange(1 << 40)} for d in (-1, *sorted(rng.sample(range(top), rng.randrange(6))))]
    kind = pa.list_(pa.struct([("depth", pa.int64()), ("start", pa.int64())]))
    ends = [sorted((rng.randrange(150), rng.randrange(150))) for _ in range(400)]  # strings begin from near to far bytes before the trigger
    stacks = [(stack(150), stack(200)) for _ in ends]
    place = [(149 + k) << 16 | far << 8 | near for k, (near, far) in enumerate(ends)]
    batch = pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int64()), "phrase_stack": pa.array([p for p, _ in stacks], kind), "parse_stack": pa.array([p for _, p in stacks], kind)})
    found = sd._pieces(batch.slice(3, 390))[0].to_pylist()
    of = lambda entries, n: [x["start"] for x in entries if x["depth"] < n][-1]
    for (near, far), (phrase, parse), pieces in zip(ends[3:393], stacks[3:393], found, strict=True):
        classes = [(of(phrase, n), of(parse, 200 - n)) for n in range(near, far + 1)]
        assert [(p["phrase"], p["parse"]) for p in pieces for _ in range(p["first"], p["last"] + 1)] == classes
        assert (pieces[0]["first"], pieces[-1]["last"]) == (near, far) and len(pieces) == 1 + sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    assert sd._pieces(batch.slice(0, 0))[0].to_pylist() == []
