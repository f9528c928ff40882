from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from prismlake import ordering
from prismlake.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(2)
    words = ["the", "Thntblere", "été", "don't", "x=1", "  ", "\n", "\t", "😀", "", "a\n\nb", "\xa0", " x", "!!", "\x1c", "\0", "中文", "٣4", "'s", "<|endoftext|>", "á"]
    return ["", None, " ", "  ", "a", " a", "a ", "one two"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(300)] + ["lorem ipsum dolor " * 9000]


def test_ids_are_those_of_the_tokenizer():
    plain = Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))
    encoder = packing.Encoder(str(public_tokenizers.path(packing.VOCABULARY)))
    rng = random.Random(9)
    spaces = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000\u200b\ufeff\u180e"
    odd = ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x30000), rng.randrange(128)])) if rng.random() < 0.7 else rng.choice(spaces) for _ in range(60)) for _ in range(1500)]
    for text in [*(t or "" for t in texts()), *odd, "a<|endoftext|>b", "<|end"]:
        assert np.frombuffer(encoder(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_patterns_hold_the_histogram():
    rng = random.Random(4)
    for capacity in (8, 64, 2048):
        histogram = {k: rng.randrange(1, 500) for k in rng.sample(range(1, capacity + 1), min(capacity, 200))}
        patterns, _ = packing.shortest_pack_first(histogram, capacity)
        held = defaultdict(int)
        for count, runs in patterns:
            assert sum(k * n for k, n in runs) <= capacity
            for k, n in runs:
                held[k] += count * n
        assert held == histogram and len(patterns) <= 3 * capacity
    assert packing.shortest_pack_first({}, 8) == ([], 0)


def test_each_id_lies_in_one_piece_and_sequences_have_no_gap(spark):
    plain = Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))
    all_ = texts()
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(all_)] + [(0, "a", "en", "a", 0), (None, "b c", None, None, None), (None, "b c", None, None, None)]
    found = packing.pack(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "2 AS bin")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in enumerate(all_):
        if i == 0:
            continue
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len(by_doc[0]) == 2 and len(by_doc[None]) == 2
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_repeated_as_they_are_are_packed_each(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES", 50)
    docs = spark.createDataFrame([(None, "b c", "en", "a", 0)] * 3000 + [(1, "b c", "en", "a", 0)] * 9, SCHEMA)
    found = packing.pack(docs).collect()
    assert len(found) == 3009 and sum(r.doc_id is None for r in found) == 3000
    length = found[0].length
    assert len({(r.sequence_id, r.offset) for r in found}) == 3009 and all(r.length == length and r.offset % length == 0 and r.offset + length <= 2048 for r in found)
    assert len({r.sequence_id for r in found}) == -(-3009 // (2048 // length))
