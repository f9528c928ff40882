from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from prismlake.llm import line_dedup, mixing, packing, quality_rules
from tokenizers import Tokenizer

from .test_mixing import brute_targets
from .test_quality_rules import brute, often, removed
from .test_simhash import brute_components, brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frequent(rows, share, more_than):
    """(source, line) pairs that are in more of the source's rows than the share, and than so many."""
    total, held = Counter(r[2] for r in rows), Counter()
    for _, text, source in rows:
        held.update({(source, x.strip(" \t\r\x0b\x0c").lower()) for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")})
    return {k for k, n in held.items() if n > more_than and n > share * total[k[0]]}


def without(text, source, gone):
    stays = [x for x in (text or "").split("\n") if (source, x.strip(" \t\r\x0b\x0c").lower()) not in gone]
    return text if text is None or len(stays) == text.count("\n") + 1 else "\n".join(stays)


def draw(i, text):
    """The random number of the first row of id i and this text."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = md5(":".join(["mix", f"={i}", md5("=" + text), md5(json.dumps({"lang": "en", "n_chars": len(text)}, separators=(",", ":")))]))
    return (int(md5(f"{key}:0")[:13], 16) + 0.5) / 2**52


def brute_mix(rows):
    words = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    out, goal = [], brute_targets(sizes)
    for source in sizes:
        own = [(i, t, words(t)) for i, t, s in rows if s == source and words(t)]
        by = Counter()
        for _, _, n in own:
            by[16 + n.bit_length()] += n
        full, left = 0, goal[source]
        copies = {}
        for g in sorted(by, reverse=True):
            level = (goal[source] - 3 * full) / sum(k * n for k, n in by.items() if k <= g)
            if level * g >= 3:
                copies[g], full = 3.0, full + by[g]
            else:
                copies |= {k: level * k for k in by if k <= g}
                break
        left -= sum(int(copies[g]) * n for g, n in by.items())
        ranked = []
        for i, text, n in own:
            c = copies[16 + n.bit_length()]
            out += [(i, text, source)] * int(c)
            if c > int(c):
                u = draw(i, text)
                q = (u / (1 - u)) / ((c - int(c)) / (1 - (c - int(c))))
                ranked.append((q / (1 + q), i, text, n))
        held = 0
        for _, i, text, n in sorted(ranked):
            if held + n / 2 <= left:
                out.append((i, text, source))
            held += n
    return out


def test_the_pipeline_agrees_with_brute_force(spark, tmp_path):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(20))
    bodies = [[line() for _ in range(rng.randrange(3, 20))] for _ in range(160)]
    rows = []
    for k, body in enumerate(bodies):
        source = rng.choice(["a", "a", "b", "c", None])
        rows.append((k, "\n".join(["Home | About", *body, "(c) all rights"] if source == "a" else body), source))
    for k in range(40):
        i, text, source = rng.choice(rows[:160])
        rows.append((200 + k, text if k % 2 else text.replace(" ", "  ", 1).upper(), source))
    rows += [(300, "too short", "a"), (301, "again and again " * 60, "b"), (302, None, "a"), (303, "", None), (304, "\n".join([("Promo " + line())] * 4), "c")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    found_lines = often(rows)
    left = []
    for i, text, source in rows:
        n_words, _, _, _, again = brute(text)
        if n_words >= 50 and 100 * again <= 50 * n_words and n_words - removed(text, source, found_lines) >= quality_rules.LEFT * n_words:
            left.append((i, text, source))
    gone = frequent(left, line_dedup.RATIO, line_dedup.PAGES - 1)
    left = [(i, without(t, s, gone), s) for i, t, s in left]
    assert gone or any("Home" not in (t or "") for _, t, s in left if s == "a")
    first = brute_components([r[0] for r in left], [brute_fingerprint(r[1]) for r in left])
    left = [r for r, f in zip(left, first, strict=True) if r[0] == f]
    assert 100 < len(left) < 190
    plain = Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))
    want = Counter()
    for i, text, _ in brute_mix(left):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    spans = defaultdict(list)
    for r in found:
        spans[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 2048 and [o for o, _ in sorted(s)] == list(np.cumsum([0, *(n for _, n in sorted(s))])[:-1]) for s in spans.values())


def test_stages_keep_the_columns_of_documents_and_pass_empty_tables(spark, tmp_path):
    assert mixing.MOST == 3
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_lines_of_a_large_host_are_left_to_line_dedup(spark, tmp_path):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Home | About\n{body(i)}" if i % 2 else body(i), "en", "a", 0) for i in range(400)]
    ruled = corpus_pipeline.quality(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in ruled.collect()) == [r[:2] for r in rows]
    found = corpus_pipeline.lines(spark, ruled, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in found) == [(i, body(i), len(body(i))) for i in range(400)]
