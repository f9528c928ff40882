from __future__ import annotations

import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict

import pytest
from prismlake import ordering
from prismlake.llm import warc
from prismlake.llm.warc import LoserTree
from pyspark.sql import functions as F

from ..oracle import compare

SCHEMA = "page_id long, url string, html string"


def low(x):
    return (x is not None, x if x is not None else 0)


def brute(rows):
    """Counter of (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    groups = defaultdict(list)
    out = Counter()
    for page_id, url, html in rows:
        payload = (html or "").encode()
        groups[payload].append((low(page_id), (url is not None, url or "")))
    for payload, own in groups.items():
        digest = hashlib.sha1(payload).hexdigest()
        (_, last), _ = max(own)
        last = None if not max(own)[0][0] else last
        for k, ((some, page_id), _) in enumerate(sorted(own, reverse=True)):
            again = len(payload) >= 1000 and k > 0
            out[page_id if some else None, len(payload), digest, "revisit" if again else "response", last if again else None] += 1
    return out


def pages(rng, n=200):
    texts = ["", None, "short", "é" * 499, "é" * 500, "b" * 999, "b" * 1000, "<html>\r\n\r\nWARC/1.1\r\n" * 60, "long " * 400_000, *(f"page {i} " * 200 for i in range(20))]
    urls = [None, "", "http://A.example.com:80/X?b=1#top", "https://u@a.example.com/x?b=1", "//b.org", "http://c.org/é %41\r\nx", "mailto:x", *(f"http://h{i % 3}.org/{i}" for i in range(20))]
    rows = [(rng.choice([None, -5, *range(60)]), rng.choice(urls), rng.choice(texts)) for _ in range(n)]
    return [*rows, *rows[:25], *([rows[3]] * 15), *([(None, None, "n" * 2000)] * 4), (1 << 62, "http://z.org", "z" * 1000), (3, "http://z.org", "z" * 1000)]


@pytest.mark.parametrize(("keys", "size"), [(1_000_000, 32 << 20), (0, 2_000)])
def test_records_and_histories_agree_with_brute_force(spark, monkeypatch, tmp_path, keys, size):
    """Nulls, repeated rows, ties, odd URLs, long pages; also with keys too many to be sent, and an archive for each few records."""
    monkeypatch.setattr(warc, "KEYS", keys)
    monkeypatch.setattr(warc, "RANGE", size)
    monkeypatch.setattr(ordering, "LEAST", 7)
    rows = pages(random.Random(keys))
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("page_id", "url", "coalesce(page_id, 0) % 7 AS at", "encode(coalesce(html, ''), 'UTF-8') AS payload", "1 AS digest", "2 AS n", "3 AS _key", "4 AS archive")
    found = warc.histories(table, str(tmp_path / "warc"), archiveBytes=size).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == brute(rows)
    assert Counter(r.url for r in found) == Counter(url for _, url, _ in rows)
    found.sort(key=lambda r: r.position)
    assert [r.position for r in found] == list(range(1, len(rows) + 1))
    keys = [(r.url_key, r["at"], low(r.page_id), r.payload_digest, r.record_type) for r in found]
    assert keys == sorted(keys)
    seen = Counter()
    for r in found:
        seen[r.url_key] += 1
        assert r.capture == seen[r.url_key]


def test_url_keys(spark):
    want = {
        "http://A.example.com:80/X?b=1#top": "com,example,a)/x?b=1", "https://u@a.example.com/x?b=1": "com,example,a)/x?b=1", "//b.org": "org,b)/", "http://b.org?q": "org,b)/?q", "mailto:X": "mailto:x", "": "", None: "",
    }
    table = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: r.key for r in table.select("url", warc.url_key(F.col("url")).alias("key")).collect()} == want


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 61])
def test_a_tree_of_losers_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
    assert list(LoserTree([iter([(x,) for x in r]) for r in runs])) == [(x,) for x in sorted(x for r in runs for x in r)]


def test_runs_are_ascending_stretches():
    assert warc._runs([]) == []
    assert [list(r) for r in warc._runs([(1,), (2,), (2,), (1,), (0,), (5,)])] == [[0, 1, 2], [3], [4, 5]]


def test_records_round_trip_and_damage_is_found():
    payload = b"a\r\n\r\nb" * 200
    digest = hashlib.sha1(payload).digest()
    raw = warc.record(-3, "http://x.org/é %0A\n", 0, payload, len(payload), digest, False, None)
    found = warc.parse(raw)
    assert found["payload"] == payload and found["url"] == "http://x.org/é %0A\n" and found["page_id"] == -3 and found["payload_digest"] == digest.hex()
    revisit = warc.parse(warc.record(None, None, 5, b"", len(payload), digest, True, 9))
    assert revisit["refers_to"] == 9 and revisit["payload_bytes"] == len(payload) and revisit["page_id"] is None and revisit["url"] is None
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"a\r\n\r\nb", b"c\r\n\r\nb", 1))
    with pytest.raises(ValueError, match="not a WARC"):
        warc.parse(b"x" + raw)


def test_archives_are_read_member_by_member():
    parts = [b"x" * 5_000, b"", b"yz" * 10_000]
    zipped = [gzip.compress(p) for p in parts]
    for step in (1, 17, 1 << 20):
        found = list(warc.members(io.BytesIO(b"".join(zipped)), step))
        assert [p for _, p in found] == parts
        assert [at for at, _ in found] == [0, len(zipped[0]), len(zipped[0]) + len(zipped[1])]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(io.BytesIO(b"".join(zipped)[:-3])))


def test_the_index_reads_a_record_by_its_offset(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", f"body {i} " * 300) for i in range(20)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("page_id", "url", "page_id AS at", "encode(html, 'UTF-8') AS payload")
    for r in warc.histories(table, str(tmp_path / "warc"), archiveBytes=4_000).collect():
        with open(tmp_path / "warc" / r.archive, "rb") as f:
            f.seek(r.offset)
            _, raw = next(warc.members(f))
        assert warc.parse(raw)["payload"].decode() == rows[r.page_id][2]


def test_empty_tables_and_the_query(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA).selectExpr("page_id", "url", "page_id AS at", "encode(html, 'UTF-8') AS payload")
    assert warc.histories(empty, str(tmp_path / "none")).count() == 0
    assert compare(spark, warc.op12_warc_index, warc.OP12_SQL) == 50
