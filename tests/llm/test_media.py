from __future__ import annotations

import hashlib
import zlib

import pytest
from prismlake.llm import media

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_texts_come_back_from_byte_ranges(spark, tmp_path):
    texts = ["", None, "a" * 64, "a" * 65, "é😀\0x", "long " * 60_000] + [f"document {i} " * (i % 50) for i in range(300)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0), (None, "b", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS payload", "1 AS n_bytes", "2 AS media")
    found = media.store(docs, f"file://{tmp_path}/a", archiveBytes=20_000, rangeBytes=3_000)
    assert found.rdd.getNumPartitions() > 20
    got = found.collect()
    assert len(got) == len(rows) and len({(r.archive, r.offset) for r in got}) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in [*enumerate(texts), (None, "b")]:
        raw = (text or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert bytes(by[i].payload) == want and by[i].n_bytes == len(raw) and media.from_png(bytes(by[i].media)) == want
    assert media.store(docs.where("false"), f"file://{tmp_path}/none").count() == 0


def test_the_query_returns_its_digests(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["", "x" * 64, "x" * 100, "same", "same"])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    by = {r.doc_id: r for r in media.op10_media_columns(spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        want = text.encode().ljust(max(64, -(-len(text) // 64) * 64), b"\0")
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert by[3][1:] == by[4][1:]


def test_a_member_is_tried_again_by_its_offset(tmp_path):
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", b"one")
        z.writestr("b", b"two")
    at = zipfile.ZipFile(held).infolist()[1]
    tried = []

    def open_file():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("gone")
        return io.BytesIO(held.getvalue())

    assert media.member(open_file, at.header_offset, at.compress_size, at.CRC, wait=0) == b"two" and len(tried) == 3
    with pytest.raises(ValueError):
        media.member(lambda: io.BytesIO(held.getvalue()), at.header_offset, at.compress_size, at.CRC + 1, wait=0)
    damaged = bytearray(media.to_png(b"x" * 64))
    damaged[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(damaged))


def test_every_part_of_a_payload_moves_the_gradient_hash():
    plain = bytes([100]) * 7200
    bits = lambda payload: media.feature(payload).rsplit(",", 1)[1]
    assert bits(plain) == "0" * 16
    hashes = [bits(plain[: 100 * k] + b"\xc8" * 100 + plain[100 * (k + 1) :]) for k in range(1, 72)]
    assert all(h != "0" * 16 for k, h in enumerate(hashes, 1) if k % 9)
    assert bits(plain[:7100] + b"\xc8" * 100) == f"{1:016x}"
