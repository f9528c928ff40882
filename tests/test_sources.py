from __future__ import annotations

import json
import struct

import pytest
from prismlake.config import GroupingConfig
from prismlake.functions import headers
from prismlake.operators import sync
from prismlake.sources import contract, library, local, server


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", width, height) + b"\x08\0\0\0\0"


def tiff(order):
    text = b"2024:01:02 03:04:05\0"
    entries = [(0x0112, 3, 1, struct.pack(order + "HH", 6, 0)), (0x0132, 2, len(text), struct.pack(order + "I", 100)), (0x829A, 5, 1, struct.pack(order + "I", 130)), (0x8769, 4, 1, struct.pack(order + "I", 150)), (0x9999, 7, 3, b"abcd")]
    body = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", *e[:3]) + e[3] for e in entries)
    raw = ((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body).ljust(100, b"\0") + text
    raw = raw.ljust(130, b"\0") + struct.pack(order + "II", 1, 250)
    return raw.ljust(150, b"\0") + struct.pack(order + "H", 1) + struct.pack(order + "HHI", 0x9003, 2, 4) + b"abc\0"


def jpeg(order):
    app = b"Exif\0\0" + tiff(order)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\0" * 4


def test_headers_of_images():
    want = {"exif_Orientation": "6", "exif_DateTime": "2024:01:02 03:04:05", "exif_ExposureTime": "1/250", "exif_DateTimeOriginal": "abc"}
    for order in "<>":
        assert headers.header(jpeg(order)) == want | {"format": "JPEG", "dimensions": "640x480"}
        assert headers.header(tiff(order)) == want | {"format": "TIFF"}
    assert headers.header(png(3, 4)) == {"format": "PNG", "dimensions": "3x4"}
    for broken in (None, b"", b"text", b"\xff\xd8", png(1, 1)[:12], jpeg("<")[:30], b"II*\0", b"GIF89a"):
        assert "error" in headers.header(broken) or headers.header(broken) == {"format": "TIFF"}


def test_a_folder_as_a_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(5, 6))
    (tmp_path / "in" / "b.jpg").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("x")
    source = contract.open_source(spark, "local", str(tmp_path))
    photos = source.list_photos()
    assert sorted(r.photo_id for r in photos.collect()) == ["in/a.png", "in/b.jpg"] and source.list_photos("video").count() == 0
    meta = {r.photo_id: r.metadata for r in source.metadata(photos).collect()}
    assert meta["in/a.png"]["dimensions"] == "5x6" and meta["in/a.png"]["filename"] == "a.png" and "error" in meta["in/b.jpg"]
    assert {r.photo_id: bytes(r.content) for r in source.photo_data(photos.limit(1)).collect()} == {"in/a.png": png(5, 6)}
    assert source.people().count() == source.faces().count() == source.photos_by_person().count() == 0
    with pytest.raises(ValueError, match="no source"):
        contract.open_source(spark, "cloud", "x")


def test_pages_end_with_the_first_short_one(spark, tmp_path):
    item = lambda i, kind="IMAGE", **more: {"id": f"x{i}", "type": kind, "originalFileName": f"{i}.jpg", "originalPath": f"/p/{i}.jpg"} | more
    pages = [[item(1), item(2, isArchived=True)], [item(3, "VIDEO"), item(4, people=[{"id": "u1", "name": "Zoé"}], isFavorite=True)], [item(5)], [item(6), item(7)]]
    (tmp_path / "pages.json").write_text("\n".join(json.dumps({"page": i, "size": 2, "assets": {"items": p}}) for i, p in enumerate(pages)))
    source = contract.open_source(spark, "server", str(tmp_path))
    found = source.list_photos()
    assert [r.photo_id for r in found.orderBy("photo_id").collect()] == ["x1", "x4", "x5"]
    assert [r.photo_id for r in source.list_photos(limit=2).orderBy("photo_id").collect()] == ["x1", "x4"]
    assert [r.photo_id for r in source.list_photos("video").collect()] == ["x3"]
    assert [tuple(r) for r in source.people().collect()] == [("u1", "Zoé")] and [tuple(r) for r in source.photos_by_person().collect()] == [("u1", "x4")]
    assert {r.photo_id: r.metadata["filepath"] for r in source.metadata(found).collect()} == {f"x{i}": f"/p/{i}.jpg" for i in (1, 4, 5)}
    assert server.items(server.read_pages(spark, str(tmp_path)).where("false")).count() == 0


def test_a_library_as_a_source(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.jpg").write_bytes(b"original")
    (tmp_path / "o" / "t.jpg").write_bytes(b"small")
    path = lambda name: f"{tmp_path}/o/{name}"
    rows = [(1, "u1", "a.jpg", path("a.jpg"), [], ["Zoé", "_UNKNOWN_"], True, ["s"]), (2, "u2", "b.jpg", None, ["", path("gone.jpg"), path("t.jpg")], [None], True, []), (3, "u3", "c.jpg", None, [], [], True, []), (4, "u4", "d.mov", path("a.jpg"), [], [], False, [])]
    base = spark.createDataFrame(rows, "ord long, uuid string, original_filename string, path string, derivatives array<string>, persons array<string>, isphoto boolean, duplicates array<string>")
    more = base.selectExpr(
        "*", "NOT isphoto AS ismovie", "CASE ord WHEN 1 THEN timestamp '2020-01-15' END AS date", "'t' AS title", "'d' AS description", "array('k') AS keywords", "array('trip') AS albums", "true AS favorite", "false AS hidden",
        "1.0D AS latitude", "2.0D AS longitude", "'public.jpeg' AS uti", "named_struct('overall', 0.5D, 'curation', 0.25D) AS score", "false AS burst", "false AS burst_key_photo",
    )
    more.write.parquet(str(tmp_path / "table"))
    source = contract.open_source(spark, "library", str(tmp_path / "table"), root=str(tmp_path / "o"))
    photos = source.list_photos()
    assert sorted(r.photo_id for r in photos.collect()) == ["u1", "u2"] and source.list_photos("video").count() == 1
    assert {r.photo_id: bytes(r.content) for r in source.photo_data(photos).collect()} == {"u1": b"original", "u2": b"small"}
    meta = {r.photo_id: r.metadata for r in source.metadata(photos).collect()}
    assert json.loads(meta["u1"]["persons"]) == ["Zoé"] and meta["u1"]["duplicate_group"] == "s" and [r.name for r in source.people().collect()] == ["Zoé"]
    assert len(library.scan(more).schema["metadata"].dataType) == 19
    from pyspark.sql import functions as F

    dated = library.scan(more, "trip", start=F.lit("2021-01-01").cast("timestamp"), local_only=False)
    assert [r.photo_id for r in dated.collect()] == ["u2"] and library.scan(more, "none").count() == 0 and library.scan(more).count() == 1


def test_a_run_resumes_only_its_own_state(spark, tmp_path):
    own, other = (local.fingerprint("local", "/p", GroupingConfig(threshold=t)) for t in (5, 6))
    path = str(tmp_path / "state")
    assert local.resume(spark, path, own) is None
    local.write_state(spark.createDataFrame([(2, [1, 2], own)], "version int, completed_groups array<long>, fingerprint string"), path)
    assert local.resume(spark, path, own).first().completed_groups == [1, 2]
    with pytest.raises(ValueError, match="other settings"):
        local.resume(spark, path, other)


def test_features_are_added_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(f"p{i}", i) for i in range(10)], "photo_id string, h long")
    assert sync.append_features(rows.where("h < 6"), path).count() == 6
    found = sync.append_features(rows.withColumn("h", rows["h"] + 100), path)
    assert sorted((r.photo_id, r.h) for r in found.collect()) == sorted((f"p{i}", i if i < 6 else i + 100) for i in range(10))
