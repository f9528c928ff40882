from __future__ import annotations

import struct

import pytest
from prismlake.functions import containers
from prismlake.sources import contract


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode()) + body


def video(frames=90, delta=1001, scale=30_000, media=5_000_000, first=True):
    entry = struct.pack(">I4s", 86, b"avc1") + b"\0" * 24 + struct.pack(">HH", 640, 480) + b"\0" * 50
    stbl = box("stbl", box("stsd", b"\0" * 4, struct.pack(">I", 1), entry), box("stts", b"\0" * 4, struct.pack(">III", 1, frames, delta)))
    mdia = box("mdia", box("mdhd", b"\0" * 12, struct.pack(">II", scale, frames * delta), b"\0" * 4), box("hdlr", b"\0" * 8, b"vide", b"\0" * 12), box("minf", stbl))
    moov = box("moov", box("mvhd", b"\0" * 100), box("trak", mdia))
    mdat = box("mdat", b"\0" * media)
    return box("ftyp", b"isom") + (mdat + moov if first else moov + mdat)


@pytest.mark.parametrize("first", [True, False])
def test_only_headers_and_tables_are_read(first):
    raw, read = video(first=first), []

    def part(at, n):
        read.append(n)
        return raw[at : at + n]

    found = containers.probe(part, len(raw))
    assert found["frames"] == 90 and (found["width"], found["height"], found["codec"]) == (640, 480, "avc1")
    assert abs(found["fps"] - 30_000 / 1001) < 1e-9 and abs(found["duration"] - 90 * 1001 / 30_000) < 1e-9
    assert sum(read) < 1_000


def test_damaged_files_give_an_error():
    raw = video(media=100)
    info = lambda x: containers._info(lambda at, n: x[at : at + n], len(x))
    assert info(raw)["error"] is None
    for n in range(0, len(raw), 3):
        assert info(raw[:n])["error"], n
    for at in range(120, len(raw)):
        info(raw[:at] + b"\xff" + raw[at + 1 :])  # whatever it says, it ends
    assert info(struct.pack(">I4s", 3, b"moov"))["error"] and info(box("moov", box("trak")))["error"] and info(b"no video at all" * 9)["error"]
    assert info(video(frames=0, media=0))["duration"] == 0


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(video())
    (tmp_path / "b.mp4").write_bytes(b"text")
    paths = [str(tmp_path / "a.mp4"), f"file://{tmp_path}/b.mp4", str(tmp_path / "none.mp4")]
    found = {r.path: r for r in containers.probed_files(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert found[paths[0]].frames == 90 and found[paths[0]].error is None and found[paths[1]].error and found[paths[2]].error
    none = containers.probed(spark.createDataFrame([(1, None), (2, bytearray(video(media=9)))], "i long, content binary"), "i")
    assert {r.i: r.frames for r in none.collect()} == {1: None, 2: 90}


def test_a_folder_as_a_source_of_videos(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.mp4").write_bytes(video(frames=60))
    source = contract.open_source(spark, "local", str(tmp_path), store=str(tmp_path) + "-store")
    found = source.video_info(source.list_photos("video")).collect()
    assert [(r.photo_id, r.frames, r.error) for r in found] == [("x/a.mp4", 60, None)]
    plan = spark.createDataFrame([(1, "add_tag", "t", "x/a.mp4"), (1, "add_tag", "t", "gone")], "step int, action string, value string, target string")
    assert [r.target for r in source.apply(plan, "r").collect()] == ["gone"] and [(r.asset_id, r.tags) for r in source.done().collect()] == [("x/a.mp4", ["t"])]
