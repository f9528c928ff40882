from __future__ import annotations

import datetime as dt

import pytest
from prismlake import versions
from prismlake.functions import media
from prismlake.operators import batches, frames, matching, people, report, sync
from prismlake.plans import actions
from prismlake.sources import catalogue, local
from pyspark.sql import functions as F


def test_album_names(spark):
    rows = [(1, "2024-05-01", ["Anna", "Zoé!"]), (12345, "unknown", []), (7, "2023-01-02", ["O'Neil-Smith"])]
    df = spark.createDataFrame(rows, "i long, day string, who array<string>")
    names = [r[0] for r in df.select(people.album_name(F.col("day"), F.col("who"), F.col("i"))).collect()]
    assert names == ["Organized-2024-05-01-Anna+Zoé-0001", "Organized-unknown-12345", "Organized-2023-01-02-ONeilSmith-0007"]


def test_favourites_come_first_and_labels_lose_excluded_ones(spark):
    counts = spark.createDataFrame([(1, n, c) for n, c in [("a", 9), ("b", 8), ("c", 7), ("d", 6), ("e", 5), ("f", 4), ("g", 3), ("Fav", 1)]], "group_index long, name string, n long")
    album = [r.name for r in people.album_people(counts, ["Fav"], ["B"]).orderBy("rank").collect()]
    assert album == ["Fav", "a", "c", "d", "e", "f"]
    assert [r.name for r in people.label_people(counts, ["A", "b", "c", "d", "e"]).orderBy("rank").collect()] == ["f"]


def test_people_are_merged_by_composed_name(spark):
    rows = [(" Zoé", 2, False, None, 1), ("Zoé", 3, True, "k", 2), ("Nobody", 0, True, "x", 3)]
    found = people.merged(spark.createDataFrame(rows, "name string, photo_count long, is_favorite boolean, key_photo string, ord long")).collect()
    assert [tuple(r) for r in found] == [("Zoé", 5, True, "k")]


def test_name_lists_lose_comments(spark):
    lines = spark.createDataFrame([(x,) for x in ["# all", "Ann # my aunt", "", "  bob ", "ANN"]], "value string")
    assert sorted(r.name for r in people.parse_names(lines).collect()) == ["ann", "bob"]


def test_null_dates_pass(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2020, 1, 15)), (2, dt.datetime(2024, 6, 20)), (3, None)], "id long, at timestamp")
    low, high = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-12-31 23:59:59").cast("timestamp")
    assert sorted(r.id for r in catalogue.in_dates(rows, "at", low, high).collect()) == [2, 3]


def test_batches_overlap_but_at_the_ends(spark):
    rows = spark.createDataFrame([(dt.datetime(2023, 2, 10, 5),), (dt.datetime(2023, 11, 3),), (dt.datetime(1990, 1, 1),)], "ts timestamp_ntz")
    got = [tuple(map(str, r[1:])) for r in batches.time_batches(rows, 6, 7).orderBy("batch").collect()]
    assert got == [("2023-02-01 00:00:00", "2023-08-07 23:59:59", "2023-02-01 00:00:00", "2023-07-31 23:59:59"), ("2023-07-25 00:00:00", "2023-11-30 23:59:59", "2023-08-01 00:00:00", "2023-11-30 23:59:59")]
    assert batches.time_batches(rows.where("false")).count() == 0


def test_scene_changes_compare_with_the_last_kept_frame(spark):
    rows = [(1, i, [100.0 + 8 * i]) for i in range(30)] + [(2, i, [100.0]) for i in range(12)]
    probe = spark.createDataFrame([(1, 30, 1.0), (2, 12, 1.0), (3, 9, 0.0), (4, 0, 1.0)], "video_id long, frames long, fps double")
    sampled = spark.createDataFrame(rows, "video_id long, position long, histogram array<double>")
    got = frames.key_frames(probe, "scene_change", sampled, most=20, threshold=3.0).collect()
    kept, last = [0], 100.0
    for i in range(1, 30):
        if (last - (100 + 8 * i)) ** 2 / last > 3:
            kept.append(i)
            last = 100 + 8 * i
    assert sorted(r.position for r in got if r.video_id == 1) == kept[:20]
    assert sorted(r.position for r in got if r.video_id == 2) == [0, 5, 10] and {r.video_id for r in got} == {1, 2}
    assert [r.position for r in frames.key_frames(probe, "iframe", most=4).where("video_id = 2").orderBy("position").collect()] == [0, 1, 2, 3]


def test_cascade_prefers_sure_matches(spark):
    files = spark.createDataFrame([(1, "a/x.jpg", 5), (2, "b/y.jpg", 6), (3, "c/z.jpg", 7), (4, "d/w.jpg", 8), (5, "e/w2.jpg", 9)], "ord long, path string, filesize long")
    records = [(1, "A", "a/x.jpg", 1), (2, "B", "upload/b/y.jpg", 1), (3, "B2", "q/y.jpg", 6), (4, "C", "elsewhere/z.jpg", 1), (5, "D1", "m/w.jpg", 1), (6, "D2", "n/w.jpg", 8), (7, "A2", "a/x.jpg", 2)]
    found = matching.cascade_match(files, spark.createDataFrame(records, "ord long, asset_id string, path string, filesize long")).collect()
    assert {r.ord: (r.asset_id, r.step) for r in found} == {1: ("A2", 0), 2: ("B", 1), 3: ("C", 10), 4: ("D2", 11), 5: (None, None)}


def photos(spark):
    rows = [(g, i, f"p{g}{i}", i == 1) for g in (1, 2, 3) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, "group_index long, ordinal long, asset_id string, is_best boolean")


def test_merge_and_split(spark):
    merged = report.merge_groups(photos(spark), [3, 1])
    assert [(r.asset_id, r.ordinal, r.is_best) for r in merged.where("group_index = 1").orderBy("ordinal").collect()] == [("p11", 1, True), ("p12", 2, False), ("p13", 3, False), ("p31", 4, False), ("p32", 5, False), ("p33", 6, False)]
    with pytest.raises(ValueError):
        report.merge_groups(photos(spark), [2, 2])
    split = report.split_group(photos(spark), 2, F.col("ordinal") == 1)
    assert [tuple(r) for r in split.where("asset_id LIKE 'p2%'").orderBy("asset_id").collect()] == [(4, 1, "p21", True), (2, 1, "p22", True), (2, 2, "p23", False)]
    for none in (F.col("ordinal") > 9, F.lit(True)):
        assert sorted(map(tuple, report.split_group(photos(spark), 2, none).collect())) == sorted(map(tuple, photos(spark).collect()))


def test_conflicts_are_decided_for_the_whole_asset(spark):
    schema = "asset_id long, is_favorite boolean, is_archived boolean"
    local_, remote, snap = (spark.createDataFrame(r, schema) for r in ([(1, True, True), (2, True, False), (3, None, False)], [(1, False, True), (2, False, False), (3, True, None)], [(1, None, False), (2, False, False), (3, False, False)]))
    changed = sync.changes(local_, remote, snap)
    assert {(r.asset_id, r.field): r.conflict for r in changed.collect()} == {(1, "is_favorite"): True, (1, "is_archived"): False, (2, "is_favorite"): False, (3, "is_favorite"): False}
    acts = lambda s: sorted((r.asset_id, r.field, r.action, r.value) for r in sync.resolve(changed, s).where("asset_id = 1").collect())
    assert acts("remote_wins") == [(1, "is_archived", "pull", True), (1, "is_favorite", "pull", False)]
    assert acts("local_wins") == [(1, "is_archived", "push", True), (1, "is_favorite", "push", True)]
    assert acts("manual") == [(1, "is_favorite", "queue", None)]


def test_file_names_do_not_collide(spark):
    df = spark.createDataFrame([(1, 1, "a.jpg", True), (1, 2, "a.jpg", False), (1, 3, "a.jpg", False), (1, 4, "b", False), (1, 5, "b", False)], "group_index long, ordinal long, filename string, is_best boolean")
    assert [r.target for r in actions.destinations(df).orderBy("ordinal", "target").collect()] == ["best_a.jpg", *(f"originals/{x}" for x in ("a.jpg", "a_1.jpg", "a_2.jpg", "b", "b_1"))]


def test_malformed_texts_have_defined_values(spark):
    df = spark.createDataFrame([(x,) for x in ["1/250", "0.5", "x", "1/0", "", None, "1,234", "640x480", "1x2x3"]], "t string")
    got = [tuple(r) for r in df.select(media.exposure(F.col("t")), media.size_number(F.col("t")), media.pixels(F.col("t"))).collect()]
    assert [g[0] for g in got[:6]] == [0.004, 0.5, None, None, None, None] and got[6][1] == 1234.0 and got[2][1] == 0.0
    assert got[7][2] == 307200 and got[8][2] == 0


def test_eyes_without_six_points_or_width_are_open(spark):
    ring = [(0, 0), (1, 1), (2, 1), (3, 0), (2, -1), (1, -1)]
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in ring],), ([(0.0, 0.0)] * 6,)], "p array<struct<x:double,y:double>>")
    assert [round(r[0], 6) for r in df.select(media.eye_aspect_ratio(F.col("p"))).collect()] == [round(4 / 6, 6), 1.0]


def test_local_scan(spark, tmp_path):
    for name in ("a/one.JPG", "b/two.mov", "b/three.txt", "four.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    rows = lambda **k: [(r.photo_id, r.media_type) for r in local.scan(spark, str(tmp_path), **k).orderBy("photo_id").collect()]
    assert rows() == [("a/one.JPG", "IMAGE"), ("b/two.mov", "VIDEO"), ("four.png", "IMAGE")]
    assert rows(kind="IMAGE", limit=1) == [("a/one.JPG", "IMAGE")] and rows(folder="b") == [("b/two.mov", "VIDEO")]
    ids = spark.createDataFrame([("four.png",)], "photo_id string")
    assert [bytes(r.content) for r in local.contents(spark, str(tmp_path), ids).collect()] == [b"x" * 8]
    (tmp_path / "state.json").write_text('{"processed_hashes": {"a": "ff"}}')
    assert local.state(spark, str(tmp_path / "state.json")).first()[:3] == (1, {"a": "ff"}, [])


def test_backends_that_fail_or_are_missing_leave_nulls(spark):
    from prismlake.functions import backends

    @backends.register
    class Bytes(backends.FaceBackend):
        name = "bytes"

        def load(self, content):
            if not content:
                raise ValueError("no image")
            return content

        def detect(self, image):
            return [{"top": 0, "right": len(image), "bottom": 1, "left": 0}]

        def encode(self, image):
            return [[float(image[0])]]

    @backends.register
    class Missing(Bytes):
        name = "missing"
        needs = ("a_module_that_is_not_there",)

    images = spark.createDataFrame([("a", b"xyz"), ("b", b"")], "photo_id string, content binary")
    assert backends.choose("missing") is None and backends.choose("auto", ("missing", "bytes")) is Bytes
    found = {r.photo_id: r for r in backends.with_faces(images, Bytes).collect()}
    assert found["a"].faces[0].right == 3 and found["a"].encodings == [[120.0]] and found["b"].faces is None
    assert backends.with_faces(images, None).where("faces IS NULL").count() == 2
    del backends.BACKENDS["bytes"], backends.BACKENDS["missing"]


def test_difference_hash(spark):
    from prismlake.functions.backends import difference_hash

    row = [list(range(9)) * 8, list(range(8, -1, -1)) * 8, [0, 1] + [0] * 70]
    df = spark.createDataFrame([(r,) for r in row], "p array<int>")
    assert [r[0] % (1 << 64) for r in df.select(difference_hash(F.col("p"))).collect()] == [(1 << 64) - 1, 0, 1 << 63]


def test_fingerprints_and_documents(spark, tmp_path):
    from prismlake.config import GroupingConfig

    config = GroupingConfig()
    assert local.fingerprint("local", "/a", config) != local.fingerprint("local", "/a", GroupingConfig(window_s=10)) and config.least == 3
    groups = report.report_groups(spark.createDataFrame([(1, 1, "p1", "a.jpg", 0.5), (1, 2, "p2", "b.jpg", 0.9)], "group_index long, ordinal long, photo_id string, filename string, score double"))
    report.write_report(groups, str(tmp_path / "report"), {"threshold": "5"})
    found = spark.read.json(versions.folder(spark, str(tmp_path / "report"))).first()
    assert found.best_photo.photo_id == "p2" and found.photo_count == 2 and found.settings.threshold == "5"
    local.write_state(spark.createDataFrame([({"a": "ff"},)], "processed_hashes map<string,string>"), str(tmp_path / "state"))
    assert local.state(spark, str(tmp_path / "state")).first().processed_hashes == {"a": "ff"}


def test_the_first_scorer_that_is_there_scores_what_it_can(spark):
    from prismlake.functions import backends

    @backends.register_scorer
    class Gone(backends.Scorer):
        name, needs = "gone", ("no_such_module",)

        def score(self, content):
            return 1.0

    @backends.register_scorer
    class Length(backends.Scorer):
        name = "length"

        def score(self, content):
            return 1 / len(content)

    images = spark.createDataFrame([("a", bytearray(b"xx")), ("b", bytearray()), ("c", None)], "photo_id string, content binary")
    assert backends.scorer_chain(("gone",)) is None and backends.scorer_chain(("gone", "length")) is Length
    assert {r.photo_id: r.score for r in backends.with_scores(images, Length).collect()} == {"a": 0.5, "b": None, "c": None}
    assert backends.with_scores(images, None).where("score IS NULL").count() == 3
    del backends.SCORERS["gone"], backends.SCORERS["length"]


def test_perceptual_hashes_are_those_of_a_plain_transform(spark):
    import math
    import random

    from prismlake.functions import backends

    rng = random.Random(4)
    rows = [(v, p, [float(rng.randrange(256)) for _ in range(1024)]) for v in range(3) for p in range(2 + v)] + [(9, 0, [1.0])]
    found = {r.video_id: r for r in backends.video_hashes(spark.createDataFrame(rows, "video_id long, position long, pixels array<double>")).collect()}
    assert set(found) == {0, 1, 2} and [len(found[v].frames) for v in range(3)] == [2, 3, 4] and found[2].thumb == found[2].frames[2]
    _, _, pixels = rows[0]
    low = [sum(pixels[32 * y + x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low)
    want = sum(1 << (63 - i) for i, c in enumerate(low) if c > (middle[31] + middle[32]) / 2)
    assert found[0].frames[0] & ((1 << 64) - 1) == want


def test_replacements_of_a_large_group_are_those_of_brute_force(spark, monkeypatch):
    import random

    from prismlake.operators import ranking

    monkeypatch.setattr(ranking, "FACES", 4)
    rng = random.Random(5)
    rows = [(i, rng.randrange(2) if i % 5 else 7, rng.randrange(20), [rng.choice([0.0, 0.5]) for _ in range(3)], rng.random() * 0.5, rng.random() * 0.5) for i in range(80)]
    faces = spark.createDataFrame(rows, "face_id long, group_index long, asset_id long, enc array<double>, left_ear double, right_ear double")
    found = {r.face_id: (r.replacement, round(r.score, 9)) for r in ranking.best_replacement(faces, 0.6).collect()}
    want = {}
    for a in rows:
        near = []
        for b in rows:
            distance, ear = sum((x - y) ** 2 for x, y in zip(a[3], b[3], strict=True)) ** 0.5, (b[4] + b[5]) / 2
            if a[1] == b[1] and a[2] != b[2] and (a[4] + a[5]) / 2 < 0.2 < ear and distance < 0.6:
                near.append((-round(ear * (1 - distance), 9), b[0]))
        if near:
            want[a[0]] = (min(near)[1], -min(near)[0])
    assert found == want and len(want) > 10
