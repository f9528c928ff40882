from __future__ import annotations

import json
from pathlib import Path

import pytest
from prismlake.sources import contract, sink
from pyspark.sql import functions as F

SCHEMA = "step int, action string, value string, target string"


def actions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_chunks_have_a_size_and_a_key_of_what_they_do(spark):
    rows = actions(spark, [(1, "add_tag", "t", f"a{i:03d}") for i in range(210)] * 2 + [(1, "add_tag", "u", "a1"), (2, "delete_tag", "t", None)])
    found = sink.chunks(rows, "r", 200).collect()
    assert sorted((r.action, r.value, len(r.targets)) for r in found) == [("add_tag", "t", 10), ("add_tag", "t", 200), ("add_tag", "u", 1), ("delete_tag", "t", 0)]
    assert {r.key for r in sink.chunks(rows.repartition(3), "r", 200).collect()} == {r.key for r in found} and len({r.key for r in found}) == 4
    assert not {r.key for r in sink.chunks(rows, "s", 200).collect()} & {r.key for r in found}
    with pytest.raises(ValueError, match="no action"):
        sink.chunks(actions(spark, [(1, "shred", "t", "a")]), "r")


def test_failing_chunks_come_back_and_are_sent_again(spark, tmp_path):
    """A store that refuses a value until it is repaired, and counts what it does."""
    path, calls = str(tmp_path / "store"), tmp_path / "calls"
    calls.mkdir()

    class Refusing(sink.AssetActions):
        @staticmethod
        def send(chunk):
            name = f"{chunk['value']}-{len(chunk['targets'])}-{chunk['key'][:6]}"
            n = len(list(Path(calls).glob(f"{name}*")))
            (Path(calls) / f"{name}.{n}").write_text("")
            if chunk["value"] == "bad" and not (Path(calls) / "repaired").exists():
                raise OSError("refused")

    rows = actions(spark, [(1, "add_tag", v, f"a{i}") for v in ("good", "bad") for i in range(5)])
    failed = sink.apply(rows, path, "r", size=2, source=Refusing).collect()
    assert sorted((r.value, r.target, r.error) for r in failed) == [("bad", f"a{i}", "refused") for i in range(5)]
    assert len(list(calls.glob("good*"))) == 3 and len(list(calls.glob("bad*"))) == 3 * sink.TRIES
    (calls / "repaired").write_text("")
    assert sink.apply(rows, path, "r", size=2, source=Refusing).count() == 0
    assert len(list(calls.glob("good*"))) == 3 and len(list(calls.glob("bad*"))) == 3 * sink.TRIES + 3
    assert {(r.asset_id, tuple(r.tags)) for r in sink.state(sink.log(spark, path)).collect()} == {(f"a{i}", ("bad", "good")) for i in range(5)}


def test_a_plan_whose_task_dies_counts_for_nothing_and_is_done_once_more(spark, tmp_path):
    """What the dead try has sent is known to the store by its key; the log has each chunk once."""
    path, calls = str(tmp_path / "store"), tmp_path / "calls"
    calls.mkdir()

    class Keyed(sink.AssetActions):
        @staticmethod
        def send(chunk):
            if (Path(calls) / chunk["key"]).exists():
                return
            if chunk["value"] == "v7" and not (Path(calls) / "up").exists():
                (Path(calls) / "up").write_text("")
                raise SystemExit("the worker dies")
            (Path(calls) / chunk["key"]).write_text(chunk["value"])

    rows = actions(spark, [(1, "add_to_album", f"v{i}", "a") for i in range(9)])
    with pytest.raises(Exception, match="dies|exited|crashed|SystemExit"):
        sink.apply(rows, path, "r", source=Keyed)
    assert sink.log(spark, path).count() == 0
    assert sink.apply(rows, path, "r", source=Keyed).count() == 0
    assert sorted(r.value for r in sink.log(spark, path).collect()) == [f"v{i}" for i in range(9)]
    assert sorted(p.read_text() for p in calls.iterdir() if p.name != "up") == [f"v{i}" for i in range(9)]
    done = sorted(p.name for p in Path(path).glob("chunks/*"))
    assert sink.apply(rows, path, "r", source=Keyed).count() == 0 and sorted(p.name for p in Path(path).glob("chunks/*")) == done


def test_later_plans_undo_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    sink.apply(actions(spark, [(1, "favorite", "true", "a"), (1, "archived", "true", "b"), (1, "add_tag", "x", "a"), (1, "add_tag", "y", "a"), (1, "add_tag", "x", "b"), (1, "add_to_album", "m", "b")]), path, "one")
    plan = spark.createDataFrame([(1, "unfavorite", "a"), (2, "unarchive", "b"), (3, "delete_tag", "x"), (4, "delete_album", "m")], "step int, action string, target string")
    assert sink.apply(sink.undo_actions(plan), path, "two").count() == 0
    found = {r.asset_id: (r.favorite, r.archived, r.tags, r.albums) for r in sink.state(sink.log(spark, path)).collect()}
    assert found == {"a": (False, None, ["y"], []), "b": (None, False, [], [])}
    sink.apply(actions(spark, [(1, "add_tag", "x", "b"), (1, "remove_tag", "y", "a")]), path, "three")
    found = {r.asset_id: r.tags for r in sink.state(sink.log(spark, path)).collect()}
    assert found == {"a": [], "b": ["x"]}


def test_a_source_with_a_store_takes_actions(spark, tmp_path):
    items = [{"id": f"x{i}", "type": "IMAGE", "originalFileName": f"{i}.jpg", "originalPath": f"/p/{i}.jpg"} for i in range(3)]
    (tmp_path / "pages.json").write_text(json.dumps({"page": 0, "size": 5, "assets": {"items": items}}))
    source = contract.open_source(spark, "server", str(tmp_path / "pages.json"), store=str(tmp_path / "store"))
    rows = actions(spark, [(1, "favorite", "true", "x1"), (1, "add_tag", "t", "x2"), (1, "add_tag", "t", "x9")])
    assert [(r.target, r.error) for r in source.apply(rows, "r").collect()] == [("x9", "no such asset")]
    assert {r.photo_id: (r.is_favorite, r.keywords) for r in source.list_photos().collect()} == {"x0": (False, []), "x1": (True, []), "x2": (False, ["t"])}
    without = contract.open_source(spark, "server", str(tmp_path / "pages.json"))
    assert without.apply(rows, "r").where(F.col("error").isNotNull()).count() == 3
