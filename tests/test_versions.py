from __future__ import annotations

import pytest
from prismlake import versions
from prismlake.operators import report
from prismlake.sources import local
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F


def values(spark, path):
    return sorted(r.v for r in spark.read.json(versions.folder(spark, path)).collect())


def test_readers_see_the_old_version_until_the_new_one_is_whole(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), spark.range(10).select(F.col("id").alias("v"))
    assert versions.current(spark, path) is None and versions.folder(spark, path) is None
    assert versions.replace(rows.where("v < 3"), path) == 1
    with pytest.raises(SparkRuntimeException):
        versions.replace(rows.withColumn("v", F.when(F.col("v") == 9, F.raise_error(F.lit("dies"))).otherwise(F.col("v"))), path)
    assert values(spark, path) == [0, 1, 2]

    def dies(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(versions, "rename", dies)
        with pytest.raises(OSError, match="gone"):
            versions.replace(rows, path)
    assert values(spark, path) == [0, 1, 2] and versions.current(spark, path)["number"] == 1
    assert versions.replace(rows, path) == 2 and values(spark, path) == [*range(10)]


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(3).select(F.col("id").alias("v"))
    versions.replace(rows, path)
    versions.replace(rows.where("v = 1"), path, after=1)
    with pytest.raises(versions.Conflict):
        versions.replace(rows.where("v = 2"), path, after=1)
    assert values(spark, path) == [1] and not [p for p in versions.listed(spark, f"{path}/_manifests/.*") if "crc" not in p]


def test_old_versions_and_leftovers_go(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(3).select(F.col("id").alias("v"))
    for i in range(4):
        versions.replace(rows.where(F.col("v") < i), path)
    (tmp_path / "t" / "v000000000009-left").mkdir()
    assert versions.cleaned(spark, path) == 3 and versions.cleaned(spark, path) == 0
    assert values(spark, path) == [0, 1, 2] and versions.replace(rows.where("v = 0"), path) == 5


def test_a_state_of_which_no_write_was_whole_is_none(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    row = spark.createDataFrame([(1, "own")], "version int, fingerprint string")
    monkeypatch.setattr(versions, "rename", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        local.write_state(row, path)
    assert local.resume(spark, path, "own") is None
    monkeypatch.undo()
    local.write_state(row, path)
    assert local.resume(spark, path, "own").first().version == 1


def test_a_report_is_written_again_and_the_latest_is_found(spark, tmp_path):
    folder = str(tmp_path / "reports")
    groups = spark.createDataFrame([(1, 2), (2, 3)], "group_index long, photo_count long")
    assert report.latest_report(spark, folder).count() == 0 and report.read_reports(spark, folder).count() == 0
    report.save_report(groups, folder, "b", {}, "t1")
    report.save_report(groups.where("group_index = 1"), folder, "a", {}, "t2")
    report.save_report(groups.where("group_index = 2"), folder, "b", {}, "t1")
    report.save_report(groups.where("group_index = 2"), folder, "a", {}, "t2")
    assert sorted((r.report, r.group_index) for r in report.read_reports(spark, folder).collect()) == [("report_a", 2), ("report_b", 2)]
    assert [r.report for r in report.latest_report(spark, folder).collect()] == ["report_a"]
