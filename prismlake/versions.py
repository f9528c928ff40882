"""Tables that are replaced as a whole: a new version beside the old one, then a manifest, which is renamed into its place.

A version is a folder of its own. Manifests are numbered; one is written aside and renamed to the next number, which no file system
does twice. Readers take the version of the highest number, so they see the old one or the new one, whenever a writer dies; and of
two writers that began from the same version one gets an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from prismlake.storage import delete

MANIFESTS = "_manifests"


class Conflict(ValueError):
    """Another writer has committed first."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern of Hadoop's file systems, in order."""
    found = _system(spark, pattern).globStatus(_path(spark, pattern))
    return sorted(f.getPath().toString() for f in found) if found is not None else []


def _read(spark: SparkSession, path: str) -> dict:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Conflict if the new name is taken."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, new).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(_path(spark, old), _path(spark, new), options)
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise Conflict(new) from e
        raise


def manifests(spark: SparkSession, path: str) -> list[str]:
    return listed(spark, f"{path.rstrip('/')}/{MANIFESTS}/*.json")


def current(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the latest version: its number, and what commit() was given; None if there is none."""
    found = manifests(spark, path)
    return _read(spark, found[-1]) if found else None


def commit(spark: SparkSession, path: str, number: int, **what: str) -> None:
    """Makes `what` the version of that number, if it is the next one still."""
    folder = f"{path.rstrip('/')}/{MANIFESTS}"
    aside, name = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{number:012d}.json"
    stream = _system(spark, aside).create(_path(spark, aside), False)
    try:
        stream.write(bytearray(json.dumps({"number": number} | what).encode()))
    finally:
        stream.close()
    try:
        rename(spark, aside, name)
    except Exception:
        delete(spark, aside)
        raise


def replace(df: DataFrame, path: str, form: str = "json", after: int | None = None, **options: str) -> int:
    """Writes df as the next version of the table at path, and returns its number; after: the number that it replaces (the latest).

    What a writer that died has left is in no manifest, and goes with cleaned().
    """
    spark = df.sparkSession
    if after is None:
        after = (current(spark, path) or {"number": 0})["number"]
    folder = f"v{after + 1:012d}-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(f"{path.rstrip('/')}/{folder}")
    commit(spark, path, after + 1, folder=folder, format=form)
    return after + 1


def folder(spark: SparkSession, path: str) -> str | None:
    """Where the latest version's files are."""
    found = current(spark, path)
    return f"{path.rstrip('/')}/{found['folder']}" if found else None


def cleaned(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the last versions, and what no manifest names; how many folders went. Not beside a writer."""
    found = manifests(spark, path)
    stay = {_read(spark, m)["folder"] for m in found[-keep:]}
    for m in found[:-keep]:
        delete(spark, m)
    gone = [f for f in listed(spark, f"{path.rstrip('/')}/v*") if f.rpartition("/")[2] not in stay]
    for f in gone:
        delete(spark, f)
    return len(gone)
