"""What a source of assets offers, whatever store it is; each kind of source by name.

A source gives tables; what a run does to it is planned in prismlake.plans as tables of intended actions, which a source
with a store takes. What a source can't do gives an empty table, so that callers need not ask.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.functions import containers
from prismlake.sources import library, local, server, sink

PEOPLE, FACES, MEMBERS = "person_id string, name string", "photo_id string, top int, right int, bottom int, left int", "person_id string, photo_id string"


class Source(ABC):
    """list_photos gives at least photo_id, filename and filepath; photo_data (photo_id, content); metadata (photo_id, metadata)."""

    spark: SparkSession
    #: Where actions are logged, for sources that take any.
    store: str | None = None

    @abstractmethod
    def list_photos(self, kind: str = "image", limit: int | None = None) -> DataFrame: ...

    @abstractmethod
    def photo_data(self, ids: DataFrame) -> DataFrame: ...

    @abstractmethod
    def metadata(self, ids: DataFrame) -> DataFrame: ...

    def apply(self, actions: DataFrame, run: str) -> DataFrame:
        """Applies a run's actions (step, action, value, target) to the source's store, see sink.apply(); those that failed, with `error`: all of them, where there is no store."""
        if self.store is None:
            return actions.withColumn("error", F.lit("this source takes no actions"))
        return sink.apply(actions, self.store, run, self.ids().withColumnRenamed("photo_id", "asset_id"))

    def ids(self) -> DataFrame:
        """(photo_id) of all assets, of any kind."""
        return self.list_photos(kind=None).select("photo_id")

    def done(self) -> DataFrame:
        """What the source's store says of assets, see sink.state()."""
        return sink.state(sink.log(self.spark, self.store)) if self.store else sink.state(self.spark.createDataFrame([], sink.LOG))

    def people(self) -> DataFrame:
        return self.spark.createDataFrame([], PEOPLE)

    def photos_by_person(self) -> DataFrame:
        return self.spark.createDataFrame([], MEMBERS)

    def faces(self) -> DataFrame:
        return self.spark.createDataFrame([], FACES)


@dataclass
class LocalSource(Source):
    """Files of a folder."""

    spark: SparkSession
    path: str
    store: str | None = None

    def _files(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path)

    def list_photos(self, kind: str | None = "image", limit: int | None = None) -> DataFrame:
        return local.scan(self.spark, self.path, kind=kind and kind.upper(), limit=limit).withColumn("filepath", F.concat(F.lit(self.path.rstrip("/") + "/"), "photo_id"))

    def photo_data(self, ids: DataFrame) -> DataFrame:
        return local.contents(self.spark, self.path, ids.select("photo_id"))

    def metadata(self, ids: DataFrame) -> DataFrame:
        place = F.split_part("path", F.lit(self.path.rstrip("/").split("://")[-1] + "/"), F.lit(-1))
        wanted = self._files().withColumn("photo_id", place).join(ids.select("photo_id"), "photo_id", "left_semi").drop("photo_id")
        return local.file_metadata(wanted).select(place.alias("photo_id"), "metadata")

    def video_info(self, ids: DataFrame) -> DataFrame:
        """photo_id and what the containers of videos say, see containers.INFO; of each file only the boxes that are asked for are read."""
        root = self.path.rstrip("/") + "/"
        found = containers.probed_files(ids.select(F.concat(F.lit(root), "photo_id").alias("path")))
        return found.select(F.substring("path", len(root) + 1, 1 << 20).alias("photo_id"), *(x.split()[0] for x in containers.INFO.split(", ")))


@dataclass
class ServerSource(Source):
    """Landed pages of a server's assets."""

    spark: SparkSession
    path: str
    store: str | None = None

    def list_photos(self, kind: str | None = "image", limit: int | None = None) -> DataFrame:
        """As the server listed them, with what has been done to them since."""
        found = server.scan(server.read_pages(self.spark, self.path), kind=kind and kind.upper(), limit=limit)
        if self.store is None:
            return found
        done = self.done().select(F.col("asset_id").alias("photo_id"), "favorite", "archived", "tags")
        flags = {"is_favorite": F.coalesce("favorite", "is_favorite"), "is_archived": F.coalesce("archived", "is_archived"), "keywords": F.array_union(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>")))}
        return found.join(done, "photo_id", "left").withColumns(flags).select(found.columns)

    def ids(self) -> DataFrame:
        return server.items(server.read_pages(self.spark, self.path)).select(F.col("id").alias("photo_id"))

    def photo_data(self, ids: DataFrame) -> DataFrame:
        """Landed pages hold no bytes."""
        return ids.select("photo_id", F.lit(None).cast("binary").alias("content"))

    def metadata(self, ids: DataFrame) -> DataFrame:
        found = server.items(server.read_pages(self.spark, self.path)).withColumnRenamed("id", "photo_id").join(ids.select("photo_id"), "photo_id", "left_semi")
        values = F.create_map(F.lit("filename"), F.col("originalFileName"), F.lit("filepath"), F.col("originalPath"), F.lit("filesize"), F.col("exifInfo.fileSizeInByte").cast("string"), F.lit("date"), F.col("exifInfo.dateTimeOriginal"))
        return found.select("photo_id", F.map_filter(values, lambda k, v: v.isNotNull()).alias("metadata"))

    def people(self) -> DataFrame:
        every = server.items(server.read_pages(self.spark, self.path)).select(F.explode("people").alias("p"))
        return every.select(F.col("p.id").alias("person_id"), F.col("p.name").alias("name")).distinct()

    def photos_by_person(self) -> DataFrame:
        every = server.items(server.read_pages(self.spark, self.path)).select("id", F.explode("people").alias("p"))
        return every.select(F.col("p.id").alias("person_id"), F.col("id").alias("photo_id")).distinct()


@dataclass
class LibrarySource(Source):
    """A photo library's table, landed as Parquet, and the folder of its originals and derivatives."""

    spark: SparkSession
    path: str
    root: str | None = None
    store: str | None = None

    def list_photos(self, kind: str = "image", limit: int | None = None) -> DataFrame:
        found = library.scan(self.spark.read.parquet(self.path), kind=kind, local_only=False, limit=limit)
        return found.select("photo_id", F.col("metadata.filename").alias("filename"), F.col("metadata.filepath").alias("filepath"), "metadata", "cached_path")

    def photo_data(self, ids: DataFrame) -> DataFrame:
        """Of the files under `root`, whose paths are those of the table."""
        rows = self.spark.read.parquet(self.path).withColumnRenamed("uuid", "photo_id").join(ids.select("photo_id"), "photo_id", "left_semi")
        if self.root is None:
            return rows.select("photo_id", F.lit(None).cast("binary").alias("content"))
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        named = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        return local.first_available(rows, named).select("photo_id", "content")

    def metadata(self, ids: DataFrame) -> DataFrame:
        kept = library.scan(self.spark.read.parquet(self.path), local_only=False).join(ids.select("photo_id"), "photo_id", "left_semi")
        return kept.select("photo_id", F.from_json(F.to_json("metadata"), "map<string,string>").alias("metadata"))

    def ids(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select(F.col("uuid").alias("photo_id"))

    def people(self) -> DataFrame:
        names = self.spark.read.parquet(self.path).select(F.explode("persons").alias("name")).where("name IS NOT NULL AND name <> '_UNKNOWN_'")
        return names.distinct().select(F.col("name").alias("person_id"), "name")


SOURCES: dict[str, type[Source]] = {"local": LocalSource, "server": ServerSource, "library": LibrarySource}


def open_source(spark: SparkSession, kind: str, path: str, **options: str) -> Source:
    if kind not in SOURCES:
        raise ValueError(f"no source {kind}; there are {sorted(SOURCES)}")
    return SOURCES[kind](spark, path, **options)
