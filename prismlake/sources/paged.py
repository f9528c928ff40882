"""Pages of a server's listing as a Spark data source: ranges of pages are read in parallel, each page tried again on its own.

A listing ends with its first page that is shorter than a page, or empty, and doesn't say beforehand which that is. It is looked
for by doubling and halving, so the driver asks for some pages as the logarithm of all; tasks then read ranges of those before it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismlake.fixtures import with_views
from prismlake.registry import query
from prismlake.shipping import ship
from prismlake.sources import server
from prismlake.storage import new_path

#: Items of a page, pages that one task reads, and tries for each.
SIZE, RANGE, TRIES = 1_000, 20, 4


@dataclass
class Pages(InputPartition):
    first: int
    end: int


class PageReader(DataSourceReader):
    """fetch(n) gives the items of a page, and raises if it can't be had; here it reads the file page_<n>.json of a folder."""

    def __init__(self, path: str, size: int, pages: int):
        self.path, self.size, self.pages = path.rstrip("/"), size, pages

    def fetch(self, page: int) -> list[dict]:
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        name = f"{folder}/page_{page}.json"
        if system.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            return []
        with system.open_input_stream(name) as f:
            return json.loads(f.read())["assets"]["items"]

    def tried(self, page: int, wait: float = 0.1) -> list[dict]:
        for left in reversed(range(TRIES)):
            try:
                return self.fetch(page)
            except Exception:
                if not left:
                    raise
                time.sleep(wait * (TRIES - left))
        raise ValueError("no try was allowed")

    def last(self) -> int:
        """The first page that isn't full. Pages before it are, and those behind it are of an older listing, if there are any."""
        full, short = -1, 1
        while len(self.tried(short - 1)) >= self.size:
            full, short = short - 1, 2 * short
        short -= 1
        while short - full > 1:
            middle = (full + short) // 2
            full, short = (middle, short) if len(self.tried(middle)) >= self.size else (full, middle)
        return short

    def partitions(self) -> list[Pages]:
        end = self.last() + 1
        return [Pages(first, min(end, first + self.pages)) for first in range(0, end, self.pages)]

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        for page in range(partition.first, partition.end) if partition else ():
            items = self.tried(page)
            columns = [pa.array([page] * len(items), pa.int64()), pa.array(range(len(items)), pa.int32()), pa.array([json.dumps(x, ensure_ascii=False) for x in items], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "place", "item"])


class AssetPages(DataSource):
    """Format `asset_pages`. Options: `path`, `size` (items of a full page) and `pages` (of a range). A server that is asked over a network is a subclass whose reader fetches."""

    reader_of: type[PageReader] = PageReader

    @classmethod
    def name(cls) -> str:
        return "asset_pages"

    def schema(self) -> str:
        return "page bigint, place int, item string"

    def reader(self, schema) -> PageReader:
        return type(self).reader_of(self.options["path"], int(self.options.get("size", SIZE)), int(self.options.get("pages", RANGE)))


def items(spark: SparkSession, path: str, size: int = SIZE, source: type[DataSource] = AssetPages) -> DataFrame:
    """(page, place, an item's fields) of a listing, up to its first short page."""
    ship(spark).dataSource.register(source)
    read = spark.read.format(source.name()).option("size", size).load(path)
    return read.select("page", "place", F.from_json("item", server.ITEM).alias("item")).select("page", "place", "item.*")


def land_pages(pages: DataFrame, path: str) -> None:
    """Each page (page, assets) as a file of its own, written aside and renamed, so that a task may be tried again."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pyarrow.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for page, text in zip(batch["page"].to_pylist(), batch["text"].to_pylist(), strict=True):
                aside = f"{folder}/.page_{page}.{time.monotonic_ns()}"
                with system.open_output_stream(aside) as out:
                    out.write(text.encode())
                system.move(aside, f"{folder}/page_{page}.json")
            yield batch.select(["page"])

    ship(pages.sparkSession)
    pages.select("page", F.to_json(F.struct("page", "assets")).alias("text")).mapInArrow(put, "page bigint").write.format("noop").mode("overwrite").save()


@query("scan_paged", with_views("assets") + f""", n AS (SELECT ord // {server._SIZE} AS page, count(*) AS n FROM assets GROUP BY 1), l AS (SELECT min(page) AS last FROM n WHERE n < {server._SIZE})
    SELECT asset_id AS photo_id, regexp_extract(path, '[^/]*$') AS filename, filesize, ord % 2 = 0 AS is_favorite, 'Zoé ' || (ord % 3) AS persons FROM assets, l WHERE media_type = 'IMAGE' AND NOT is_archived AND (last IS NULL OR ord // {server._SIZE} <= last)""")
def scan_paged(spark, d):
    """The rows of scan_server_pages, from a page at a time."""
    path = new_path(spark, "page-files")
    land_pages(server.read_pages(spark, server._landed(spark, d)), path)
    found = server.scan_items(items(spark, path, server._SIZE))
    return found.select("photo_id", "filename", "filesize", "is_favorite", F.array_join("persons", ",").alias("persons"))
