"""A stream of changed assets whose cursor is a time: the largest `updated` seen so far.

The landing is a folder of Parquet files, written by whoever watches the store, in any number and order of files. An offset is a time,
so a batch is what was updated after the last offset, up to the largest time there is; a file whose times lie outside is not
read, and each that is read is a task of its own. What lands late, with a time before the cursor, is not seen, as with a server that
is asked for what has changed since.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from prismlake.shipping import ship

#: Before all times.
FIRST = -(1 << 63)


@dataclass
class FileRange(InputPartition):
    path: str
    after: int
    until: int


class ChangesReader(DataSourceStreamReader):
    def __init__(self, path: str, column: str, names: list[str]):
        self.path, self.column, self.names = path.rstrip("/"), column, names
        self.seen: dict[str, tuple[int, int] | None] = {}

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def _ranges(self) -> dict[str, tuple[int, int] | None]:
        """The least and largest time of each file, from its footer; a footer is read once."""
        system, folder = self._open()
        for info in system.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if info.path.endswith(".parquet") and not info.base_name.startswith(("_", ".")) and "/_temporary/" not in info.path and info.path not in self.seen:
                self.seen[info.path] = self._times(system, info.path)
        return self.seen

    def _times(self, system: pyarrow.fs.FileSystem, path: str) -> tuple[int, int] | None:
        with system.open_input_file(path) as f:
            meta = pq.ParquetFile(f).metadata
        at = [i for i in range(meta.num_columns) if meta.schema.column(i).path == self.column][0]
        found = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        with_values = [s for s in found if s is not None and s.has_min_max]
        return (min(s.min for s in with_values), max(s.max for s in with_values)) if with_values else None

    def initialOffset(self) -> dict:
        return {"until": FIRST}

    def latestOffset(self) -> dict:
        return {"until": max((r[1] for r in self._ranges().values() if r), default=FIRST)}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        after, until = start["until"], end["until"]
        return [FileRange(path, after, until) for path, r in sorted(self._ranges().items()) if r and r[1] > after and r[0] <= until]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        system, _ = self._open()
        with system.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            for batch in file.iter_batches(columns=list(dict.fromkeys([*self.names, self.column]))):
                times = batch.column(batch.schema.get_field_index(self.column))
                own = batch.filter(pc.and_(pc.greater(times, partition.after), pc.less_equal(times, partition.until)))
                if own.num_rows:
                    yield own.select(self.names)

    def commit(self, end: dict) -> None:
        """The cursor is Spark's checkpoint."""


class AssetChanges(DataSource):
    """Format `asset_changes`. Options: `path`, and `updated`, the column of times (long); the schema is the reader's."""

    @classmethod
    def name(cls) -> str:
        return "asset_changes"

    def streamReader(self, schema: StructType) -> ChangesReader:
        return ChangesReader(self.options["path"], self.options.get("updated", "updated"), schema.names)


def changes(spark: SparkSession, path: str, schema: StructType, updated: str = "updated") -> DataFrame:
    """The stream of the landing's rows of a schema, in batches of time."""
    ship(spark).dataSource.register(AssetChanges)
    return spark.readStream.format("asset_changes").schema(schema).option("updated", updated).load(path)
