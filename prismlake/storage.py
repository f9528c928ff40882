"""Tables that a query writes to the folder its cluster shares, so that a lost executor loses none of them."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that is sent to all executors at most.
SENT = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session may do without, and then has a temporary folder. A cluster's executors would each write to a
    folder of their own, and later reads would miss rows without a word; so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="prismlake-")


_written: list[tuple[SparkSession, str]] = []
#: What this thread writes while a table is made by settled(), of which only the table itself stays.
_open = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/prismlake-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    getattr(_open, "paths", []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clear(spark: SparkSession) -> None:
    """Deletes all that this session has written so far, for sessions that live long; results that are still to be read from it are lost."""
    for owner, path in [x for x in _written if x[0] is spark]:
        delete(owner, path)
        _written.remove((owner, path))


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before us
            pass


class Kept:
    """A table written once to the shared folder, and read from there."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


def kept(df: DataFrame, name: str) -> DataFrame:
    return Kept(df, name).df


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> Kept:
    """The table that `make` gives, kept; all that was written on the way to it is deleted then, as nothing reads it any more."""
    outer = getattr(_open, "paths", None)
    _open.paths = []
    try:
        table = Kept(make(), name)
        for path in [p for p in _open.paths if p != table.path]:
            delete(spark, path)
            if (spark, path) in _written:
                _written.remove((spark, path))
    finally:
        if outer is None:
            del _open.paths
        else:
            _open.paths = outer
    return table


def _width(column: Column, kind: T.DataType) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(column)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + 16 + F.coalesce(_width(x, kind.elementType), F.lit(0)))
        return F.size(column) * 8
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_width(column[f.name], f.dataType), F.lit(0)) for f in kind), F.lit(16))
    return F.lit(8)


def small(df: DataFrame, rows: int, sent: int = SENT) -> DataFrame:
    """df, marked for broadcast if it has no more than so many rows and bytes; else as it is, for a shuffled join. df should be kept."""
    width = sum((F.coalesce(_width(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in df.schema), F.lit(16)).cast("long")
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= sent else df


class Scratch:
    """Keeps tables for the length of a `with` block; what the block returns must not be read from them."""

    def __enter__(self) -> Scratch:
        self.tables: list[Kept] = []
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(Kept(df, name))
        return self.tables[-1].df

    def __exit__(self, *_) -> None:
        for table in self.tables:
            table.drop()
