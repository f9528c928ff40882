"""What the training-data operators share: inputs, and columns computed in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prismlake.ordering import NO_KEY, copies, fresh, in_order, key_of, running, size_bins, spread_join
from prismlake.shipping import ship
from prismlake.storage import Kept, Scratch, kept, new_path, small

__all__ = ["NO_KEY", "WORD", "Kept", "Scratch", "copies", "documents", "fresh", "in_order", "kept", "key_of", "new_path", "running", "size_bins", "small", "spread_join", "with_computed"]

#: A word, as Spark and DuckDB write it. bytes.split() parts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a worker turns into Python objects at once.
AT_ONCE = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def with_computed(df: DataFrame, compute: Callable[[pa.RecordBatch], list[pa.Array]], added: str, drop: Sequence[str] = ()) -> DataFrame:
    """df without the columns `drop`, and with those of the schema `added`, which `compute` makes from each Arrow batch."""
    ship(df.sparkSession)
    stays = [c for c in df.columns if c not in drop]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in stays), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*stays, *(x.split()[0] for x in added.split(", "))]
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in stays), *compute(batch)], names=names)

    return df.mapInArrow(run, schema)
