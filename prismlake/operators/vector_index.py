"""Ranked search over vectors by an inverted file: lists of rows around centroids, of which a query reads the nearest.

Centroids are fitted by Spark's k-means on a bounded sample; every row is then put into the list of its nearest centroid. A query's
score with a row is their dot product. The row with the largest one is the nearest if each row gets a component more, which makes
all rows equally long, and queries have 0 there; so lists are chosen by distance. Rows of the lists read are scored exactly. How
many lists a query reads is measured: as many as hold a wanted share of the exact answers to a bounded sample of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.functions.scalars import nearest
from prismlake.registry import query
from prismlake.shipping import ship
from prismlake.storage import kept

#: Rows that centroids are fitted on, rows of them for each centroid, centroids, and queries that the number of lists is measured with; all at most.
SAMPLE, EACH, LISTS, TRIED = 50_000, 12, 4_096, 200
#: Share of the exact answers that the lists read must hold for those queries. A little above what is promised, as others may fare worse.
WANTED = 0.96
#: Rows, and queries, that are multiplied at once; rows of a list that one task cuts into blocks.
BLOCK, DEALT = 1_000, 50_000


def _matrix(batch: pa.RecordBatch, column: str = "embedding") -> np.ndarray:
    found = batch.column(batch.schema.get_field_index(column))
    return np.array(found.to_pylist(), float).reshape(len(found), -1)


@dataclass
class VectorIndex:
    """centroids (lists, width + 1), with the square of the largest length; blocks: (list, ids: array<long>, rows: binary), written to shared storage."""

    centroids: np.ndarray
    top: float
    blocks: DataFrame
    probes: int = 1

    def order(self, found: np.ndarray, queries: bool) -> np.ndarray:
        """For each vector the lists from the nearest on."""
        more = np.zeros(len(found)) if queries else np.sqrt(np.maximum(self.top - np.square(found).sum(axis=1), 0))
        full = np.column_stack([found, more])
        return np.argsort(np.square(self.centroids).sum(axis=1) - 2 * full @ self.centroids.T, axis=1, kind="stable")

    def tuned(self, vectors: DataFrame, queries: DataFrame, k: int = 20, wanted: float = WANTED) -> VectorIndex:
        """The index, reading as many lists as hold the wanted share of exact answers to TRIED of the queries (those of the smallest hashes)."""
        some = kept(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED), "tried")
        true = nearest(vectors, some, k)
        exact = true.groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).join(some.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").collect()  # TRIED rows
        ids = {i for r in exact for i in r["ids"]}
        rows = vectors.where(F.col("vec_id").isin(sorted(ids))).select("vec_id", "embedding").collect() if ids else []  # k of each at most
        if not rows:
            return self
        at = dict(zip((r["vec_id"] for r in rows), self.order(np.array([r["embedding"] for r in rows], float), False)[:, 0].tolist(), strict=True))
        ranks = np.argsort(self.order(np.array([r["embedding"] for r in exact], float), True), axis=1)
        places = np.sort([ranks[n, at[i]] for n, r in enumerate(exact) for i in r["ids"]])
        return VectorIndex(self.centroids, self.top, self.blocks, int(places[int(np.ceil(wanted * len(places))) - 1]) + 1)

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, vec_id, score): for each of queries (vec_id, embedding) the k rows with the largest dot product among the lists read, ties by vec_id.

        Queries that read a list are put into blocks too; each pair of blocks of a list is a product of two small matrices, so
        neither a long list nor one that all queries read is the work of one task.
        """
        ship(queries.sparkSession)
        index, probes = VectorIndex(self.centroids, self.top, None, self.probes), self.probes

        def reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _matrix(batch)
                lists = index.order(found, True)[:, :probes] if len(found) else np.zeros((0, 1), int)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in found], pa.binary()), pa.array(lists.tolist(), pa.list_(pa.int32()))], names=["vec_id", "row", "lists"])

        read = queries.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInArrow(reads, "vec_id bigint, row binary, lists array<int>")
        asked = _blocks(kept(read.select("vec_id", "row", F.explode("lists").alias("list")), "asked")).toDF("list", "query_ids", "query_rows")
        pairs = self.blocks.join(asked, "list")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, rows, query_ids, query_rows in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("ids", "rows", "query_ids", "query_rows")), strict=True):
                    own, asking = np.array(ids.as_py()), np.array(query_ids.as_py())
                    scores = np.round(np.frombuffer(rows.as_py()).reshape(len(own), -1) @ np.frombuffer(query_rows.as_py()).reshape(len(asking), -1).T, 5)
                    order = np.stack([np.lexsort([own, -scores[:, q]])[:k] for q in range(len(asking))])
                    n = order.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asking, n)), pa.array(own[order].ravel()), pa.array(scores[order.ravel(), np.repeat(np.arange(len(asking)), n)])], names=["query_id", "vec_id", "score"])

        at = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return pairs.mapInArrow(best, "query_id bigint, vec_id bigint, score double").withColumn("_r", F.row_number().over(at)).where(F.col("_r") <= k).drop("_r")


def _blocks(rows: DataFrame) -> DataFrame:
    """(list, ids, rows): blocks of BLOCK at most of rows (vec_id, row: binary, list), kept. Long lists are dealt over several tasks first."""
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / DEALT).alias("salts"))
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")))  # LISTS rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, list, list] | None = None
        done: list[tuple] = []
        for batch in batches:
            for at, i, row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("list", "vec_id", "row")), strict=True):
                if held and (held[0] != at or len(held[1]) == BLOCK):
                    done.append(held)
                    held = None
                held = held or (at, [], [])
                held[1].append(i)
                held[2].append(row)
            if done:
                yield _cut(done)
                done = []
        if held:
            yield _cut([held])

    return kept(dealt.repartition("list", "salt").sortWithinPartitions("list").select("list", "vec_id", "row").mapInArrow(cut, "list int, ids array<bigint>, rows binary"), "blocks")


def _cut(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([b"".join(x[2]) for x in found], pa.binary())], names=["list", "ids", "rows"])


def build(vectors: DataFrame, lists: int | None = None) -> VectorIndex:
    """An index of all rows of vectors (vec_id, embedding: of one width); rows without an embedding are in no list.

    lists: the square root of the rows, or what is given, but no more than LISTS, and one for EACH rows of the sample. The sample
    are the SAMPLE rows of the smallest hashes of vec_id.
    """
    ship(vectors.sparkSession)
    own = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, top = own.agg(F.count("*"), F.coalesce(F.max(length), F.lit(0.0))).first()
    sample = kept(own.withColumn("more", F.sqrt(F.greatest(top - length, F.lit(0.0)))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE), "vector-sample")
    wanted = max(2, min(lists or int(n**0.5), LISTS, sample.count() // EACH))
    full = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array("more"))
    model = KMeans(k=wanted, seed=1, maxIter=15, featuresCol="v").fit(sample.select(array_to_vector(full).alias("v"))) if n else None
    centroids = np.array(model.clusterCenters()) if model else np.zeros((1, 1))
    index = VectorIndex(centroids, top, None)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch)
            at = index.order(found, False)[:, 0] if len(found) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in found], pa.binary()), pa.array(at, pa.int32())], names=["vec_id", "row", "list"])

    return VectorIndex(centroids, top, _blocks(kept(own.mapInArrow(assign, "vec_id bigint, row binary, list int"), "listed")))


@query("vector_index_topk")
def vector_index_topk(spark, d):
    """The rows nearest to each row whose id is divisible by 50, from the lists that an index of all rows says to read."""
    e = fixtures.table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    return build(e).tuned(e, asked).search(asked)
