"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors are whole numbers, cut into parts; each part position has a codebook. An entry whose norm differs from a part's by more than
a distance is farther off than that. So a codebook is sorted by norm, each part looks first at entries of about its own norm, and
then, by binary search, only at those whose norms the best distance so far allows, both ends included; these are compared exactly.

A round of fitting is a pass over the table: tasks give sums and counts for each entry, Spark adds them up, and the driver sees
a row for each entry (256 for each part), never a vector but the first 256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import kept, key_of, spread_join
from prismlake.shipping import ship

#: Whole numbers are the components times this, rounded down.
SCALE = 1024
#: Parts of a vector, entries of a codebook, and rounds of fitting.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Parts that look at a codebook together, after being sorted by norm, and entries that are looked at first and added at once.
BLOCK, STEP = 256, 16


@dataclass
class Codebook:
    """Entries (n, width) as whole numbers; in order of their norms with `by_norm` and `norms`."""

    entries: np.ndarray

    def __post_init__(self):
        sizes = np.sqrt(np.square(self.entries.astype(float)).sum(axis=1))
        self.by_norm = np.argsort(sizes, kind="stable")
        self.norms = sizes[self.by_norm]

    def distances(self, parts: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of parts to some entries: in floating point while all sums are below 2^53, else in long integers."""
        found = self.entries[which]
        top = max(int(np.abs(parts).max(initial=0)), int(np.abs(found).max(initial=0)), 1)
        kind = float if (2 * top) ** 2 * max(1, parts.shape[1]) < 2**53 else np.int64
        x, c = parts.astype(kind), found.astype(kind)
        squares = np.square(x).sum(axis=1)[:, None] + np.square(c).sum(axis=1)[None, :]
        return (squares - 2 * (x @ c.T)).astype(np.int64)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part the entry and its squared distance, ties to the lower entry; and how many entries were compared in all."""
        n = len(parts)
        code, best, compared = np.full(n, len(self.entries)), np.full(n, np.iinfo(np.int64).max), 0
        sizes = np.sqrt(np.square(parts.astype(float)).sum(axis=1))
        order = np.argsort(sizes, kind="stable")
        for at in range(0, n, BLOCK):
            rows = order[at : at + BLOCK]
            middle = int(np.searchsorted(self.norms, sizes[rows[len(rows) // 2]]))
            done_lo = done_hi = middle
            lo, hi = np.full(len(rows), middle - STEP // 2), np.full(len(rows), middle + STEP // 2)
            while len(rows):
                # the annuli of the rows that are left, at most some steps beyond what has been looked at
                new_lo = max(0, int(lo.min()), done_lo - STEP)
                new_hi = min(len(self.norms), int(hi.max()), done_hi + STEP)
                if new_lo == done_lo and new_hi == done_hi:
                    break
                fresh = np.sort(np.concatenate([self.by_norm[new_lo:done_lo], self.by_norm[done_hi:new_hi]]))
                found = self.distances(parts[rows], fresh)
                compared += found.size
                least = found.argmin(axis=1)  # the lowest of equal ones, as entries are in order
                distance, entry = found[np.arange(len(rows)), least], fresh[least]
                better = (distance < best[rows]) | ((distance == best[rows]) & (entry < code[rows]))
                best[rows[better]], code[rows[better]] = distance[better], entry[better]
                done_lo, done_hi = new_lo, new_hi
                lo, hi = self.annulus(sizes[rows], best[rows])
                left = (lo < done_lo) | (hi > done_hi)
                rows, lo, hi = rows[left], np.minimum(lo[left], done_lo), np.maximum(hi[left], done_hi)
        return code, best, compared

    def annulus(self, sizes: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places [lo, hi) of the entries that may be as near as `best`, by norm; both ends are included, and rounding only widens them."""
        reach = np.sqrt(best.astype(float))
        slack = 1e-9 * (sizes + reach) + 1e-9
        return np.searchsorted(self.norms, sizes - reach - slack, "left"), np.searchsorted(self.norms, sizes + reach + slack, "right")


def limit(width: int) -> int:
    """The largest whole number that a component may have, so that distances of vectors of such a width fit a long."""
    return isqrt(2**62 // max(1, width)) // 2


def whole_numbers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and `ints` (array<long>) of the rows whose vector isn't null and holds neither null nor what isn't finite; kept."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ints = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col(f"`{vector}`").isNotNull() & F.forall(F.col(f"`{vector}`"), finite))
    return kept(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("ints")), "whole-numbers")


def _fits(width: int) -> Column:
    return (F.size("ints") == width) & F.forall("ints", lambda x: x.between(-limit(width), limit(width)))


def _edges(width: int, parts: int) -> list[int]:
    return [i * width // parts for i in range(parts + 1)]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("ints"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def fit(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """A codebook for each part position of rows (vec_id, ints of that width), kept.

    They begin as the parts of the least vec_ids (none: last; ties by components); each round assigns all rows and replaces
    each entry by the floor of its parts' mean. Entries that no part has stay.
    """
    least = rows.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    first = np.array([r["ints"] for r in least], np.int64).reshape(len(least), width)
    edges = _edges(width, parts)
    books = [Codebook(first[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    widest = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    for _ in range(rounds):
        for r in sums(rows, books, widest).collect():  # a row for each entry
            entry, n = books[r["part"]].entries[r["entry"]], r["n"]
            entry[:] = [int(r[f"s{i}"]) // n for i in range(len(entry))]
        books = [Codebook(b.entries) for b in books]
    return books


def sums(rows: DataFrame, books: Sequence[Codebook], widest: int) -> DataFrame:
    """(part, entry, n, s0, s1, …): how many parts are nearest to each entry, and their sums; each task adds up its own first."""
    edges = np.cumsum([0, *(b.entries.shape[1] for b in books)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b.entries), widest + 1), np.int64) for b in books]
        for batch in batches:
            found = _matrix(batch, int(edges[-1]))
            for part, book in enumerate(books):
                own = found[:, edges[part] : edges[part + 1]]
                code = book.nearest(own)[0]
                order = np.argsort(code, kind="stable")
                used, starts, counts = np.unique(code[order], return_index=True, return_counts=True)
                if len(used):
                    total[part][used, 0] += counts
                    total[part][used, 1 : 1 + own.shape[1]] += np.add.reduceat(own[order], starts, axis=0)
        for part, held in enumerate(total):
            used = np.flatnonzero(held[:, 0])
            columns = [np.full(len(used), part, np.int32), used.astype(np.int32), *held[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *(f"s{i}" for i in range(widest))])

    names = [f"s{i}" for i in range(widest)]
    by_task = rows.select("ints").mapInArrow(run, ", ".join(["part int, entry int, n long", *(f"{c} long" for c in names)]))
    return by_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names))


def digest(books: Sequence[Codebook]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for row in b.entries.tolist() for x in row).encode()).hexdigest()


def encode(rows: DataFrame, books: Sequence[Codebook]) -> DataFrame:
    """vec_id, label, code (binary: a byte for each part) and error (the squared distances added up) of rows (vec_id, label, ints), kept."""
    edges = np.cumsum([0, *(b.entries.shape[1] for b in books)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch, int(edges[-1]))
            codes, error = np.zeros((len(found), len(books)), np.uint8), np.zeros(len(found), np.int64)
            for part, book in enumerate(books):
                code, distance, _ = book.nearest(found[:, edges[part] : edges[part + 1]])
                codes[:, part] = code
                error += distance
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return kept(rows.mapInArrow(run, f"vec_id bigint, label {label}, code binary, error bigint"), "codes")


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 for each row of vectors with a vector of finite numbers.

    label_error adds up the errors of equal labels, null being one. The width of vectors is that of the least vec_id; rows of
    another width, or with components too large for distances to fit a long (beyond 131,071 at 64 components), are in no codebook
    and have null codes and errors. Fewer rows than entries give a codebook of so many; a width that parts don't divide is cut as
    evenly as can be. Repeated rows and equal ids count each time, rows without an id come last. An empty table gives an empty one.
    Other columns are not read, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index into a codebook is one byte")
    ship(vectors.sparkSession)
    found = whole_numbers(vectors, vector)
    least = found.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.size("ints")).first()
    width = least[0] if least else 0
    fits = found.where(_fits(width))
    books = fit(fits, width, parts, entries, rounds)
    codes = encode(fits, books)
    keyed = codes.withColumn("key", key_of("label"))
    by_label = keyed.groupBy("key").agg(F.try_sum("error").alias("label_error"))
    out = spread_join(keyed, by_label, "key", [], codes.count()).drop("key")
    none = found.where(~_fits(width)).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"))
    return out.select(none.columns).union(none).withColumn("codebooks_sha256", F.lit(digest(books)))


def decode(code: bytes, books: Sequence[Codebook]) -> list[int]:
    """The vector that a code stands for, in whole numbers."""
    return [x for b, i in zip(books, code, strict=True) for x in b.entries[i].tolist()]


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    far = lambda width: f"list_sum(list_transform(range(1, {width} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS (SELECT rid, v.p AS p, e, d FROM (SELECT v.rid, v.p, c.e, {far('len(v.x)')} AS d FROM v JOIN c{r} c ON v.p = c.p) v QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (SELECT p, e, list(floor(s)::BIGINT ORDER BY i) AS x FROM (
    SELECT v.p, a.e, i, (sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS s FROM a{r} a JOIN v ON v.rid = a.rid AND v.p = a.p, range(1, len(v.x) + 1) t(i) GROUP BY v.p, a.e, i) GROUP BY p, e),
c{r + 1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH k AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS rid, * FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS ints FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
),
v AS (SELECT rid, p, ints[p * len(ints) // {PARTS} + 1 : (p + 1) * len(ints) // {PARTS}] AS x FROM k, range({PARTS}) t(p)),
c0 AS (SELECT p, rid AS e, x FROM v WHERE rid < {ENTRIES}),{','.join(steps)},
per AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN per USING (rid), b
"""


OP11_SQL = _sql()
