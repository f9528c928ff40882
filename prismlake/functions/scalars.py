"""Queries of single functions over whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.functions.backends import quality
from prismlake.functions.media import cosine_distance, eye_aspect_ratio, hamming, l2, media_type
from prismlake.ordering import numbered
from prismlake.registry import query
from prismlake.shipping import ship
from prismlake.storage import kept


@query("hamming", with_views("media") + "SELECT a.ord, bit_count(xor(a.hash_hi, b.hash_hi))::BIGINT + bit_count(xor(a.hash_lo, b.hash_lo))::BIGINT AS bits FROM media a JOIN media b ON b.ord = a.ord + 1")
def hamming_query(spark, d):
    m = fixtures.media(spark, d)
    a, b = m.alias("a"), m.withColumn("ord", F.col("ord") - 1).alias("b")
    return a.join(b, F.col("a.ord") == F.col("b.ord")).select("a.ord", hamming([F.col("a.hash_hi"), F.col("a.hash_lo")], [F.col("b.hash_hi"), F.col("b.hash_lo")]).alias("bits"))


@query("hash_hex", with_views("media") + "SELECT ord, printf('%08x%08x', hash_hi, hash_lo) AS hash FROM media")
def hash_hex(spark, d):
    word = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return fixtures.media(spark, d).select("ord", F.concat(word("hash_hi"), word("hash_lo")).alias("hash"))


@query("capture_time", with_views("exif") + """SELECT asset_id, epoch_us(coalesce(try_strptime(dt1, '%Y:%m:%d %H:%M:%S'), try_strptime(dt2, '%Y:%m:%d %H:%M:%S'), try_strptime(dt3, '%Y:%m:%d %H:%M:%S'), try_strptime(modified, '%Y-%m-%dT%H:%M:%S'), try_strptime(modified, '%Y-%m-%dT%H:%M:%S%z')::TIMESTAMP)) AS taken_us FROM exif""")
def capture_time(spark, d):
    """The first of three EXIF times that can be read, else the file's time, whose zone counts if it has one; microseconds in UTC."""
    return fixtures.exif(spark, d).select("asset_id", taken(["dt1", "dt2", "dt3"], "modified").alias("taken_us"))


def taken(exif: list[str], modified: str) -> Column:
    parse = lambda c, form: fixtures.micros(F.try_to_timestamp(c, F.lit(form)).cast("timestamp_ntz"))
    zoned = F.unix_micros(F.try_to_timestamp(modified, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    return F.coalesce(*(parse(c, "yyyy:MM:dd HH:mm:ss") for c in exif), parse(modified, "yyyy-MM-dd'T'HH:mm:ss"), zoned)


@query("hex_hash", with_views("media") + "SELECT ord, hash_hi, hash_lo FROM media")
def hex_hash(spark, d):
    """Hashes back from their text."""
    text = hash_hex(spark, d)
    word = lambda first: F.conv(F.substring("hash", first, 8), 16, 10).cast("long")
    return text.select("ord", word(1).alias("hash_hi"), word(9).alias("hash_lo"))


@query("day_bounds", """WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '2024-13-01' ELSE '2024-0' || (c_custkey % 9 + 1) || '-1' || (c_custkey % 8) END AS day FROM customer)
    SELECT c_custkey, epoch_us(try_strptime(day, '%Y-%m-%d')) AS start_us, epoch_us(try_strptime(day, '%Y-%m-%d') + INTERVAL 1 DAY - INTERVAL 1 SECOND) AS end_us FROM t""")
def day_bounds(spark, d):
    """First and last second of a day given as text, in UTC; null for what isn't a day."""
    k = F.col("c_custkey")
    day = F.when(k % 5 == 1, "").when(k % 5 == 2, "2024-13-01").when(k % 5 != 0, F.concat(F.lit("2024-0"), k % 9 + 1, F.lit("-1"), k % 8))
    return fixtures.table(spark, d, "customer").select("c_custkey", day_bound(day).alias("start_us"), day_bound(day, end=True).alias("end_us"))


def day_bound(day: Column, end: bool = False) -> Column:
    start = fixtures.micros(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))
    return start + (86_400 - 1) * 1_000_000 if end else start


@query("json_digest", "SELECT c_custkey, sha256('{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\"}') AS digest FROM customer")
def json_digest(spark, d):
    document = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    return fixtures.table(spark, d, "customer").select("c_custkey", F.sha2(document, 256).alias("digest"))


_POINTS = "list_transform(range(0, 6), lambda i: {'x': embedding[2 * i + 1]::DOUBLE, 'y': embedding[2 * i + 2]::DOUBLE})"
_FAR = lambda i, j: f"sqrt(pow(p[{i + 1}].x - p[{j + 1}].x, 2) + pow(p[{i + 1}].y - p[{j + 1}].y, 2))"


@query("eye_aspect_ratio", f"WITH e AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN {_POINTS}[1:5] ELSE {_POINTS} END AS p FROM embeddings) SELECT vec_id, round(CASE WHEN len(p) < 6 OR {_FAR(0, 3)} = 0 THEN 1 ELSE ({_FAR(1, 5)} + {_FAR(2, 4)}) / (2 * {_FAR(0, 3)}) END, 6) AS ear FROM e")
def eye_aspect_ratio_query(spark, d):
    points = F.array(*(F.struct(F.col("embedding")[2 * i].cast("double").alias("x"), F.col("embedding")[2 * i + 1].cast("double").alias("y")) for i in range(6)))
    some = F.when(F.col("vec_id") % 9 == 0, F.slice(points, 1, 5)).otherwise(points)
    return fixtures.table(spark, d, "embeddings").select("vec_id", some.alias("p")).select("vec_id", F.round(F.when(F.size("p") < 6, 1.0).otherwise(eye_aspect_ratio(F.col("p"))), 6).alias("ear"))


_PAIR = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query("face_l2", f"SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))), 6) AS distance {_PAIR}")
def face_l2(spark, d):
    return _next_to(spark, d).select("a.vec_id", F.round(l2(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance"))


_DOT = lambda x, y: f"list_sum(list_transform(range(1, 65), lambda i: {x}.embedding[i]::DOUBLE * {y}.embedding[i]::DOUBLE))"


@query("face_cosine", f"SELECT a.vec_id, round(1 - {_DOT('a', 'b')} / (sqrt({_DOT('a', 'a')}) * sqrt({_DOT('b', 'b')}) + 1e-10), 6) AS distance {_PAIR}")
def face_cosine(spark, d):
    return _next_to(spark, d).select("a.vec_id", F.round(cosine_distance(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance"))


def _next_to(spark, d):
    e = fixtures.table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.alias("a").join(e.withColumn("vec_id", F.col("vec_id") - 1).alias("b"), F.col("a.vec_id") == F.col("b.vec_id"))


#: Scores that a task holds at once, about.
SCORES = 1_000_000


def nearest(vectors: DataFrame, wanted: DataFrame, k: int = 20, block: int = 4_000) -> DataFrame:
    """(query_id, vec_id, score): for each row of wanted (vec_id, embedding) the k rows of vectors with the largest dot product, ties by vec_id.

    Queries go to executors in blocks, so that no more than `block` vectors are held at once however many there are; each task
    keeps the k best of its rows, and only these are ordered by query.
    """
    ids = numbered(kept(wanted.select("vec_id").where("vec_id IS NOT NULL").distinct(), "queries"), "vec_id", "_n", wanted.count())
    placed = kept(wanted.join(ids, "vec_id").withColumn("_block", F.floor((F.col("_n") - 1) / block)), "blocks")
    found = []
    for i in range((placed.agg(F.max("_block")).first()[0] or 0) + 1):
        rows = placed.where(F.col("_block") == i).select("vec_id", "embedding").collect()  # `block` rows at most
        if rows:
            found.append(_best_of_batches(vectors, [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), k))
    if not found:
        return vectors.where("false").select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"))
    at = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return reduce(DataFrame.union, found).withColumn("_r", F.row_number().over(at)).where(F.col("_r") <= k).drop("_r")


def _best_of_batches(vectors: DataFrame, ids: list[int], queries: np.ndarray, k: int) -> DataFrame:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, step = len(ids), max(1, SCORES // len(ids))
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, row and score of the best so far
        least, waiting = np.full(n, -np.inf), 0
        parts = [held]

        def settle() -> None:
            """Leaves the k best of each query."""
            nonlocal held, parts, waiting
            q, own, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort([own, -score, q])
            q, own, score = q[order], own[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            held = [x[place < k] for x in (q, own, score)]
            least[q[place == k - 1]] = score[place == k - 1]
            parts, waiting = [held], 0

        for batch in batches:
            for a in range(0, batch.num_rows, step):
                rows = batch.slice(a, step)
                own = rows["vec_id"].to_numpy()
                scores = np.round(rows["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1) @ queries.T, 5)
                r, q = np.nonzero(~(scores < least))
                parts.append([q, own[r], scores[r, q]])
                waiting += len(q)
                if waiting > max(SCORES // 4, n * k):
                    settle()
        settle()
        q, own, score = held
        for a in range(0, len(q), 100_000):
            at = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[q[at]]), pa.array(own[at]), pa.array(score[at])], names=["query_id", "vec_id", "score"])

    ship(vectors.sparkSession)
    return vectors.select("vec_id", "embedding").mapInArrow(best, "query_id bigint, vec_id bigint, score double")


@query("vector_topk", """SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 5) AS score
    FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= 20""")
def vector_topk(spark, d):
    """The rows nearest to each row whose id is divisible by 50: a page of a ranked search for each."""
    e = fixtures.table(spark, d, "embeddings")
    return nearest(e, e.where("vec_id % 50 = 0"))


@query("eye_contour", """WITH b AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 10)::BIGINT AS cx, (l_quantity * 4)::BIGINT AS cy, greatest(5, floor(l_extendedprice / 100 / 8)::BIGINT) AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, cx - r AS x0, cx + r AS x3, cy - r // 2 AS y_up, cy + r // 2 AS y_down, round((r // 2) / r::DOUBLE, 6) AS ear FROM b""")
def eye_contour(spark, d):
    """Six points around an eye's centre; such an eye has the ratio of its half to its whole radius, and is never closed."""
    cx, cy = F.floor(F.col("l_extendedprice") / 10).cast("long"), (F.col("l_quantity") * 4).cast("long")
    r = F.greatest(F.lit(5), F.floor(F.col("l_extendedprice") / 100 / 8)).cast("long")
    rows = fixtures.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cx.alias("cx"), cy.alias("cy"), r.alias("r"))
    half = F.floor(F.col("r") / 2)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("cx"), F.col("cy")
    ring = F.array(point(x - F.col("r"), y), point(x - half, y - half), point(x + half, y - half), point(x + F.col("r"), y), point(x + half, y + half), point(x - half, y + half))
    return rows.select("l_orderkey", "l_linenumber", (x - F.col("r")).alias("x0"), (x + F.col("r")).alias("x3"), (y - half).alias("y_up"), (y + half).alias("y_down"), F.round(eye_aspect_ratio(ring), 6).alias("ear"))


@query("landmark_box", """WITH p AS (SELECT vec_id, list_transform(range(1, 65, 2), lambda i: embedding[i]) AS xs, list_transform(range(2, 65, 2), lambda i: embedding[i]) AS ys FROM embeddings)
    SELECT vec_id, greatest(0, trunc(list_min(ys)::DOUBLE * 480))::BIGINT AS top, least(640, trunc(list_max(xs)::DOUBLE * 640))::BIGINT AS rgt,
        least(480, trunc(list_max(ys)::DOUBLE * 480))::BIGINT AS bottom, greatest(0, trunc(list_min(xs)::DOUBLE * 640))::BIGINT AS lft FROM p""")
def landmark_box(spark, d):
    """The box of a face's points, given as parts of the image's width and height."""
    part = lambda first: F.transform(F.sequence(F.lit(first), F.lit(63), F.lit(2)), lambda i: F.get("embedding", i).cast("double"))
    rows = fixtures.table(spark, d, "embeddings").select("vec_id", part(0).alias("xs"), part(1).alias("ys"))
    return rows.select("vec_id", F.inline(F.array(box_of(F.col("xs"), F.col("ys"), 640, 480))))


def box_of(xs: Column, ys: Column, width: int, height: int) -> Column:
    """top, right, bottom and left in whole pixels, inside the image."""
    low = lambda c, n: F.greatest(F.lit(0).cast("long"), (F.array_min(c) * n).cast("long"))
    high = lambda c, n: F.least(F.lit(n).cast("long"), (F.array_max(c) * n).cast("long"))
    return F.struct(low(ys, height).alias("top"), high(xs, width).alias("rgt"), high(ys, height).alias("bottom"), low(xs, width).alias("lft"))


@query("quality_formula", "SELECT event_id, round(0.4::DOUBLE * greatest(0, least(1, (value / 100 - 0.2) / 1.5)) + 0.6::DOUBLE * greatest(0, least(1, (value / 50 - 0.2) / 1.0)), 6) AS quality FROM events")
def quality_formula(spark, d):
    return fixtures.table(spark, d, "events").select("event_id", F.round(quality(F.col("value") / 100, F.col("value") / 50), 6).alias("quality"))


@query("cache_key", "SELECT page_id, md5(url) AS cache_key FROM pages")
def cache_key(spark, d):
    return fixtures.table(spark, d, "pages").select("page_id", F.md5("url").alias("cache_key"))


@query("media_type_by_ext", """WITH f AS (SELECT doc_id, 'x/' || doc_id || ([ '.JPG', '.mov', '.txt', '', '.webp', '.MTS', '.tar.gz'])[doc_id % 7 + 1] AS path FROM documents)
    SELECT doc_id, CASE WHEN e IN ('.mp4', '.mov', '.avi', '.mkv', '.webm', '.m4v', '.wmv', '.flv', '.mpg', '.mpeg', '.3gp', '.mts') THEN 'VIDEO'
        WHEN e IN ('.jpg', '.jpeg', '.png', '.heic', '.cr2', '.nef', '.arw', '.dng', '.gif', '.webp') THEN 'IMAGE' END AS media_type FROM (SELECT doc_id, lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) AS e FROM f)""")
def media_type_by_ext(spark, d):
    ends = F.array(*map(F.lit, (".JPG", ".mov", ".txt", "", ".webp", ".MTS", ".tar.gz")))
    path = F.concat(F.lit("x/"), "doc_id", F.element_at(ends, (F.col("doc_id") % 7 + 1).cast("int")))
    return fixtures.table(spark, d, "documents").select("doc_id", media_type(path).alias("media_type"))
