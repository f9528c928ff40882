"""Calendar batches that overlap, and other cuts of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.ordering import per_key
from prismlake.registry import query

SECOND = "interval 1 second"


def time_batches(rows: DataFrame, months: int = 6, overlap_days: int = 7, first_year: int = 2003) -> DataFrame:
    """(batch, start_at, end_at, core_start, core_end) over the dates `ts` of rows from first_year on.

    Cores begin on the first of a month and end on the last second of one. Batches reach overlap_days further at both
    ends, but for the first one's start and the last one's end.
    """
    ends = rows.where(F.year("ts") >= first_year).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).where("lo IS NOT NULL")
    last = (F.date_add(F.last_day(F.col("hi").cast("date")), 1).cast("timestamp_ntz") - F.expr(SECOND)).alias("last")
    first = F.trunc(F.col("lo").cast("date"), "month").alias("first")
    cores = ends.select(first, last, F.explode(F.sequence(first, F.col("hi").cast("date"), F.expr(f"interval {months} month"))).alias("core"))
    core_end = F.least(F.add_months("core", months).cast("timestamp_ntz") - F.expr(SECOND), F.col("last"))
    cut = cores.select(
        (F.months_between("core", "first") / months + 1).cast("long").alias("batch"), F.col("core").cast("timestamp_ntz").alias("core_start"), core_end.alias("core_end"), "first", "last"
    )
    reach = F.expr(f"interval {overlap_days} day")
    start = F.when(F.col("batch") > 1, F.col("core_start") - reach).otherwise(F.col("core_start"))
    end = F.when(F.col("core_end") < F.col("last"), F.col("core_end") + reach).otherwise(F.col("core_end"))
    return cut.select("batch", start.alias("start_at"), end.alias("end_at"), "core_start", "core_end")


def chunked(rows: DataFrame, order: Column, size: int, per: str) -> DataFrame:
    """Rows of each `per` in chunks of `size`, numbered from 0; places are made by ranges of the order, so that one `per` may have most rows."""
    return per_key(rows, per, [order], F.lit(1), "_place", rows.count()).withColumn("chunk", F.floor(F.col("_place") / size).cast("long")).drop("_place")


def evicted(files: DataFrame, need: Column) -> DataFrame:
    """(bucket, file_id) of the files (bucket, file_id, size, used_at) that go: the longest unused, until what is needed is free."""
    return per_key(files, "bucket", [F.col("used_at"), F.col("file_id")], F.col("size"), "freed", files.count()).where(F.col("freed") < need)


_BATCHES = """
ends AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders WHERE year(o_orderdate) >= 1993),
base AS (SELECT date_trunc('month', lo)::TIMESTAMP AS first, (date_trunc('month', hi) + INTERVAL 1 MONTH - INTERVAL 1 SECOND)::TIMESTAMP AS last, hi FROM ends),
cores AS (SELECT unnest(generate_series(first, hi, INTERVAL 6 MONTH)) AS core_start, first, last FROM base),
cut AS (SELECT row_number() OVER (ORDER BY core_start) AS batch, core_start, least(core_start + INTERVAL 6 MONTH - INTERVAL 1 SECOND, last) AS core_end, last FROM cores),
batches AS (SELECT batch, CASE WHEN batch > 1 THEN core_start - INTERVAL 7 DAY ELSE core_start END AS start_at, CASE WHEN core_end < last THEN core_end + INTERVAL 7 DAY ELSE core_end END AS end_at, core_start, core_end FROM cut)"""


def _dated(spark, d) -> DataFrame:
    return fixtures.table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz"))


@query("time_batches", f"WITH {_BATCHES} SELECT batch, epoch_us(start_at) AS start_us, epoch_us(end_at) AS end_us, epoch_us(core_start) AS core_start_us, epoch_us(core_end) AS core_end_us FROM batches")
def time_batches_query(spark, d):
    found = time_batches(_dated(spark, d), first_year=1993)
    return found.select("batch", *(fixtures.micros(c).alias(n) for c, n in (("start_at", "start_us"), ("end_at", "end_us"), ("core_start", "core_start_us"), ("core_end", "core_end_us"))))


@query("rows_per_batch", f"WITH {_BATCHES} SELECT batch, count(*) AS n FROM batches JOIN orders ON o_orderdate BETWEEN start_at AND end_at GROUP BY batch")
def rows_per_batch(spark, d):
    rows = _dated(spark, d)
    batches = time_batches(rows, first_year=1993)  # two a year
    return rows.join(F.broadcast(batches), F.col("ts").between(F.col("start_at"), F.col("end_at"))).groupBy("batch").agg(F.count("*").alias("n"))


@query("batch_chunks", "WITH r AS (SELECT c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 200 AS chunk, c_custkey FROM customer) SELECT c_mktsegment, chunk, count(*) AS n, min(c_custkey) AS first_id FROM r GROUP BY ALL")
def batch_chunks(spark, d):
    rows = chunked(fixtures.table(spark, d, "customer"), F.col("c_custkey"), 200, "c_mktsegment")
    return rows.groupBy("c_mktsegment", "chunk").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_id"))


@query("cache_evict", """WITH f AS (SELECT user_id % 50 AS bucket, event_id AS file_id, event_id * 37 % 1000 + 1 AS size, ts AS used_at FROM events),
    r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY bucket ORDER BY used_at, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed FROM f)
    SELECT bucket, file_id, size, freed FROM r WHERE freed < 5000""")
def cache_evict(spark, d):
    k = F.col("event_id")
    files = fixtures.table(spark, d, "events").select((F.col("user_id") % 50).alias("bucket"), k.alias("file_id"), (k * 37 % 1000 + 1).alias("size"), F.col("ts").alias("used_at"))
    return evicted(files, F.lit(5000)).select("bucket", "file_id", "size", "freed")


@query("limit_first", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 25")
def limit_first(spark, d):
    return fixtures.table(spark, d, "events").orderBy("ts", "event_id").limit(25).select("event_id", "event_type")
