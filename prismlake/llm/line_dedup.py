"""Line dedup by site-relative frequency, in Spark's own expressions.

For each host the share of its pages that hold a line is taken; lines above the boilerplate ratio are dropped from the
host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import documents, fresh, kept, key_of, small, spread_join

#: A line is dropped if more than this share of the host's pages has it, on at least so many pages.
RATIO, PAGES = 0.08, 8
#: Hosts whose lists are sent to all executors at most; with more, or with more bytes than storage.SENT, pages are dealt by
#: host, those of a large host over many tasks.
HOSTS = 20_000
SPACES = " \t\r\x0b\x0c"


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(SPACES)))


def _hash(line: Column) -> Column:
    """Of the normalised line; null if nothing is left of it."""
    found = normal(line)
    return F.when(found != "", F.xxhash64(found))


def boilerplate(docs: DataFrame, ratio: float = RATIO, pages: int = PAGES, site: str = "source") -> DataFrame:
    """(host, frequent: array<long>): at most (lines of a mean page / ratio) hashes for a host."""
    lines = docs.select(key_of(site).alias("host"), F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _hash))).alias("line")).where("line IS NOT NULL")
    counted = kept(lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= pages), "site-counts")
    totals = docs.groupBy(key_of(site).alias("host")).agg(F.count("*").alias("total"))
    shared = spread_join(counted, totals, "host", ["line"], counted.count())
    return shared.where(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("line").alias("frequent"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, pages: int = PAGES, site: str = "source") -> DataFrame:
    """docs, whose column `site` names their host, with `text` freed of its host's boilerplate lines, and n_lines and n_dropped added.

    A null text stays null and has no lines; a null source is a host of its own; a repeated row is a page each time; pages of
    any length are taken whole; an empty table gives an empty one. Lines without a word are neither counted nor dropped.
    Other columns pass through, whatever their names; n_lines and n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    host, frequent, lines, hashes, hits, stay = fresh(docs, "_host", "_frequent", "_lines", "_hashes", "_hits", "_stay")
    found = kept(boilerplate(docs, ratio, pages, site), "site-lines")
    hosted, few = docs.withColumn(host, key_of(site)), small(found, HOSTS)
    named = few.toDF(host, frequent)
    joined = spread_join(hosted, named, host, [], docs.count(), "left") if few is found else hosted.join(named, host, "left")
    out = joined.withColumn(lines, F.split("text", "\n")).withColumn(hashes, F.when(F.col(frequent).isNotNull(), F.transform(lines, _hash)))
    out = out.withColumn(hits, F.array_intersect(hashes, frequent))  # by a hash set, so that long lists cost no more
    gone = lambda x: F.coalesce(F.array_contains(F.col(hits), x["hash"]), F.lit(False))
    zipped = F.arrays_zip(F.col(lines).alias("line"), F.col(hashes).alias("hash"))
    rest = F.transform(F.filter(zipped, lambda x: ~gone(x)), lambda x: x["line"])
    out = out.withColumn(stay, F.when(F.size(hits) > 0, rest).otherwise(F.col(lines)))
    none = F.lit(0).cast("long")
    n_lines, n_left = (F.when(F.col("text").isNull(), none).otherwise(F.size(c).cast("long")) for c in (lines, stay))
    text = F.when(F.size(stay) < F.size(lines), F.array_join(stay, "\n")).otherwise(F.col("text"))
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, n_lines.alias("n_lines"), (n_lines - n_left).alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SPACES = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(source, chr(1)) AS host FROM documents),
l AS (
    SELECT rid, host, i, line, lower(trim(line, {_SPACES})) AS norm
    FROM (SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL)
),
totals AS (SELECT host, count(*) AS total FROM d GROUP BY host),
bad AS (
    SELECT host, norm FROM (SELECT host, norm, count(DISTINCT rid) AS n FROM l WHERE norm <> '' GROUP BY host, norm) JOIN totals USING (host)
    WHERE n >= {PAGES} AND n > CAST({RATIO} AS DOUBLE) * total
),
marked AS (SELECT l.*, b.norm IS NOT NULL AS gone FROM l LEFT JOIN bad b ON l.host = b.host AND l.norm = b.norm),
per AS (
    SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
    FROM marked GROUP BY rid
)
SELECT doc_id, source, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (rid)
"""
