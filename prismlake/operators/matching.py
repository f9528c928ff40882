"""Matching of local paths to catalogue records, in order of certainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.functions.media import basename
from prismlake.registry import query
from prismlake.storage import kept

#: What a catalogue may put before a path.
PREFIXES = ["", "upload/", "library/"]


def keep_last(assets: DataFrame) -> DataFrame:
    """One record for each path: the last."""
    return assets.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.col("ord").desc()))).where("_r = 1").drop("_r")


def cascade_match(files: DataFrame, assets: DataFrame) -> DataFrame:
    """(ord, path, asset_id, step): each local file's record, or null.

    First by the path itself, then after a prefix, then by a file name that one record alone has, then, of several records
    of the name, the first of equal size. All are equal joins, so no file is compared with all records.
    """
    records = kept(keep_last(assets).withColumn("name", basename(F.col("path"))), "records")
    paths = files.select("ord", "path", "filesize", basename(F.col("path")).alias("name"))
    tried = paths.withColumn("t", F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.concat(F.lit(p), "path").alias("try")) for i, p in enumerate(PREFIXES)))))
    by_path = tried.select("ord", "t.step", F.col("t.try").alias("path")).join(records.select("path", "asset_id", F.col("ord").alias("place")), "path").select("ord", "step", "place", "asset_id")
    names = records.groupBy("name").agg(F.count("*").alias("n"), F.min("asset_id").alias("only"))
    alone = paths.join(names.where("n = 1"), "name").select("ord", F.lit(10).alias("step"), F.lit(0).cast("long").alias("place"), F.col("only").alias("asset_id"))
    several = paths.join(names.where("n > 1").select("name"), "name").join(records.select("name", "filesize", "asset_id", F.col("ord").alias("place")), ["name", "filesize"])
    found = by_path.union(alone).union(several.select("ord", F.lit(11).alias("step"), "place", "asset_id"))
    best = found.groupBy("ord").agg(F.min(F.struct("step", "place", "asset_id")).alias("b"))
    return paths.join(best, "ord", "left").select("ord", "path", F.col("b.asset_id").alias("asset_id"), F.col("b.step").alias("step"))


_NAME = "regexp_extract(path, '[^/]*$')"
KEPT = f"kept AS (SELECT *, {_NAME} AS name FROM assets QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord DESC) = 1)"


@query("asset_map_keep_last", with_views("assets") + f", {KEPT} SELECT path, asset_id FROM kept")
def asset_map_keep_last(spark, d):
    return keep_last(fixtures.assets(spark, d)).select("path", "asset_id")


MATCHED = f"""{KEPT}, names AS (SELECT name, count(*) AS n, min(asset_id) AS lone FROM kept GROUP BY name),
f AS (SELECT *, {_NAME} AS name FROM local_files),
cand AS (
    SELECT f.ord, s.step, k.ord AS place, k.asset_id FROM f CROSS JOIN (VALUES (0, ''), (1, 'upload/'), (2, 'library/')) s(step, pre) JOIN kept k ON k.path = pre || f.path
    UNION ALL SELECT f.ord, 10, 0, lone FROM f JOIN names USING (name) WHERE n = 1
    UNION ALL SELECT f.ord, 11, k.ord, k.asset_id FROM f JOIN names USING (name) JOIN kept k ON k.name = f.name AND k.filesize = f.filesize WHERE n > 1
),
matched AS (SELECT f.ord, f.path, c.asset_id, c.step::INT AS step FROM f LEFT JOIN (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY ord ORDER BY step, place, asset_id) = 1) c USING (ord))"""


@query("hybrid_match", with_views("assets", "local_files") + f", {MATCHED} SELECT * FROM matched")
def hybrid_match(spark, d):
    return cascade_match(fixtures.local_files(spark, d), fixtures.assets(spark, d))


@query("hybrid_scan", with_views("assets", "local_files") + f", {MATCHED} SELECT m.ord, m.asset_id, k.media_type, m.path FROM matched m JOIN kept k USING (asset_id) WHERE k.media_type = 'IMAGE'")
def hybrid_scan(spark, d):
    """Local files that have a record, of one type."""
    assets = fixtures.assets(spark, d)
    matched = cascade_match(fixtures.local_files(spark, d), assets)
    return matched.join(keep_last(assets).where("media_type = 'IMAGE'").select("asset_id", "media_type"), "asset_id").select("ord", "asset_id", "media_type", "path")


@query("semi_search", with_views("media") + "SELECT ord, photo_id FROM media WHERE ord IN (SELECT doc_id * 3 FROM documents WHERE lang = 'en')")
def semi_search(spark, d):
    found = fixtures.table(spark, d, "documents").where("lang = 'en'").select((F.col("doc_id") * 3).alias("ord"))
    return fixtures.media(spark, d).select("ord", "photo_id").join(found, "ord", "left_semi")
