"""Views of the driver's tables as media tables, once as DataFrames and once as SQL for the oracle.

Hashes are sign bits of embeddings; shots' times come from events; flags, sizes and paths are arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def sign_bits(vector: str, first: int, n: int = 32) -> Column:
    return F.aggregate(F.slice(vector, first, n), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0))


def _sign_sql(first: int, n: int = 32) -> str:
    return f"list_sum(list_transform(range({first}, {first + n}), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << ({first + n - 1} - i) ELSE 0 END))::BIGINT"


def media(spark: SparkSession, d: str) -> DataFrame:
    taken = table(spark, d, "events").where("event_id % 3 = 0").select((F.col("event_id") / 3).cast("long").alias("k"), micros("ts").alias("us"))
    e, v = table(spark, d, "embeddings"), F.col("vec_id")
    return e.join(taken, (v == F.col("k")) & (v % 7 != 0), "left").select(
        v.alias("ord"),
        F.concat(F.lit("p"), v).alias("photo_id"),
        F.when(v % 11 == 0, "VIDEO").otherwise("IMAGE").alias("media_type"),
        F.concat(F.lit("IMG_"), (v % 40).cast("string"), F.when(v % 2 == 0, ".JPG").otherwise(".png")).alias("filename"),
        (v * 7919 % 5000 + 1000).alias("filesize"),
        F.concat((640 + v % 5 * 160).cast("string"), F.lit("x"), (480 + v % 3 * 120).cast("string")).alias("dimensions"),
        F.col("us").alias("taken_us"),
        (v % 5 == 0).alias("is_favorite"),
        (v % 9 == 0).alias("is_archived"),
        F.concat(F.lit("person"), F.col("label").cast("string")).alias("person"),
        sign_bits("embedding", 1).alias("hash_lo"),
        sign_bits("embedding", 33).alias("hash_hi"),
        (v * 13 % 101 / 10).alias("score"),
    )


SQL = {
    "media": f"""
        SELECT vec_id AS ord, 'p' || vec_id AS photo_id, CASE WHEN vec_id % 11 = 0 THEN 'VIDEO' ELSE 'IMAGE' END AS media_type,
            'IMG_' || (vec_id % 40) || CASE WHEN vec_id % 2 = 0 THEN '.JPG' ELSE '.png' END AS filename, vec_id * 7919 % 5000 + 1000 AS filesize,
            (640 + vec_id % 5 * 160) || 'x' || (480 + vec_id % 3 * 120) AS dimensions, epoch_us(ts) AS taken_us, vec_id % 5 = 0 AS is_favorite,
            vec_id % 9 = 0 AS is_archived, 'person' || label AS person, {_sign_sql(1)} AS hash_lo, {_sign_sql(33)} AS hash_hi, vec_id * 13 % 101 / 10.0::DOUBLE AS score
        FROM embeddings LEFT JOIN events ON event_id = vec_id * 3 AND vec_id % 7 <> 0""",
    "video": f"""
        SELECT vec_id // 5 AS ord, list({_sign_sql(1, 16)} ORDER BY vec_id) AS frames, max(CASE WHEN vec_id % 5 = 2 AND vec_id % 15 <> 2 THEN {_sign_sql(1, 16)} END) AS thumb,
            CASE WHEN min(vec_id) % 4 = 0 THEN 0::DOUBLE ELSE (min(vec_id) % 60 + 1)::DOUBLE END AS duration
        FROM embeddings GROUP BY vec_id // 5""",
    "clips": f"""
        SELECT vec_id // 5 * 3 + c AS ord, list(xor(({_sign_sql(33)} % 2147483648) * 4294967296 + {_sign_sql(1)}, c * (vec_id * 7919 % 4096)) ORDER BY vec_id) AS frames,
            max(CASE WHEN vec_id % 5 = 2 AND (vec_id + c) % 4 <> 0 THEN xor(({_sign_sql(33)} % 2147483648) * 4294967296 + {_sign_sql(1)}, c * 21) END) AS thumb,
            CASE WHEN min(vec_id) % 4 = 0 THEN 0::DOUBLE ELSE (min(vec_id) % 60 + 1 + c)::DOUBLE END AS duration
        FROM embeddings, range(3) t(c) GROUP BY vec_id // 5, c""",
    "person_asset": "SELECT DISTINCT l_suppkey AS person_id, l_orderkey AS asset_id FROM lineitem",
    "people": "SELECT s_suppkey AS person_id, CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE s_name END AS name, s_suppkey % 3 = 0 AS is_favorite, s_suppkey % 8 = 0 AS hidden FROM supplier",
    "faces": """
        SELECT l_orderkey AS asset_id, l_orderkey // 32 AS group_index, (l_quantity * 2)::BIGINT AS top, (l_quantity * 2)::BIGINT + l_linenumber * 7 AS bottom,
            floor(l_extendedprice / 100)::BIGINT AS lft, floor(l_extendedprice / 100)::BIGINT + (l_quantity)::BIGINT AS rgt, (l_discount * 100)::BIGINT AS smiles, l_linenumber::BIGINT AS eyes
        FROM lineitem WHERE l_orderkey % 5 <> 0""",
    "face_encoding": """
        SELECT vec_id AS face_id, vec_id // 10 AS group_index, vec_id // 2 AS asset_id, embedding AS enc, (abs(embedding[9]) * 2)::DOUBLE AS left_ear, (abs(embedding[10]) * 2)::DOUBLE AS right_ear FROM embeddings""",
    "native_dup": """
        SELECT doc_id AS photo_id, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN md5(text) END AS duplicate_group FROM documents""",
    "assets": """
        SELECT page_id AS ord, 'a' || page_id AS asset_id, CASE page_id % 4 WHEN 0 THEN 'upload/' WHEN 1 THEN 'library/' WHEN 2 THEN '' ELSE 'other/' END || 'd' || (page_id % 7) || '/f' || (page_id % 90) || '.jpg' AS path,
            length(html) AS filesize, page_id % 6 = 0 AS is_archived, CASE WHEN page_id % 5 = 0 THEN 'VIDEO' ELSE 'IMAGE' END AS media_type FROM pages""",
    "local_files": """
        SELECT page_id AS ord, 'd' || (page_id % 9) || '/f' || (page_id % 95) || '.jpg' AS path, length(html) AS filesize FROM pages""",
    "sync_local": "SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS is_favorite, o_orderkey % 3 = 0 AS is_archived FROM orders WHERE o_orderkey % 17 <> 0",
    "sync_remote": "SELECT o_orderkey AS asset_id, o_orderkey % 5 < 2 AS is_favorite, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 7 < 3 END AS is_archived FROM orders WHERE o_orderkey % 19 <> 0",
    "sync_snapshot": "SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 4 < 2 END AS is_favorite, o_orderkey % 6 < 3 AS is_archived FROM orders",
    "exif": """
        SELECT event_id AS asset_id, CASE WHEN event_id % 5 = 0 THEN 'bad' WHEN event_id % 5 = 1 THEN NULL ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END AS dt1,
            CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS dt2, CASE WHEN event_id % 7 = 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS dt3,
            CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 8 = 1 THEN '+02:00' ELSE '' END END AS modified,
            CASE event_id % 6 WHEN 0 THEN '1/' || (event_id % 9) WHEN 1 THEN '' || (event_id % 7) WHEN 2 THEN 'x' WHEN 3 THEN NULL WHEN 4 THEN '1/0' ELSE '0.5' END AS exposure,
            CASE WHEN event_id % 2 = 0 THEN '1/30' END AS exposure2, event_id // 4 AS group_index FROM events""",
}


def video(spark: SparkSession, d: str) -> DataFrame:
    e, v = table(spark, d, "embeddings"), F.col("vec_id")
    bits = sign_bits("embedding", 1, 16)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(v, bits.alias("h")))), lambda x: x["h"])
    grouped = e.groupBy(F.floor(v / 5).cast("long").alias("ord")).agg(ordered.alias("frames"), F.max(F.when((v % 5 == 2) & (v % 15 != 2), bits)).alias("thumb"), F.min(v).alias("lo"))
    return grouped.select("ord", "frames", "thumb", F.when(F.col("lo") % 4 == 0, F.lit(0.0)).otherwise((F.col("lo") % 60 + 1).cast("double")).alias("duration"))


def clips(spark, d):
    """Three cuts of each video, whose frames differ in some of 63 bits."""
    v, c = F.col("vec_id"), F.col("c")
    bits = sign_bits("embedding", 33) % (1 << 31) * (1 << 32) + sign_bits("embedding", 1)
    rows = table(spark, d, "embeddings").select("vec_id", bits.alias("bits")).withColumn("c", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(v, F.col("bits").bitwiseXOR(c * (v * 7919 % 4096)).alias("h")))), lambda x: x["h"])
    thumb = F.max(F.when((v % 5 == 2) & ((v + c) % 4 != 0), F.col("bits").bitwiseXOR(c * 21)))
    grouped = rows.groupBy(F.floor(v / 5).cast("long").alias("g"), "c").agg(ordered.alias("frames"), thumb.alias("thumb"), F.min(v).alias("lo"))
    return grouped.select((F.col("g") * 3 + c).alias("ord"), "frames", "thumb", F.when(F.col("lo") % 4 == 0, F.lit(0.0)).otherwise((F.col("lo") % 60 + 1 + c).cast("double")).alias("duration"))


def person_asset(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("asset_id")).distinct()


def people(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("person_id"), F.when(k % 10 == 9, "").otherwise(F.col("s_name")).alias("name"), (k % 3 == 0).alias("is_favorite"), (k % 8 == 0).alias("hidden"))


def faces(spark, d):
    top, left = (F.col("l_quantity") * 2).cast("long"), F.floor(F.col("l_extendedprice") / 100)
    return table(spark, d, "lineitem").where("l_orderkey % 5 <> 0").select(
        F.col("l_orderkey").alias("asset_id"), F.floor(F.col("l_orderkey") / 32).cast("long").alias("group_index"), top.alias("top"), (top + F.col("l_linenumber") * 7).alias("bottom"),
        left.alias("lft"), (left + F.col("l_quantity").cast("long")).alias("rgt"), F.round(F.col("l_discount") * 100).cast("long").alias("smiles"), F.col("l_linenumber").cast("long").alias("eyes"),
    )


def face_encoding(spark, d):
    v = F.col("vec_id")
    ear = lambda i: (F.abs(F.col("embedding")[i]) * 2).cast("double")
    return table(spark, d, "embeddings").select(v.alias("face_id"), F.floor(v / 10).cast("long").alias("group_index"), F.floor(v / 2).cast("long").alias("asset_id"), F.col("embedding").alias("enc"), ear(8).alias("left_ear"), ear(9).alias("right_ear"))


def native_dup(spark, d):
    from pyspark.sql import Window

    own = table(spark, d, "documents").select(F.col("doc_id").alias("photo_id"), F.sha2("text", 256).alias("digest"), F.md5("text").alias("md5"))
    many = F.count("*").over(Window.partitionBy("digest")) > 1  # texts are not shuffled
    return own.select("photo_id", F.when(many, F.col("md5")).alias("duplicate_group"))


def _path(k: Column, folders: int, files: int) -> Column:
    return F.concat(F.lit("d"), k % folders, F.lit("/f"), k % files, F.lit(".jpg"))


def assets(spark, d):
    k = F.col("page_id")
    prefix = F.element_at(F.array(*map(F.lit, ("upload/", "library/", "", "other/"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "pages").select(
        k.alias("ord"), F.concat(F.lit("a"), k).alias("asset_id"), F.concat(prefix, _path(k, 7, 90)).alias("path"), F.length("html").cast("long").alias("filesize"),
        (k % 6 == 0).alias("is_archived"), F.when(k % 5 == 0, "VIDEO").otherwise("IMAGE").alias("media_type"),
    )


def local_files(spark, d):
    k = F.col("page_id")
    return table(spark, d, "pages").select(k.alias("ord"), _path(k, 9, 95).alias("path"), F.length("html").cast("long").alias("filesize"))


def _flags(spark, d, favorite, archived, where):
    return table(spark, d, "orders").where(where).selectExpr("o_orderkey AS asset_id", f"{favorite} AS is_favorite", f"{archived} AS is_archived")


def sync_local(spark, d):
    return _flags(spark, d, "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END", "o_orderkey % 3 = 0", "o_orderkey % 17 <> 0")


def sync_remote(spark, d):
    return _flags(spark, d, "o_orderkey % 5 < 2", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 7 < 3 END", "o_orderkey % 19 <> 0")


def sync_snapshot(spark, d):
    return _flags(spark, d, "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 4 < 2 END", "o_orderkey % 6 < 3", "true")


def exif(spark, d):
    k, ts = F.col("event_id"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    exposure = F.when(k % 6 == 0, F.concat(F.lit("1/"), k % 9)).when(k % 6 == 1, (k % 7).cast("string")).when(k % 6 == 2, "x").when(k % 6 == 4, "1/0").when(k % 6 == 5, "0.5")
    return table(spark, d, "events").select(
        k.alias("asset_id"), F.when(k % 5 == 0, "bad").when(k % 5 != 1, ts).alias("dt1"), F.when(k % 3 == 0, ts).alias("dt2"), F.when(k % 7 == 0, ts).alias("dt3"),
        F.when(k % 4 != 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 8 == 1, "+02:00").otherwise(""))).alias("modified"), exposure.alias("exposure"), F.when(k % 2 == 0, "1/30").alias("exposure2"),
        F.floor(k / 4).cast("long").alias("group_index"),
    )


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "
