"""Which frames of a video are looked at."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from prismlake import fixtures
from prismlake.fixtures import with_views
from prismlake.functions.backends import video_hashes
from prismlake.functions.media import video_distance
from prismlake.registry import query
from prismlake.shipping import ship


def steps(count: Column, step: Column, most: int) -> Column:
    """0, step, 2 step … below count, `most` of them at most."""
    return F.when(count > 0, F.slice(F.sequence(F.lit(0).cast("long"), count - 1, F.greatest(step, F.lit(1)).cast("long")), 1, most)).otherwise(F.array().cast("array<long>"))


def interval_frames(count: Column, fps: Column, seconds: float = 5.0, most: int = 20) -> Column:
    step = (fps * seconds).cast("long")
    return steps(count, F.when(step > 0, step).otherwise(1), most)


def duration(count: Column, fps: Column) -> Column:
    """Seconds; 0 without a rate."""
    return F.when(fps > 0, count / fps).otherwise(0.0)


def codec(code: Column) -> Column:
    """The four characters of a codec's number, lowest byte first."""
    return F.concat(*(F.char(F.shiftright(code, 8 * i).bitwiseAND(F.lit(255))) for i in range(4)))


def thumbnail_frame(count: Column, part: float = 0.1) -> Column:
    return F.floor(count * F.lit(part)).cast("long")


def stride(count: Column) -> Column:
    """So that about 500 frames are sampled."""
    return F.greatest(F.lit(1), F.floor(count / 500)).cast("long")


def scene_changes(frames: DataFrame, probe: DataFrame, threshold: float = 30.0, most: int = 20, least: int = 3) -> DataFrame:
    """(video_id, position) of sampled frames (video_id, position, histogram) that differ from the last one kept.

    What is kept depends on what was kept before, so each video's frames, about 500, are folded in order. A video with fewer
    than `least` changes is taken at intervals of 5 seconds instead, by its probe (video_id, frames, fps); one without frames
    or rate gives none.
    """
    readable = probe.where("frames > 0 AND fps <> 0")
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != 0, (x - y) * (x - y) / x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.lit(None).cast("array<double>").alias("last"), F.array().cast("array<long>").alias("kept"))

    def step(state: Column, frame: Column) -> Column:
        full = (F.size(state["kept"]) >= most) & (F.size(state["kept"]) > 1)
        new = state["last"].isNull() | (~full & (far(state["last"], frame["histogram"]) > threshold))
        return F.when(new, F.struct(frame["histogram"].alias("last"), F.concat(state["kept"], F.array(frame["position"])).alias("kept"))).otherwise(state)

    ordered = frames.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("position", "histogram"))).alias("all"))
    walked = ordered.select("video_id", F.aggregate("all", start, step, lambda s: s["kept"]).alias("kept"))
    chosen = readable.join(walked, "video_id", "left")
    enough = F.coalesce(F.size("kept"), F.lit(0)) >= least
    return chosen.select("video_id", F.explode(F.when(enough, F.col("kept")).otherwise(interval_frames(F.col("frames"), F.col("fps"), 5.0, most))).alias("position"))


#: Strategies by name.
STRATEGIES = ("fixed_interval", "scene_change", "iframe")


def key_frames(probe: DataFrame, strategy: str, frames: DataFrame | None = None, most: int = 10, seconds: float = 5.0, threshold: float = 30.0) -> DataFrame:
    """(video_id, position) of each video of probe (video_id, frames, fps) by a strategy; 'scene_change' looks at sampled frames.

    Videos without frames or rate have none.
    """
    if strategy == "scene_change":
        if frames is None:
            raise ValueError("scene changes are found in sampled frames")
        return scene_changes(frames, probe, threshold, most)
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}")
    every = seconds if strategy == "fixed_interval" else 1.0
    return probe.where("frames > 0 AND fps <> 0").select("video_id", F.explode(interval_frames(F.col("frames"), F.col("fps"), every, most)).alias("position"))


class KeyFrames:
    """Table function for SQL: positions of a video's frames by strategy, 'fixed_interval' or 'iframe'; it sees no frames, so no scene changes."""

    def eval(self, count: int, fps: float, strategy: str):
        seconds = {"fixed_interval": 5.0, "iframe": 1.0}[strategy]
        for i, position in enumerate(range(0, count, max(1, int(fps * seconds)))):
            if i >= 20:
                break
            yield strategy, position


def key_frames_function(spark) -> UserDefinedTableFunction:
    return F.udtf(KeyFrames, returnType="strategy string, position bigint")


_PROBE = "probe AS (SELECT p_partkey AS video_id, p_size * 97 - 90 AS frames, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE p_partkey % 50 + 0.5 END::DOUBLE AS fps FROM part)"


def _probe(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return fixtures.table(spark, d, "part").select(k.alias("video_id"), (F.col("p_size") * 97 - 90).cast("long").alias("frames"), F.when(k % 9 == 0, 0.0).otherwise((k % 50 + 0.5).cast("double")).alias("fps"))


@query("video_duration", f"WITH {_PROBE} SELECT video_id, CASE WHEN fps > 0 THEN round(frames / fps, 6) ELSE 0 END AS seconds FROM probe")
def video_duration(spark, d):
    return _probe(spark, d).select("video_id", F.round(duration(F.col("frames"), F.col("fps")), 6).alias("seconds"))


@query("frame_positions", f"""WITH {_PROBE}, s AS (SELECT video_id, 'fixed_interval' AS strategy, frames, greatest(1, floor(fps * 5)::BIGINT) AS step FROM probe
        UNION ALL SELECT video_id, 'iframe', frames, greatest(1, floor(fps)::BIGINT) FROM probe)
    SELECT video_id, strategy, unnest(range(0, frames::BIGINT, step)[1:20]) AS position FROM s""")
def frame_positions(spark, d):
    probe = _probe(spark, d)
    fixed = probe.select("video_id", F.lit("fixed_interval").alias("strategy"), F.explode(interval_frames(F.col("frames"), F.col("fps"))).alias("position"))
    each = probe.select("video_id", F.lit("iframe").alias("strategy"), F.explode(interval_frames(F.col("frames"), F.col("fps"), 1.0)).alias("position"))
    return fixed.union(each)


@query("frame_stride", f"WITH {_PROBE} SELECT video_id, greatest(1, frames // 500)::BIGINT AS stride FROM probe")
def frame_stride(spark, d):
    return _probe(spark, d).select("video_id", stride(F.col("frames")).alias("stride"))


@query("key_frames_udtf", f"""WITH {_PROBE}, s AS (SELECT video_id, frames, 'fixed_interval' AS strategy, greatest(1, floor(fps * 5)::BIGINT) AS step FROM probe UNION ALL SELECT video_id, frames, 'iframe', greatest(1, floor(fps)::BIGINT) FROM probe)
    SELECT video_id, strategy, unnest(range(0, frames::BIGINT, step)[1:20]) AS position FROM s""")
def key_frames_udtf(spark, d):
    """The table function over all videos and both of its strategies."""
    ship(spark)
    both = _probe(spark, d).withColumn("strategy", F.explode(F.array(F.lit("fixed_interval"), F.lit("iframe"))))
    name = "key_frames_of"
    spark.udtf.register(name, key_frames_function(spark))
    view = f"probe_{uuid.uuid4().hex}"
    both.createOrReplaceTempView(view)
    return spark.sql(f"SELECT p.video_id, k.strategy, k.position FROM {view} p, LATERAL {name}(p.frames, p.fps, p.strategy) k")


#: A video of 25 frames, each with a histogram of 64 bins; a seventh of them have no rate.
_FRAMES = """frames AS (SELECT vec_id // 25 AS video_id, vec_id % 25 AS position, list_transform(embedding, lambda x: round(abs(x::DOUBLE) * 1000)) AS h FROM embeddings),
videos AS (SELECT video_id, count(*) AS frames, (video_id % 7) / 2.0::DOUBLE AS fps FROM frames GROUP BY video_id)"""
#: With the fixture's histograms about half of the frames that are compared differ by more.
_SCENE = 22_000.0


def _frames(spark, d) -> tuple[DataFrame, DataFrame]:
    v = F.floor(F.col("vec_id") / 25).cast("long")
    histogram = F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * 1000))
    frames = fixtures.table(spark, d, "embeddings").select(v.alias("video_id"), (F.col("vec_id") % 25).alias("position"), histogram.alias("histogram"))
    return frames, frames.groupBy("video_id").agg(F.count("*").alias("frames")).withColumn("fps", F.col("video_id") % 7 / 2.0)


@query("scene_changes", f"""WITH RECURSIVE {_FRAMES},
walk(video_id, position, h, n, taken) AS (
    SELECT video_id, position, h, 1, true FROM frames WHERE position = 0
    UNION ALL
    SELECT video_id, position, CASE WHEN new THEN next ELSE h END, n + new::INT, new FROM (
        SELECT w.video_id, f.position, w.h, f.h AS next, w.n,
            w.n < 20 AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN w.h[i] <> 0 THEN pow(w.h[i] - f.h[i], 2) / w.h[i] ELSE 0 END)) > {_SCENE} AS new
        FROM walk w JOIN frames f ON f.video_id = w.video_id AND f.position = w.position + 1)
),
kept AS (SELECT video_id, position FROM walk WHERE taken QUALIFY count(*) OVER (PARTITION BY video_id) >= 3)
SELECT video_id, position FROM kept JOIN videos USING (video_id) WHERE fps <> 0
UNION ALL SELECT video_id, unnest(range(0, frames, greatest(1, floor(fps * 5)::BIGINT))[1:20]) FROM videos WHERE fps <> 0 AND video_id NOT IN (SELECT video_id FROM kept)""")
def scene_changes_query(spark, d):
    frames, probe = _frames(spark, d)
    return scene_changes(frames, probe, threshold=_SCENE)


@query("key_frames", f"WITH {_PROBE}, s AS (SELECT video_id, frames, 'fixed_interval' AS strategy, greatest(1, floor(fps * 2)::BIGINT) AS step FROM probe WHERE fps <> 0 AND frames > 0 UNION ALL SELECT video_id, frames, 'iframe', greatest(1, floor(fps)::BIGINT) FROM probe WHERE fps <> 0 AND frames > 0) SELECT video_id, strategy, unnest(range(0, frames::BIGINT, step)[1:10]) AS position FROM s")
def key_frames_query(spark, d):
    """Both strategies that need no frames, of which readable videos have at most ten."""
    found = [key_frames(_probe(spark, d), s, seconds=2.0).withColumn("strategy", F.lit(s)) for s in ("fixed_interval", "iframe")]
    return found[0].union(found[1])


@query("thumbnail_position", f"WITH {_PROBE} SELECT video_id, floor(frames * 0.1::DOUBLE)::BIGINT AS position FROM probe")
def thumbnail_position(spark, d):
    return _probe(spark, d).select("video_id", thumbnail_frame(F.col("frames")).alias("position"))


@query("video_probe", f"""WITH {_PROBE}, c AS (SELECT *, [828601953, 1145656920, 875967048]::BIGINT[] AS codes FROM probe), f AS (SELECT *, codes[video_id % 3 + 1] AS code FROM c)
    SELECT video_id, chr((code & 255)::INT) || chr(((code >> 8) & 255)::INT) || chr(((code >> 16) & 255)::INT) || chr(((code >> 24) & 255)::INT) AS codec, CASE WHEN fps > 0 THEN round(frames / fps, 6) ELSE 0 END AS duration FROM f""")
def video_probe(spark, d):
    """Codec and duration, of a container's numbers."""
    code = F.element_at(F.array(*(F.lit(c).cast("long") for c in (828601953, 1145656920, 875967048))), (F.col("video_id") % 3 + 1).cast("int"))
    return _probe(spark, d).select("video_id", codec(code).alias("codec"), F.round(duration(F.col("frames"), F.col("fps")), 6).alias("duration"))


@query("video_hash", with_views("video") + "SELECT ord, len(frames) AS n_frames, frames[len(frames) // 2 + 1] AS middle, thumb FROM video")
def video_hash(spark, d):
    n = F.size("frames")
    return fixtures.video(spark, d).select("ord", n.cast("long").alias("n_frames"), F.element_at("frames", (F.floor(n / 2) + 1).cast("int")).alias("middle"), "thumb")


@query("video_distance", with_views("video") + """, p AS (SELECT a.ord AS i, b.ord AS j, a.frames AS fa, b.frames AS fb, a.thumb AS ta, b.thumb AS tb, a.duration AS da, b.duration AS db FROM video a JOIN video b ON b.ord = a.ord + 1 OR b.ord = a.ord - 1),
    m AS (SELECT *, list_avg(list_transform(fa, lambda x: list_min(list_transform(fb, lambda y: bit_count(xor(x, y)))))) AS f FROM p)
    SELECT i, j, round(least(64, f * 0.6 + coalesce(bit_count(xor(ta, tb))::DOUBLE, f) * 0.3 + CASE WHEN da > 0 AND db > 0 THEN (1 - least(da, db) / greatest(da, db)) * 10 ELSE 0 END * 0.1), 6) AS distance FROM m""")
def video_distance_query(spark, d):
    v = fixtures.video(spark, d)
    sides = [{c: F.col(f"{s}.{c}") for c in ("frames", "thumb", "duration")} for s in "ab"]
    next_to = v.withColumn("near", F.explode(F.array(F.col("ord") - 1, F.col("ord") + 1)))
    return next_to.alias("a").join(v.alias("b"), F.col("a.near") == F.col("b.ord")).select(F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), F.round(video_distance(*sides), 6).alias("distance"))


#: An 8 x 8 grid of pixels a frame, of which 4 x 4 waves are kept.
_PHASH = """g AS (SELECT vec_id, embedding AS p FROM embeddings),
low AS (SELECT vec_id, u, v, list_sum(list_transform(range(0, 64), lambda i: p[i + 1]::DOUBLE * cos(pi() * u * (2 * (i // 8) + 1) / 16) * cos(pi() * v * (2 * (i % 8) + 1) / 16))) AS c FROM g, range(4) a(u), range(4) b(v)),
h AS (SELECT vec_id, sum(CASE WHEN c > m THEN 1::BIGINT << (15 - u * 4 - v)::INT ELSE 0 END)::BIGINT AS hash FROM (SELECT *, median(c) OVER (PARTITION BY vec_id) AS m FROM low) GROUP BY vec_id),
v AS (SELECT vec_id // 9 AS video_id, list(hash ORDER BY vec_id % 9) AS frames FROM h GROUP BY 1)"""


@query("video_frame_hashes", f"WITH {_PHASH} SELECT video_id, array_to_string(frames, ',') AS frames, frames[len(frames) // 2 + 1] AS thumb FROM v")
def video_frame_hashes(spark, d):
    """Perceptual hashes of the frames of videos, and of the middle one."""
    frames = fixtures.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 9).cast("long").alias("video_id"), (F.col("vec_id") % 9).alias("position"), F.col("embedding").alias("pixels"))
    found = video_hashes(frames, 8, 4)
    return found.select("video_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"), "thumb")
