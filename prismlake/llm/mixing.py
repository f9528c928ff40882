"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words from its weight and cap. Within a source a document is wanted a number of times that
grows with the magnitude of its size; whole copies are certain, and for what is left over documents are ranked by the odds
of a random number divided by the odds of their inclusion, and the first are taken until the target's words are met.

Every row has a random number of its own: it is drawn from the row's id and text, and from a number among rows that are equal
in all columns. So the cut is within half a document of the target, whatever ids are null or repeated. Only a table of
sources and magnitudes is joined to the documents; of their rows only sizes and digests are shuffled, and the text of rows
that are repeated as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.common import WORD, copies, documents, fresh, in_order, kept, key_of, size_bins, small

#: Weights of the sources in order of their code points, repeating, and how often any word may be taken at most.
WEIGHTS, MOST = (1, 2, 3), 3
SEED = "mix"
#: Rows of the table of sources and magnitudes, and of repeated rows' digests, that are sent to all executors at most.
ROWS = 500_000

BEFORE = (Window.unboundedPreceding, -1)


def words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def magnitude(size: Column) -> Column:
    """Preference for a document: 16 and the number of its size's binary digits."""
    return (F.lit(16) + F.length(F.bin(size))).cast("long")


def row_key(docs: DataFrame) -> Column:
    """A digest of a row's id and text, and of its other columns where there are any but the source."""
    others = sorted(c for c in docs.columns if c not in ("doc_id", "text", "source"))
    parts = [F.lit(SEED), key_of("doc_id"), F.md5(key_of("text")), *([F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in others))))] if others else [])]
    return F.md5(F.concat_ws(":", *parts))


def odds_rank(key: Column, number: Column, inclusion: Column) -> Column:
    """q / (1 + q) of q, the odds of the random number of the key's copy divided by those of the inclusion."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, number.cast("string"))), 1, 13), 16, 10).cast("double")
    u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    q = (u / (F.lit(1.0) - u)) / (inclusion / (F.lit(1.0) - inclusion))
    return q / (F.lit(1.0) + q)


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(s, source_size, target) from (s, size), s a key of the source: the cap's excess goes to the others by weight until none is above.

    Sources may be as many as hosts: their order and their sums are made range by range.
    """
    by = kept(sized.groupBy("s").agg(F.sum("size").alias("source_size")), "mix-sources")
    n = by.count()
    turns = in_order(by, [F.col("s")], {"turn": F.lit(1)}, n)
    weighed = turns.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long")).drop("turn")
    total, rest = (x or 0 for x in weighed.agg(F.sum("source_size"), F.sum("weight")).first())
    # the less a source has for its weight, the sooner it is full
    ratio = F.col("source_size") / F.col("weight")
    at = in_order(weighed, [ratio, F.col("s")], {"held": F.col("source_size"), "used": F.col("weight")}, n)
    at = at.withColumn("level", (total - most * F.col("held")).cast("double") / (rest - F.col("used")).cast("double"))
    at = at.withColumn("full", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    # the first that isn't full has the level of all that aren't
    final = at.agg(F.min(F.when(~F.col("full"), F.struct(ratio.alias("ratio"), F.col("s"), F.col("level")))).alias("x")).first()["x"]
    open_ = F.lit(final["level"] if final else None).cast("double") * F.col("weight")
    return at.select("s", "source_size", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(open_).alias("target"))


def plan(docs: DataFrame, key: Column, weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(s, source_size, target); (s, g, whole, inclusion, bin_cut, p_cut) for each source and magnitude; (s, key, n) of repeated rows; bins; rows."""
    sized = kept(docs.select(key_of("source").alias("s"), words().alias("size"), key.alias("key")), "mix-sizes")
    goals = kept(targets(sized, weights, most), "mix-targets")
    by = sized.where("size > 0").groupBy("s", magnitude(F.col("size")).alias("g")).agg(F.sum("size").alias("n")).join(goals, "s")
    fill = Window.partitionBy("s").orderBy(F.col("g").desc())
    held = F.coalesce(F.sum("n").over(fill.rowsBetween(*BEFORE)), F.lit(0))
    left = F.sum(F.col("g") * F.col("n")).over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("target") - (most * held).cast("double")) / left.cast("double")
    at = by.withColumn("level", level).withColumn("full", F.col("level") * F.col("g") >= most)
    # all that are full come first, so the level of the rest is the one at the first that isn't
    final = F.max_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("g"))).over(Window.partitionBy("s"))
    wanted = F.when(F.col("full"), F.lit(float(most))).otherwise(final * F.col("g"))
    at = at.withColumn("copies", wanted).withColumn("whole", F.floor("copies").cast("long")).withColumn("inclusion", F.col("copies") - F.col("whole"))
    at = at.withColumn("open", F.col("target") - F.sum(F.col("whole") * F.col("n")).over(Window.partitionBy("s")).cast("double"))
    levels = kept(at.select("s", "g", "whole", "inclusion", "open"), "mix-levels")

    rows = sized.count()
    bins = size_bins(rows)
    classes = kept(sized.where("size > 0").groupBy("s", "size", "key").agg(F.count("*").alias("n")), "mix-classes")
    drawn = copies(classes, "n", "k", rows).drop("n")
    ranked = drawn.withColumn("g", magnitude(F.col("size"))).join(small(levels.where("inclusion > 0"), ROWS), ["s", "g"])
    ranked = ranked.withColumn("p", odds_rank(F.col("key"), F.col("k"), F.col("inclusion"))).withColumn("bin", F.floor(F.col("p") * bins))
    before = Window.partitionBy("s").orderBy("bin").rowsBetween(*BEFORE)
    sums = ranked.groupBy("s", "open", "bin").agg(F.sum("size").alias("n")).withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = kept(sums.where("held <= open").groupBy("s").agg(F.max_by(F.struct("bin", "held"), "bin").alias("c")).select("s", "c.bin", "c.held"), "mix-bins")
    near = ranked.join(small(cut, ROWS), ["s", "bin"]).groupBy("s", "open", "held", "p").agg(F.sum("size").alias("n"))
    own = F.col("held") + F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("p").rowsBetween(*BEFORE)), F.lit(0))
    last = near.withColumn("own", own).where(F.col("own") + F.col("n") / F.lit(2.0) <= F.col("open")).groupBy("s").agg(F.max("p").alias("p_cut"))
    cuts = cut.select("s", F.col("bin").alias("bin_cut")).join(last, "s", "left")
    repeated = kept(classes.where("n > 1").select("s", "key", "n"), "mix-repeated")
    return goals, kept(levels.drop("open").join(cuts, "s", "left"), "mix-plan"), repeated, bins, rows


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """All rows and columns of docs with size, source_size, target and taken_copies (0 to most) added.

    Null and empty texts have no words and are taken 0 times. A null source comes last among the sources. Rows of equal or
    null doc_id are drawn each on its own; of rows that are equal in all columns as many are taken as are due. Very long
    texts are rows like any other. Reruns agree, whatever the partitions. An empty table gives an empty one. The columns added
    replace others of the name; any other name may occur.
    """
    docs = docs.drop("size", "source_size", "target", "taken_copies")
    key = row_key(docs)
    goals, table, repeated, bins, rows = plan(docs, key, weights, most)
    s, size, own, number = fresh(docs, "_s", "_size", "_key", "_number")
    t = fresh(docs, "_t_s", "_t_source_size", "_t_target")
    m = fresh(docs, "_m_s", "_m_g", "_m_whole", "_m_inclusion", "_m_bin", "_m_p")
    r = fresh(docs, "_r_s", "_r_key", "_r_n")
    named = lambda df, names: small(df, ROWS).toDF(*names)
    out = docs.withColumns({s: key_of("source"), size: words(), own: key}).join(named(goals, t), F.col(s) == F.col(t[0]), "left")
    out = out.join(named(table, m), (F.col(s) == F.col(m[0])) & (magnitude(F.col(size)) == F.col(m[1])) & (F.col(size) > 0), "left")
    out = out.join(named(repeated, r), (F.col(s) == F.col(r[0])) & (F.col(own) == F.col(r[1])), "left")
    once = out.where(F.col(r[2]).isNull()).withColumn(number, F.lit(0).cast("long"))
    many = copies(out.where(F.col(r[2]).isNotNull()).dropDuplicates([s, own]), r[2], number, rows)
    out = once.union(many.select(*once.columns))
    p = odds_rank(F.col(own), F.col(number), F.col(m[3]))
    bin_of = F.floor(p * bins)
    extra = F.when(F.col(m[3]) > 0, F.coalesce((bin_of < F.col(m[4])) | ((bin_of == F.col(m[4])) & (p <= F.col(m[5]))), F.lit(False)).cast("long")).otherwise(F.lit(0))
    taken = F.coalesce(F.col(m[2]), F.lit(0)) + F.coalesce(extra, F.lit(0))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(size).alias("size"), F.col(t[1]).alias("source_size"), F.col(t[2]).alias("target"), taken.cast("long").alias("taken_copies"))


def op2_pareto_mix(spark, sf_dir: str) -> DataFrame:
    found = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("taken_copies") * F.col("size")).alias("taken"), "source")


OP2_SQL = f"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
        md5('{SEED}:' || coalesce('=' || doc_id::VARCHAR, '~') || ':' || md5(coalesce('=' || text, '~'))) || ':' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1) AS draw
    FROM documents
),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([1, 2, 3])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM src),
f AS (
    SELECT *, (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER b, 0))::BIGINT::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT::DOUBLE AS lvl
    FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
    SELECT source, source_size, CASE WHEN lvl * weight >= {MOST} * source_size THEN ({MOST} * source_size)::DOUBLE
        ELSE (SELECT lvl FROM f WHERE lvl * weight < {MOST} * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1) * weight END AS target FROM f
),
g AS (SELECT *, 16 + length(bin(size)) AS g FROM d),
l AS (SELECT source, g, sum(size)::BIGINT AS s FROM g WHERE size > 0 GROUP BY ALL),
lt AS (SELECT l.*, t.target FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source),
lf AS (
    SELECT *, (target - ({MOST} * coalesce(sum(s) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE)
        / (sum(g * s) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS lvl FROM lt
),
lc AS (
    SELECT *, CASE WHEN lvl * g >= {MOST} THEN {MOST}::DOUBLE ELSE max_by(lvl, g) FILTER (lvl * g < {MOST}) OVER (PARTITION BY source) * g END AS copies FROM lf
),
lo AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS inc, target - (sum(floor(copies)::BIGINT * s) OVER (PARTITION BY source))::BIGINT::DOUBLE AS open FROM lc),
u AS (
    SELECT g.source, g.draw, g.size, whole, inc, open, (('0x' || substr(md5(g.draw), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE AS u
    FROM g JOIN lo ON g.source IS NOT DISTINCT FROM lo.source AND g.g = lo.g AND g.size > 0
),
q AS (SELECT *, CASE WHEN inc > 0 THEN (u / (1.0::DOUBLE - u)) / (inc / (1.0::DOUBLE - inc)) END AS q FROM u),
p AS (SELECT *, q / (1.0::DOUBLE + q) AS p FROM q),
s AS (SELECT source, p, open, sum(size)::BIGINT AS s FROM p WHERE p IS NOT NULL GROUP BY ALL),
c AS (SELECT source, p, coalesce(sum(s) OVER (PARTITION BY source ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + s / 2.0::DOUBLE <= open AS yes FROM s)
SELECT d.doc_id, d.size, t.source_size, t.target, (coalesce(p.whole, 0) + coalesce(c.yes, false)::INT)::BIGINT * d.size AS taken, d.source
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.draw = p.draw
LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source AND p.p = c.p
"""
