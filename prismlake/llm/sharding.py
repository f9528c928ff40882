"""Sharding by balanced label propagation.

Documents of equal text are linked. Every document begins in a shard by hash; then, round by round, documents move towards
the shard that holds most of those they are linked with, as far as that shard's quota has room, so that fewer links are
cut. Documents of one group are alike, so the state is a count for each group and shard, and a move changes counts: no
link is ever written out, and a group of any size is no more than one row a shard. Documents without links, and those that
no shard has room for, fill what is left of the quotas, which makes the counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.common import Kept, copies, documents, kept, running, size_bins, spread_join

SHARDS, ROUNDS = 8, 8
#: While documents move, a shard may hold more than its quota by this part of it; in the end its smallest groups go.
SLACK = 50


def _mix(*parts: Column | str | int) -> Column:
    """A hash of the parts that is never negative."""
    return F.xxhash64(*(F.lit(p) if isinstance(p, int) else p for p in parts)).bitwiseAND(F.lit((1 << 63) - 1))


def _first(moves: DataFrame, lane: str, limit: dict[int, int], bins: int) -> DataFrame:
    """Of moves (lane, group, n, gain) so much of n as the lane's limit lets in, larger gains first."""
    level = F.lit(64) - F.length(F.bin(F.greatest("gain", F.lit(0))))
    ranked = running(moves.withColumn("_bin", level * bins + F.pmod(_mix("group"), F.lit(bins))), [lane], "_bin", [F.col("gain").desc(), F.col("group")], F.col("n"), "_before")
    allowed = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in limit.items() for x in pair)), F.col(lane)), F.lit(0))
    return ranked.withColumn("n", F.greatest(F.lit(0), F.least(F.col("n"), allowed - F.col("_before")))).where("n > 0").drop("_bin", "_before")


def _limits(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many may move from each shard to each: as many as come the other way, and then as far as there is room."""
    swapped = np.minimum(wanted, wanted.T)
    more = wanted - swapped
    open_ = np.maximum(0, room)
    return swapped + np.minimum(more, more * open_ // np.maximum(1, more.sum(axis=0)))


def propagate(groups: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(group, shard, n): where the members of groups (group, n) of linked documents go; what no shard has room for is left out."""
    spread = groups.select("group", "n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    # each group is dealt out evenly, from a shard by hash on
    turn = F.pmod(F.col("shard") - F.pmod(_mix("group", 1), F.lit(shards)), F.lit(shards))
    dealt = spread.select("group", "shard", (F.floor(F.col("n") / shards) + (turn < F.col("n") % shards).cast("long")).alias("n")).where("n > 0")
    cells = Kept(dealt, "cells")
    bins = size_bins(cells.df.count())
    quota = np.array([rows // shards + (s < rows % shards) for s in range(shards)])
    own = Window.partitionBy("group")
    for i in range(rounds):
        tie = _mix("group", "shard", 10 + i)  # anew each round, so that groups split evenly over two shards go either way
        load = np.zeros(shards, np.int64)
        for r in cells.df.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row for each shard
            load[r["shard"]] = r["n"]
        room = quota - load
        # towards the shard with most members; every other round only among those that are far from full
        goals = i % 2 and [s for s in range(shards) if room[s] > quota[s] / 20] or [*range(shards)]
        best = F.max(F.when(F.col("shard").isin(goals), F.struct("n", tie.alias("tie"), "shard"))).over(own)
        wish = cells.df.withColumn("best", best).where(F.col("best.shard").isNotNull() & (F.struct("n", tie) < F.struct("best.n", "best.tie")))
        wish = wish.select("group", "n", F.col("best.shard").alias("shard"), F.col("shard").alias("origin"), (F.col("best.n") - F.col("n")).alias("gain"), (F.col("shard") * shards + F.col("best.shard")).alias("lane"))
        wanted = np.zeros((shards, shards), np.int64)
        for r in wish.groupBy("origin", "shard").agg(F.sum("n").alias("n")).collect():  # a row for each two shards at most
            wanted[r["origin"], r["shard"]] = r["n"]
        allowed = _limits(wanted, room + quota // SLACK + 1)
        if not allowed.any():
            continue
        into = Kept(_first(wish, "lane", {int(a * shards + b): int(allowed[a, b]) for a, b in np.argwhere(allowed)}, bins).select("group", "shard", "origin", "n"), "moves")
        change = into.df.select("group", "shard", "n").union(into.df.select("group", F.col("origin").alias("shard"), (-F.col("n")).alias("n")))
        after = Kept(cells.df.union(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
        cells.drop()
        into.drop()
        cells = after
    fits = _first(cells.df.withColumn("gain", F.col("n")), "shard", {s: int(quota[s]) for s in range(shards)}, bins)
    return kept(fits.select("group", "shard", "n"), "assigned")


def _share(first: Column, n: Column, runs: Column, rest: bool) -> Column:
    """Of the numbers first to first + n - 1 how many lie in each of runs (first, end, shard), and the rest, of shard null; shares of 0 are left out."""
    inside = F.transform(runs, lambda r: F.struct(r["shard"].cast("int").alias("shard"), (F.least(r["end"], first + n) - F.greatest(r["first"], first)).alias("n")))
    inside = F.coalesce(F.filter(inside, lambda x: x["n"] > 0), F.array().cast("array<struct<shard:int,n:bigint>>"))
    if not rest:
        return inside
    left = n - F.aggregate(inside, F.lit(0).cast("long"), lambda held, x: held + x["n"])
    return F.filter(F.concat(inside, F.array(F.struct(F.lit(None).cast("int").alias("shard"), left.alias("n")))), lambda x: x["n"] > 0)


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each of docs; shards' counts differ by one at most.

    Null texts count as empty, and all of these are linked. Repeated rows are linked like other equal texts; rows of equal
    doc_id and text are not told apart, and are one row with a count until the last step, however many there are. Reruns agree,
    whatever the partitions. Texts of any length are hashed where they are read and never shuffled. An empty table gives an
    empty one. Other columns are not read, whatever their names.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    each = docs.select("doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("group"))
    base = kept(each.groupBy("doc_id", "size", "text_crc32", "group").agg(F.count("*").alias("n")), "sharding")
    classes, rows = base.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = size_bins(classes)
    binned = base.withColumn("_bin", F.pmod(_mix("doc_id", "group", 3), F.lit(bins)))
    groups = kept(base.groupBy("group").agg(F.sum("n").alias("n")).where("n > 1"), "linked")
    cells = propagate(groups, rows, shards, rounds)

    # members of a group are numbered, and each shard takes a run of the numbers
    numbered = kept(running(binned, ["group"], "_bin", [F.col("doc_id")], F.col("n"), "number"), "numbered")
    order = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = cells.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    runs = runs.groupBy("group").agg(F.collect_list(F.struct("first", (F.col("first") + F.col("n")).alias("end"), "shard")).alias("runs"))  # one for each shard at most
    columns = ["doc_id", "size", "text_crc32", "group", "_bin"]
    joined = spread_join(numbered, runs, "group", ["doc_id"], classes, "left")
    placed = kept(joined.select(*columns, F.inline(_share(F.col("number"), F.col("n"), F.col("runs"), True))), "placed")

    gap = {s: rows // shards + (s < rows % shards) for s in range(shards)}
    for r in placed.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row for each shard
        gap[r["shard"]] -= r["n"]
    open_ = [F.struct(F.lit(sum(gap[x] for x in range(s))).cast("long").alias("first"), F.lit(sum(gap[x] for x in range(s + 1))).cast("long").alias("end"), F.lit(s).alias("shard")) for s in range(shards)]
    free = running(placed.where("shard IS NULL").withColumn("all", F.lit(0)), ["all"], "_bin", [F.col("doc_id"), F.col("group")], F.col("n"), "number")
    filled = free.select(*columns, F.inline(_share(F.col("number"), F.col("n"), F.array(*open_), False)))
    done = kept(placed.where("shard IS NOT NULL").select(*columns, "shard", "n").union(filled.select(*columns, "shard", "n")), "filled")
    # bins anew, as a shard's free places were filled from a few of the bins
    again = done.withColumn("_bin", F.pmod(_mix("doc_id", "group", 4), F.lit(bins)))
    slotted = kept(running(again, ["shard"], "_bin", [F.col("doc_id"), F.col("group")], F.col("n"), "slot"), "slotted")
    return copies(slotted, "n", "copy", rows).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("copy")).cast("long").alias("slot"))


def op3_balanced_shards(spark, sf_dir: str) -> DataFrame:
    found = shard(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
