"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import Kept, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of the edges (a, b: long) the smallest node that it is connected with.

    Labels are hooked to the smallest among the neighbours' and then shortened, so rounds grow with the logarithm of the
    longest path. Each round is a table in shared storage; the driver sees only how many labels changed. A label that most
    nodes have, and a node that most edges have, are joined in parts. Loops and repeated edges add nothing; no edges, no rows.
    """
    both = Kept(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = Kept(both.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")).withColumn("changed", F.lit(True)), "labels")
    n_edges, n = both.df.count(), labels.df.count()
    while labels.df.where("changed").limit(1).count():
        at = labels.df.select("node", "label")
        above = at.select(F.col("node").alias("label"), F.col("label").alias("top"))
        shorter = spread_join(at, above, "label", ["node"], n, "left").select("node", "label", F.coalesce("top", "label").alias("top"))
        tops = shorter.select(F.col("node").alias("b"), F.col("top").alias("offer"))
        near = spread_join(both.df, tops, "b", ["a"], n_edges).groupBy(F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        seen = shorter.join(near, "node").select("node", "label", "top", F.least("top", "offer").alias("best"))
        offers = seen.select("node", "best").union(seen.select(F.col("label").alias("node"), "best")).groupBy("node").agg(F.min("best").alias("best"))
        after = at.join(offers, "node", "left").select("node", F.least("label", F.coalesce("best", "label")).alias("new"), "label")
        new = Kept(after.select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("changed")), "labels")
        labels.drop()
        labels = new
    both.drop()
    return labels.df.select("node", "label")
