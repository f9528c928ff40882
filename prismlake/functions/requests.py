"""Checks of what a request asks for, as Column expressions: where it comes from, and whether a path stays in its folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismlake import fixtures
from prismlake.registry import query

#: Names of this machine.
LOCAL = ["127.0.0.1", "localhost"]


def same_origin(host: Column, origin: Column, referer: Column) -> Column:
    """Whether a request that changes state may: its origin, or else its referer, is this machine and the host that was asked; without either it may."""
    named = F.coalesce(origin, referer)
    at = F.try_parse_url(named, F.lit("AUTHORITY"))
    own = F.try_parse_url(named, F.lit("HOST")).isin(LOCAL) & ((F.coalesce(host, F.lit("")) == "") | (at == host))
    return F.when(named.isNull(), True).otherwise(F.coalesce(own, F.lit(False)))


def stays_inside(path: Column) -> Column:
    """Whether a path below a folder, once its dots are taken away, is still below it; an absolute path isn't."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda s, part: _deeper(s, F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)),
        lambda s: s["least"],
    )
    return F.coalesce(~F.startswith(path, F.lit("/")) & (depth >= 0), F.lit(False))


def _deeper(state: Column, step: Column) -> Column:
    at = state["at"] + step
    return F.struct(at.alias("at"), F.least(state["least"], at).alias("least"))


@query("origin_checks", """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN false ELSE true END AS allowed FROM customer""")
def origin_checks(spark, d):
    k = F.col("c_custkey") % 8
    origin = F.when(k == 1, "http://127.0.0.1:8080").when(k == 2, "http://evil.example").when(k == 3, "http://localhost:9999").when(k == 5, "not a url").when(k == 6, "").when(k == 7, "http://localhost:8080")
    referer = F.when(k == 4, "http://localhost:8080/x?y=1").when(k == 7, "http://evil.example/")
    host = F.when(k.isin(3, 4, 7), "localhost:8080").otherwise("127.0.0.1:8080")
    return fixtures.table(spark, d, "customer").select("c_custkey", same_origin(host, origin, referer).alias("allowed"))


@query("path_checks", "SELECT p_partkey, p_partkey % 6 IN (0, 1, 4) AS inside FROM part")
def path_checks(spark, d):
    k = F.col("p_partkey") % 6
    path = F.when(k == 0, "report_1.json").when(k == 1, "a/../report_1.json").when(k == 2, "../x").when(k == 3, "a/../../a/x").when(k == 4, "./a/./b/..").otherwise("/etc/passwd")
    return fixtures.table(spark, d, "part").select("p_partkey", stays_inside(path).alias("inside"))
