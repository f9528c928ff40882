"""Queries that do the whole of what a query of a fixed part does."""

from __future__ import annotations

from prismlake import fixtures, registry

from .oracle import compare, tables

FOLDER = "/root/testdata/sf0.01"


def test_every_asset_of_a_combination_is_grouped(spark):
    from prismlake.operators import grouping

    assert compare(spark, registry.queries()["groups_by_combo"], registry.oracle_sql()["groups_by_combo"], FOLDER) > 100
    found = {r.ord for r in grouping.groups_by_combo(spark, FOLDER).select("ord").distinct().collect()}
    assert max(found) > 10_000 and {x % 4 for x in found} == {0, 1, 2, 3} and len({x % 500 for x in found}) > 400


def test_people_have_all_their_photos(spark):
    total = tables(FOLDER).sql(f"SELECT count(*) FROM ({fixtures.SQL['people']}) JOIN (SELECT DISTINCT l_suppkey AS person_id, l_orderkey FROM lineitem) USING (person_id) WHERE name <> ''").fetchall()[0][0]
    for name in ("photos_by_person", "people_combos"):
        assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], FOLDER) > 0
    assert registry.queries()["photos_by_person"](spark, FOLDER).selectExpr("sum(n)").first()[0] == total
