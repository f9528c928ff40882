from __future__ import annotations

import corpus_pipeline
import pytest
from prismlake.llm import entry

from tests.oracle import compare, tables


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == [*range(1, 14)] and "pipeline" in entry.queries()
    assert len(corpus_pipeline.STAGES) == 5 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    counted = {"op11_vector_codes": "SELECT count(*) FROM embeddings", "op12_warc_index": "SELECT count(*) FROM pages", "op13_filter_audit": "SELECT 600 * count(DISTINCT coalesce(source, '')) FROM documents"}
    assert compare(spark, entry.queries()[name], entry.oracle_sql()[name]) == tables().sql(counted.get(name, "SELECT count(*) FROM documents")).fetchall()[0][0]
