"""Columns of clashing names, empty tables, nulls and repeated rows, for every operator and every stage of the pipeline."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from prismlake.llm import classifier, line_dedup, media, mixing, packing, quality_rules, secrets, sharding, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for working columns, or might.
NAMES = [
    "_id", "_text", "_stays", "_key", "_row", "_other", "_s", "_size", "_p", "_number", "_t_s", "_m_g", "_m_p", "_r_n", "_host", "_frequent", "_lines", "_hashes", "_hits", "_stay", "_stayn", "_uid", "_spans",
    "_at", "_salt", "_salts", "_hot", "_bin", "_label", "s", "g", "p", "n", "bin", "key", "size2", "group", "host", "line", "fp", "text_key", "component_id", "place", "rank", "x", "spans_", "shard_", "uid", "core", "whole", "pieces", "a", "b",
]


def rows():
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(80))
    found = [(i, f"Home | About\n{body(i)}\ntoken=abcdefgh{i}", "en", "ab"[i % 2], 0) for i in range(24)]
    return [*found, found[0], (30, body(3), "en", None, 0), (31, None, None, None, None), (None, "", "en", "a", 0), (None, body(5), None, "b", None), (None, body(5), None, "b", None)]


def with_names(docs):
    """docs with a column of each name, all different, whose value in a row is its name."""
    return docs.selectExpr("*", *(f"'{n}' AS `{n}`" for n in NAMES))


def model():
    return classifier.fit(np.zeros((0, len(classifier.FEATURES))), np.zeros(0))


OPERATORS = {
    "op1": lambda docs, tmp: classifier.score(docs, model()),
    "op2": lambda docs, tmp: mixing.mix(docs),
    "op3": lambda docs, tmp: sharding.shard(docs),
    "op4": lambda docs, tmp: quality_rules.apply_rules(docs, least=3),
    "op5": lambda docs, tmp: suffix_dedup.remove_repeats(docs),
    "op6 groups": lambda docs, tmp: simhash.groups(docs),
    "op6 one of each": lambda docs, tmp: simhash.one_of_each(docs),
    "op7": lambda docs, tmp: line_dedup.drop_boilerplate(docs),
    "op8": lambda docs, tmp: secrets.find(docs),
    "op9": lambda docs, tmp: packing.pack(docs),
    "op10": lambda docs, tmp: media.store(docs, str(tmp / "archives")),
}
#: Whose rows, but for repeated ones, don't depend on other columns; a mix draws numbers from whole rows.
SAME = [n for n in OPERATORS if n not in ("op2", "op10")]
PASSES = ("op1", "op2", "op4", "op5", "op6 one of each", "op7")


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing_and_pass_through(spark, tmp_path, name):
    docs = spark.createDataFrame(rows(), SCHEMA)
    plain = OPERATORS[name](docs, tmp_path)
    columns = plain.columns
    want = Counter(str([r[c] for c in columns]) for r in plain.collect())
    more = OPERATORS[name](with_names(docs), tmp_path / "more")
    found = more.collect()
    assert sum(want.values()) == len(found)
    if name in PASSES:
        assert all(r[n] == n for r in found for n in NAMES if n not in columns)
    if name in SAME:
        assert Counter(str([r[c] for c in columns]) for r in found) == want


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_one(spark, tmp_path, name):
    docs = spark.createDataFrame([], SCHEMA)
    plain = OPERATORS[name](docs, tmp_path)
    assert plain.count() == 0 and len(plain.columns) > 1


def test_queries_and_stages_take_empty_tables_and_other_columns(spark, tmp_path):
    from prismlake.llm import entry

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name, run in entry.queries().items():
        assert run(spark, str(tmp_path)).count() == 0, name
    docs = with_names(spark.createDataFrame(rows(), SCHEMA))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
