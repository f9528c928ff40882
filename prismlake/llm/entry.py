"""The training-data queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: Query, its module, and the name of its SQL there.
_QUERIES = [
    ("op1_quality_classifier", "classifier", None),
    ("op2_pareto_mix", "mixing", "OP2_SQL"),
    ("op3_balanced_shards", "sharding", None),
    ("op4_quality_rules", "quality_rules", "OP4_SQL"),
    ("op5_suffix_dedup", "suffix_dedup", None),
    ("op6_simhash_groups", "simhash", None),
    ("op7_line_dedup", "line_dedup", "OP7_SQL"),
    ("op8_secret_scan", "secrets", "OP8_SQL"),
    ("op9_pack", "packing", None),
    ("op10_media_columns", "media", None),
    ("op11_vector_codes", "vector_codes", "OP11_SQL"),
    ("op12_warc_index", "warc", "OP12_SQL"),
    ("op13_filter_audit", "filter_audit", "OP13_SQL"),
]


def _module(name: str):
    return importlib.import_module(f"prismlake.llm.{name}")


def queries():
    return {name: getattr(_module(module), name) for name, module, _ in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {name: getattr(_module(module), sql) for name, module, sql in _QUERIES if sql}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
