"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing and packing.

Each stage is a function of the session, the documents that the stage before it kept, and the folder of the input tables.
run() writes what each returns and reads it again for the next, so a lost executor costs a part of one stage; what a stage
has written on the way, and what the stage before it has, is deleted once its own result is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import line_dedup, mixing, packing, quality_rules, simhash
from prismlake.llm.common import documents
from prismlake.storage import settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with all their lines; what their hosts have too often is left to the next stage."""
    return _documents(quality_rules.apply_rules(docs.select(COLUMNS)).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sites' boilerplate lines."""
    return _documents(line_dedup.drop_boilerplate(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    taken = mixing.mix(docs).where("taken_copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("taken_copies").cast("int")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences; no longer documents."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("mixing", mix), ("packing", pack)]

#: Fingerprints, components and tokens are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        table = settled(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023  called at once
        if before:
            before.drop()
        docs, before = table.df, table
    return docs
