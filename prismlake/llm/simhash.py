"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within the radius have a variant in common that is within half the radius of both. So every fingerprint emits
all its variants within half the radius, variants are shuffled, and those that meet at one are linked through it and verified.
No pairs within a large group are ever made: all that stand within 2 bits of one variant are within 4 of each other, so a
link to the least of them says as much; and no more than 2,081 distinct fingerprints can meet at a variant.

Fingerprints of which it is known that none of their variants can meet another's emit none. For that the same is done first
with either half of the bits: of two fingerprints within 4, one half is within 2, and so meets at one of 33 variants of 32 bits
within 1. Who meets none there, or one alone that is farther off, has no neighbour.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.common import Scratch, documents, fresh, kept, key_of, size_bins, small, spread_join, with_computed
from prismlake.llm.graph import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS, SEED, BITS = 4, 42, 64


def fingerprint(text: str | None) -> int:
    """Bit k is 1 if it is set in over half the hashes of the text's shingles, repeats included; 0 for a text without a word."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - WORDS + 1
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[WORDS - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


#: Fingerprints link at so many differing bits or fewer.
RADIUS = 4
#: Variants of halves at which many meet, and keys of documents that go, that are sent to all executors at most.
KEYS = 1_000_000


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp: a row for each of docs, written to shared storage without the text."""
    compute = lambda batch: [pa.array(np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64).view(np.int64))]
    return kept(with_computed(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text"), compute, "fp bigint", drop=["text"]), "fingerprints")


def _bit(i: Column, bits: int) -> Column:
    return F.when(i == bits, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))


def _half_keys(fp: Column) -> Column:
    """66 keys: a half, its number, and no bit or one of it changed."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    of = lambda half, number: F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: half.bitwiseXOR(_bit(i, 32)) + F.lit(number << 32))
    return F.concat(of(low, 0), of(high, 1))


def _ball(fp: Column) -> Column:
    """The fingerprint and all that differ from it in one bit or two."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.sequence(i + 1, F.lit(64)), lambda j: fp.bitwiseXOR(_bit(i, 64)).bitwiseXOR(_bit(j, 64))))
    return F.concat(F.array(fp), F.flatten(pairs))


def candidates(distinct: DataFrame, n: int, keep=kept) -> DataFrame:
    """Of n distinct fingerprints (fp) those that may have a neighbour: that meet one at a half's variant, and aren't ruled out by being two alone that are far apart."""
    keyed = distinct.repartition(size_bins(n, 5_000, 1), "fp").select("fp", F.explode(_half_keys(F.col("fp"))).alias("key"))  # a row becomes 66
    met = keep(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "half-keys")
    twos = met.where((F.col("n") == 2) & near(F.col("a"), F.col("b"))).select(F.explode(F.array("a", "b")).alias("fp"))
    more = keyed.join(small(met.where("n > 2").select("key"), KEYS), "key", "left_semi").select("fp")
    return keep(twos.union(more).distinct(), "candidates")


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def links(distinct: DataFrame, keep=kept) -> DataFrame:
    """(a, b) from distinct fingerprints (fp), made of tables that `keep` writes: edges that join what is linked by RADIUS bits or fewer.

    Each variant at which several meet links all of them to the least; so edges and links have the same components.
    """
    if RADIUS != 4:
        raise ValueError("halves and variants are laid out for a radius of 4")
    found = candidates(distinct, distinct.count(), keep)
    spread = found.repartition(size_bins(found.count(), 200, 1), "fp")  # a row becomes 2,081
    at = Window.partitionBy("variant")
    met = spread.select("fp", F.explode(_ball(F.col("fp"))).alias("variant")).select(F.min("fp").over(at).alias("a"), F.col("fp").alias("b"))
    return met.where("a < b").distinct().where(near(F.col("a"), F.col("b")))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp and component_id for each of docs.

    A component's id is its smallest doc_id; rows without one don't count for that, and have a null id if alone. Null and
    empty texts have fingerprint 0. Fingerprints are made of whole texts, however long; repeated rows and ties have equal
    ones. An empty table gives an empty one. Other columns are not read, whatever their names.
    """
    found = fingerprints(docs)
    rows = found.count()
    distinct = kept(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    with Scratch() as keep:
        labels = components(links(distinct.select("fp"), keep))
    named = kept(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    first = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = spread_join(named.select("fp", "label"), first, "label", ["fp"], rows).select("fp", "component_id")
    return spread_join(found, named, "fp", [], rows)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then the smallest text_key; rows without an id come last.

    Only keys of documents are shuffled, and the text of rows repeated as they are. An empty table gives an empty one. All
    columns of docs may have any names.
    """
    found = kept(groups(docs), "groups")
    row = F.concat_ws(":", F.hex("text_key"), key_of("doc_id")).alias("row")
    component = F.coalesce(F.concat(F.lit("="), F.col("component_id").cast("string")), F.concat(F.lit("~"), F.hex("fp"))).alias("component")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    rows = kept(found.groupBy(component, row, order.alias("place")).agg(F.count("*").alias("n")), "rows")
    per = rows.groupBy("component").agg(F.min("place").alias("best"))
    judged = spread_join(rows, per, "component", ["row"], rows.count())
    # null-safe, as a row without an id has a null in its place
    stays = (F.col("place.none") == F.col("best.none")) & F.col("place.doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("place.text_key") == F.col("best.text_key"))
    odd = small(kept(judged.where(~stays | (F.col("n") > 1)).select("row", stays.alias("stays")), "odd"), KEYS)
    own, other, verdict = fresh(docs, "_row", "_other", "_stays")
    keyed = docs.withColumn(own, F.concat_ws(":", F.hex(F.xxhash64(F.coalesce("text", F.lit("")))), key_of("doc_id")))
    marked = keyed.join(odd.toDF(other, verdict), F.col(own) == F.col(other), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    usual = marked.where(F.col(verdict).isNull()).select(*columns)
    repeated = marked.where(F.col(verdict)).dropDuplicates([own]).select(*columns)
    return usual.union(repeated)


def op6_simhash_groups(spark, sf_dir: str) -> DataFrame:
    found = groups(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
