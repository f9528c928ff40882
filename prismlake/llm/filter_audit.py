"""How filters of documents interact: what each removes in every order of the others, by sorted duplicates and masks of failures.

Each document gets a mask with a bit for each filter that it fails. Four filters look at the text alone. The fifth, duplicates,
comes from an order: documents are sorted by ranges of the text's fingerprint, the text and doc_id, and compared with
their predecessors; the group of equal texts that a range begins with may have begun in a range before, so the least ids of groups
at the ends of ranges are merged, and the rows there are judged once more. Masks are counted for each part, and all that is asked
about any order of the filters is a sum of these 32 counters, which add up over tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import WORD, documents, kept, small, spread_join, with_computed
from prismlake.shipping import ship

#: The filters; the place of a letter is its bit in a mask.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
#: Fingerprints that several texts have, that are sent to all executors at most; with more, all texts are sorted, not only those.
SHARED = 2_000_000
#: Bytes and rows of a range that one task sorts.
RANGE, ROWS = 64 << 20, 200_000


def text_mask(text: str | None) -> int:
    """The bits of the filters that look at one text: A few words, B few distinct words, C capitals, D symbols."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    upper = len(raw.translate(None, _NOT_UPPER))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * upper > UPPER_PERCENT * len(text), any(s in raw for s in SYMBOLS))
    return sum(1 << i for i, f in enumerate(failed) if f)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, each with the duplicates' bit as far as the range shows, and `edge` where other ranges may know more.

    edge is the text's digest in the group of equal texts that the range begins with, and in the first row of the one it ends with.
    """
    bit = 1 << FILTERS.index("E")
    group, leading, edge = None, True, None
    first: tuple | None = None  # the group's first row with an id, held back until it's known whether the group is the last
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "part", "mask", "fp", "text"))
        for doc_id, part, mask, fp, text in zip(*columns, strict=True):
            if (fp, text) != group:
                if first:
                    out.append((*first, edge))
                leading, group, first = group is None, (fp, text), None
                edge = _digest(fp, text) if leading else None
            if doc_id is None:
                out.append((doc_id, part, mask, None))
            elif first is None:
                first = (doc_id, part, mask)
            else:
                out.append((doc_id, part, mask | bit if doc_id > first[0] else mask, edge))
        if out:
            yield _judged(out)
    if first:
        yield _judged([(*first, _digest(*group))])


def _digest(fp: int, text: str | None) -> str:
    return hashlib.sha256(f"{fp}:".encode() + (b"" if text is None else b"=" + text.encode())).hexdigest()


def _judged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "edge": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=[*kinds])


def masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask) for each row of docs (doc_id, text and the column `part`), kept.

    All rows are sorted, but only texts whose 64-bit fingerprint another row has too are sorted with them; others can't be equal
    to any. Equal texts are found by their characters. Rows of the least id of a text don't fail, however often repeated; rows
    without an id are never duplicates, and make none. Null texts are empty, null parts too.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fp"))
    several = kept(rows.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select(F.col("fp").alias("shared")), "shared-texts")
    few = small(several, SHARED)
    compute = lambda batch: [pa.array([text_mask(t) for t in batch["text"].to_pylist()], pa.int32())]
    own = with_computed(rows, compute, "mask int")
    if few is not several:
        own = own.join(few, F.col("fp") == F.col("shared"), "left").withColumn("text", F.when(F.col("shared").isNotNull(), F.col("text"))).drop("shared")
    own = kept(own, "text-masks")
    n, held = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    order = ["fp", "text", "doc_id"]  # doc_id: rows without one first
    ranges = own.repartitionByRange(max(1, -(-held // RANGE), -(-n // ROWS)), *order).sortWithinPartitions(*order)
    ship(docs.sparkSession)
    judged = kept(ranges.mapInArrow(_judge, "doc_id bigint, part string, mask int, edge string"), "judged")
    edges = kept(judged.where("edge IS NOT NULL AND doc_id IS NOT NULL").groupBy("edge").agg(F.min("doc_id").alias("least")), "edges")
    bit = 1 << FILTERS.index("E")
    again = F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask"))
    met = spread_join(judged.where("edge IS NOT NULL"), edges, "edge", [], n, "left").select("doc_id", "part", again.alias("mask"))
    return kept(judged.where("edge IS NULL").select("doc_id", "part", "mask").union(met), "masks")


def counters(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each part arrays of 32 longs, at a mask's place its documents, those of quality 1 and the toxic ones.

    Counters of tables that share no documents add up. labels: (doc_id, quality, toxic); of several for a doc_id any counts.
    """
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic")).where("quality OR toxic")
    rows = found.select(F.col("doc_id").alias("id"), "part", "mask")
    judged = spread_join(rows, known.withColumnRenamed("doc_id", "id"), "id", [], rows.count(), "left")
    one = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    counts = judged.groupBy("part", "mask").agg(F.count("*").alias("n"), one("quality"), one("toxic"))
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long")
    row = lambda c: F.array(*(at(c, m) for m in range(MASKS)))
    return counts.groupBy("part").agg(row("n").alias("n"), row("quality").alias("good"), row("toxic").alias("toxic"))


def _steps() -> Column:
    """A struct for each order and step: the order, the step, the filter's bit and the bits of those before."""
    found = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(letter) for letter in order]
        found += [{"filter_order": order, "step": i + 1, "own": bit, "passed": sum(bits[:i])} for i, bit in enumerate(bits)]
    return F.from_json(F.lit(json.dumps(found)), "array<struct<filter_order:string,step:int,own:int,passed:int>>")


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, order of the filters and step (its filter is that letter), all counts long.

    kept after this step and removed here; redundant: fail its filter, but were removed before; unique_fails: fail no other;
    good_lost and toxic_lost: removed here, of quality 1 and toxic; shapley: removed by its filter, summed over all orders.
    Texts are taken whole; nulls, ties and repeated rows are as in masks(); an empty table gives an empty one. Other columns are not
    read, whatever their names. Labels without a document and documents without a label count for no loss.
    """
    counted = counters(masks(docs, part), labels)
    rows = counted.select("part", "n", "good", "toxic", F.explode(_steps()).alias("s")).select("part", "n", "good", "toxic", "s.*")
    own, passed = F.col("own"), F.col("passed")
    place = F.sequence(F.lit(0), F.lit(MASKS - 1))
    total = lambda c, which, weigh=lambda m, x: x: F.aggregate(
        F.transform(place, lambda m: F.when(which(m), weigh(m, F.get(F.col(c), m))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(passed) == 0)
    orders = factorial(len(FILTERS))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(passed)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(passed) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # of the filters that a document fails each is the first in as many orders
        total("n", fails, lambda m, x: x * (F.lit(orders) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interactions(documents(spark, sf_dir).select("doc_id", "source", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, part, text, regexp_extract_all(text, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (
    SELECT rid, doc_id, part, [len(ws) < {MIN_WORDS}, 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws),
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {UPPER_PERCENT} * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
    FROM w
),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (
    SELECT part, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN fails[i] THEN 1 << (i - 1) ELSE 0 END))::INT AS mask, count(*) AS n,
        count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
),
x AS (SELECT unnest(string_split('{FILTERS}', '')) AS t),
o AS (
    SELECT a.t || b.t || c.t || d.t || e.t AS filter_order FROM x a JOIN x b ON b.t <> a.t JOIN x c ON c.t NOT IN (a.t, b.t) JOIN x d ON d.t NOT IN (a.t, b.t, c.t) JOIN x e ON e.t NOT IN (a.t, b.t, c.t, d.t)
),
s AS (
    SELECT filter_order, step::INT AS step, 1 << (instr('{FILTERS}', filter_order[step]) - 1)::INT AS own,
        coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('{FILTERS}', filter_order[i]) - 1)::INT)), 0)::INT AS passed
    FROM o, range(1, 6) r(step)
),
r AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, coalesce(sum(n) FILTER (mask & (own | passed) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & passed = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & own <> 0 AND mask & passed <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & own <> 0 AND mask & passed = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & passed = 0), 0)::BIGINT AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
