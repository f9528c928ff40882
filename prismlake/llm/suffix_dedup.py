"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash picks triggers: of any run of WIDTH places the one with the least hash of its next bytes. Triggers depend on
nothing but the bytes around them, so equal strings have them alike wherever they stand. A string of LENGTH bytes belongs to
the trigger of its first WIDTH places: it is some of the bytes before that trigger and the rest from it on.

Triggers cut texts into phrases. The distinct phrases before triggers, in order of their reversed bytes, are the dictionary:
phrases that end alike are neighbours in it. The distinct suffixes of the parse from triggers on, cut where no string reaches,
are in order of their bytes. Both orders are made by Spark, range by range, and hold for each entry how many bytes it has
in common with the one before. From these each entry knows its class at any depth: the run of neighbours that agree in so
many bytes. Two strings are equal if and only if they begin equally far before their trigger, and their classes are equal, of the
phrase at that depth and of the parse at the rest of LENGTH. A class holds for runs of depths, so a trigger's strings are a few
runs; those of equal classes are combined, and where two overlap, their strings repeat.

What can't repeat is left out by hashes before: a trigger whose next CORE bytes stand nowhere else has no repeated string. And
triggers all of whose strings repeat together, phrase and parse being equal as a whole by 128 bits of hashes, are one entry with a
count; in one text, such as one of a few bytes over and over, they are so before they leave it. Rows equal in doc_id and text are
one text, all of which repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.common import Scratch, documents, fresh, kept, size_bins, small, spread_join, with_computed

#: Bytes of a string that is removed if it repeats, bytes that a trigger's hash is made of, and places of which one triggers.
LENGTH, TRIGGER, WIDTH = 200, 16, 150
#: Bytes after a trigger that all of its strings have.
CORE = LENGTH - WIDTH + 1
#: Entries of an order that one task holds, and ranges whose ends one task sees.
RANGE, BLOCK = 20_000, 500
#: Keys of texts that are sent to all executors at most.
KEYS = 1_000_000
#: Bytes of texts that are hashed at once, as a call on few bytes costs more than the bytes; a longer text is on its own.
TOGETHER = 1 << 15

#: Odd, so that they have inverses modulo 2**64; one for each of two hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@cache
def _byte_values(which: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 1 + which) for b in range(256)], np.uint64)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(n: int, which: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n of a base, or of its inverse, modulo 2**64."""
    if (which, inverse) not in _powers or len(_powers[which, inverse]) <= n:
        steps = np.full(max(n, 1 << 16) + 1, pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which], np.uint64)
        steps[0] = 1
        _powers[which, inverse] = np.cumprod(steps)
    return _powers[which, inverse]


class Hashes:
    """Hashes of any parts of a text, from sums over it."""

    def __init__(self, raw: bytes, which: int = 0):
        n = len(raw)
        terms = _byte_values(which)[np.frombuffer(raw, np.uint8)] * _power(n, which, True)[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.powers = _power(n, which, False)

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.powers[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def triggers(raw: bytes, hashes: Hashes, ends: np.ndarray | None = None) -> np.ndarray:
    """Rows (trigger, first, last): the strings that start at first to last belong to the trigger. First place wins a tie.

    ends: where texts of LENGTH bytes or more, of which raw is made, end in it; strings keep to one of them. Without it raw is one text.
    """
    starts = len(raw) - LENGTH + 1
    if starts < 1:
        return np.zeros((0, 3), np.int64)
    places = starts + WIDTH - 1
    h = hashes.of(slice(0, places), slice(TRIGGER, TRIGGER + places))
    least, width = h, 1
    while 2 * width <= WIDTH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: starts], least[WIDTH - width : WIDTH - width + starts])
    begins = np.concatenate([[True], least[1:] != least[:-1]])
    texts = np.array([len(raw)]) if ends is None else ends
    for e in texts[:-1].tolist():
        begins[e - LENGTH + 1 : e], begins[e] = False, True
    new = np.flatnonzero(begins)
    end = np.minimum(np.append(new[1:], starts) - 1, texts[np.searchsorted(texts, new, "right")] - LENGTH)
    fell = np.concatenate([[False], least[new[1:]] < least[new[1:] - 1]])
    fell[np.searchsorted(new, texts[:-1])] = False
    first = new + WIDTH - 1  # what makes the least value fall is the place that has just come in
    unknown = np.flatnonzero(~fell)
    for some in np.array_split(unknown, max(1, len(unknown) >> 12)):
        first[some] = new[some] + np.argmin(h[new[some][:, None] + np.arange(WIDTH)], axis=1)
    again = end > first  # the same value once more, after the first place has gone
    if not again.any():
        return np.stack([first, new, end], axis=1)
    rows = [np.stack([first, new, np.minimum(end, first)], axis=1)]
    for k in np.flatnonzero(again):
        more = first[k] + 1 + np.flatnonzero(h[first[k] + 1 : end[k] + WIDTH] == least[new[k]])
        low = np.concatenate([[first[k] + 1], more[:-1] + 1])
        keep = low <= end[k]
        rows.append(np.stack([more, low, np.minimum(more, end[k])], axis=1)[keep])
    return np.concatenate(rows)


def _packed(rows: np.ndarray) -> np.ndarray:
    return rows[:, 0] << 16 | (rows[:, 0] - rows[:, 1]) << 8 | (rows[:, 0] - rows[:, 2])


def _unpacked(place: np.ndarray) -> np.ndarray:
    t = place >> 16
    return np.stack([t, t - (place >> 8 & 255), t - (place & 255)], axis=1)


def _together(sizes: list[int]) -> Iterator[list[int]]:
    """Places of texts of LENGTH bytes or more, in order, as many at once as have TOGETHER bytes, or a single one."""
    some, held = [], 0
    for k, n in enumerate(sizes):
        if n < LENGTH:
            continue
        if some and held + n > TOGETHER:
            yield some
            some, held = [], 0
        some.append(k)
        held += n
    if some:
        yield some


def _parsed(batch: pa.RecordBatch) -> list[pa.Array]:
    """For each text its triggers' places, hashes of their cores and two of all their strings together, and how often it has the same;
    one of each kind alone. And the spans of those that it has several times, as maximal runs."""
    texts = batch["text"].cast(pa.binary()).to_pylist()
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    counts, inside = np.zeros(len(texts), np.int64), [[] for _ in texts]
    for rows_of in _together([len(x or b"") for x in texts]):
        raw = b"".join(texts[k] for k in rows_of)
        ends = np.cumsum([len(texts[k]) for k in rows_of])
        hashes = Hashes(raw)
        rows = triggers(raw, hashes, ends)
        of = np.searchsorted(ends, rows[:, 0], "right")
        order = np.argsort(of, kind="stable")
        rows, of = rows[order], of[order]
        t, low, high = rows.T
        width = (high - low).astype(np.uint64)
        whole = [(h.of(low, high + LENGTH) + width * np.uint64(base)).view(np.int64) for h, base in zip((hashes, Hashes(raw, 1)), _BASES, strict=True)]
        found = [_packed(rows - np.concatenate([[0], ends])[of][:, None]), hashes.of(t, t + CORE).view(np.int64), *whole, np.ones(len(rows), np.int64)]
        # only texts that have some hash twice can have all of a trigger's strings twice
        order = np.lexsort((whole[0], of))
        alike = (of[order[1:]] == of[order[:-1]]) & (whole[0][order[1:]] == whole[0][order[:-1]])
        shown = np.ones(len(rows), bool)
        for k in np.unique(of[order[1:]][alike]).tolist():
            own = slice(*np.searchsorted(of, [k, k + 1]))
            _, first, kind, times = np.unique(np.stack([*(x[own] for x in whole), (t - low)[own]], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            shown[own] = False
            shown[own][first] = True
            found[4][own][first] = times
            again, start = times[kind.ravel()] > 1, int(ends[k - 1]) if k else 0
            inside[rows_of[k]] = [{"s": s, "e": e} for s, e in _runs(low[own][again] - start, high[own][again] + LENGTH - start)]
        for x, values in zip(out, found, strict=True):
            x.append(values[shown])
        counts[rows_of] = np.bincount(of[shown], minlength=len(rows_of))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in out]
    return [*lists, pa.array(inside, SPANS)]


SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _runs(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(start)) - 1].tolist(), strict=True))


def _contexts(batch: pa.RecordBatch) -> list[pa.Array]:
    """For each open trigger of a text its phrase, from its first string on and reversed, and the LENGTH bytes of the parse from it on."""
    rows = []
    for text, places in zip(batch["text"].to_pylist(), batch["places"].to_pylist(), strict=True):
        raw = (text or "").encode()
        at = _unpacked(np.array(sorted(places), np.int64))
        rows.append([{"place": int(p), "phrase": raw[low:t][::-1], "parse": raw[t : t + LENGTH]} for p, (t, low, _) in zip(sorted(places), at.tolist(), strict=True)])
    return [pa.array(rows, pa.list_(pa.struct([("place", pa.int64()), ("phrase", pa.binary()), ("parse", pa.binary())])))]


def common(strings: list[bytes]) -> np.ndarray:
    """Bytes that each string has in common with the one before; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    if len(strings) < 2:
        return out
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    table = np.zeros((len(strings), int(lengths.max()) + 1), np.uint8)
    for i, x in enumerate(strings):
        table[i, : len(x)] = np.frombuffer(x, np.uint8)
    other = table[1:] != table[:-1]
    other[:, -1] = True
    out[1:] = np.minimum(np.argmax(other, axis=1), np.minimum(lengths[1:], lengths[:-1]))
    return out


def pushed(stack: list[tuple[int, int]], depth: int, start: int) -> None:
    """The stack of (depth, start) after an entry that has `depth` bytes in common with the one before: its class begins anew wherever more are asked for."""
    while stack and stack[-1][0] >= depth:
        stack.pop()
    stack.append((depth, start))


_STACK = pa.list_(pa.struct([("depth", pa.int64()), ("start", pa.int64())]))
_STACK_SQL = "array<struct<depth:bigint,start:bigint>>"


def _stack(entries: list[tuple[int, int]]) -> list[dict]:
    return [{"depth": d, "start": s} for d, s in entries]


def _ends(table: pa.Table) -> pa.Table:
    """Of a range of an order: its first and last string, and where classes begin in it."""
    strings, part = sorted(table["s"].to_pylist()), table["_range"][0].as_py()
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate(common(strings).tolist()):
        pushed(stack, depth if i else -1, part << 32 | i)
    return _end(part, strings[0], strings[-1], stack)


def _end(part: int, first: bytes, last: bytes, stack: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"_range": pa.array([part], pa.int32()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary()), "stack": pa.array([_stack(stack[1:])], _STACK)})


def _after(stack: list[tuple[int, int]], depth: int, row: dict) -> None:
    """The stack after a range, or a block of them, whose first string has `depth` bytes in common with the last before it."""
    pushed(stack, depth, row["_range"] << 32)
    for x in row["stack"]:
        pushed(stack, x["depth"], x["start"])


def _joined(table: pa.Table) -> pa.Table:
    """The ends of a block of ranges, as if it were one; its number is that of its first range."""
    rows = sorted(table.to_pylist(), key=lambda r: r["_range"])
    stack: list[tuple[int, int]] = []
    last = None
    for row in rows:
        _after(stack, -1 if last is None else int(common([last, row["first"]])[1]), row)
        last = row["last"]
    return _end(rows[0]["_range"], rows[0]["first"], rows[-1]["last"], stack)


def _carried(rows: list[dict], stack: list[tuple[int, int]], depth: int) -> pa.Table:
    """What each of some ranges in order inherits from those before: open classes, and the bytes its first string has in common with the last before it."""
    out, last = [], None
    for row in rows:
        depth = depth if last is None else int(common([last, row["first"]])[1])
        out.append((row["_range"], _stack(stack), depth))
        _after(stack, depth, row)
        last = row["last"]
    return pa.table({"_range": pa.array([x[0] for x in out], pa.int32()), "before": pa.array([x[1] for x in out], _STACK), "depth": pa.array([x[2] for x in out], pa.int64())})


def _over_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["_range"])
    yield from _carried(rows, [], -1).to_batches()


def _in_block(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["_range"])
    return _carried(rows, [(x["depth"], x["start"]) for x in rows[0]["before"]], rows[0]["depth"])


def _classes(table: pa.Table) -> pa.Table:
    """For each string of a range the stack of depths at which classes begin, and where."""
    strings, part = sorted(table["s"].to_pylist()), table["_range"][0].as_py()
    stack = [(x["depth"], x["start"]) for x in table["before"][0].as_py()]
    entries: list[tuple[int, int]] = []
    offsets = [0]
    for i, depth in enumerate(common(strings).tolist()):
        pushed(stack, depth if i else table["depth"][0].as_py(), part << 32 | i)
        entries += stack
        offsets.append(len(entries))
    flat = pa.StructArray.from_arrays([*map(pa.array, np.array(entries, np.int64).reshape(-1, 2).T)], names=["depth", "start"])
    return pa.table({"s": pa.array(strings, pa.binary()), "stack": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)})


def classes(strings: DataFrame, keep=kept) -> DataFrame:
    """(s, stack) from distinct strings (s: binary): two strings agree in n bytes if and only if their stacks' last entries of a depth under n have the same start.

    Ends of ranges are seen block by block, and those of blocks in one place: two strings and LENGTH entries at most for each
    RANGE * BLOCK strings.
    """
    n = strings.count()
    ranged = keep(strings.repartitionByRange(size_bins(n, RANGE, 1), "s").withColumn("_range", F.spark_partition_id()), "ranges")
    end, carried = f"_range int, first binary, last binary, stack {_STACK_SQL}", f"_range int, before {_STACK_SQL}, depth bigint"
    ends = keep(ranged.groupBy("_range").applyInArrow(_ends, end).withColumn("block", F.floor(F.col("_range") / BLOCK).cast("int")), "ends")
    blocks = ends.groupBy("block").applyInArrow(_joined, end)
    begun = keep(blocks.repartition(1).mapInArrow(_over_blocks, carried), "blocks").select(F.floor(F.col("_range") / BLOCK).cast("int").alias("block"), "before", "depth")
    inherited = keep(ends.join(begun, "block").groupBy("block").applyInArrow(_in_block, carried), "carried")
    return ranged.join(inherited, "_range").groupBy("_range").applyInArrow(_classes, f"s binary, stack {_STACK_SQL}")


def _pieces(batch: pa.RecordBatch) -> list[pa.Array]:
    """For each open trigger its strings, in runs of one class in the dictionary and one in the parse: from `first` to `last` bytes before the trigger."""
    t, low, high = _unpacked(batch["place"].to_numpy()).T
    near, far = t - high, t - low
    rows = np.arange(len(t)) << 16  # a key: the row, and below it a depth + 1
    stacks = []
    for c in ("phrase_stack", "parse_stack"):
        held, ends = batch[c].values, batch[c].offsets.to_numpy()
        flat = held.slice(ends[0], ends[-1] - ends[0])
        stacks.append((np.repeat(rows, np.diff(ends)), flat.field("depth").to_numpy() + 1, flat.field("start").to_numpy()))
    (row, depth, start), (rest_row, rest_depth, rest_start) = stacks
    cuts = np.concatenate([row, rest_row]) | np.concatenate([depth, LENGTH + 1 - rest_depth])
    at = cuts >> 16
    first = np.unique(np.concatenate([cuts[(cuts & 0xFFFF > near[at]) & (cuts & 0xFFFF <= far[at])], rows | near]))
    at, first = first >> 16, first & 0xFFFF
    ends = np.flatnonzero(np.append(at[1:] != at[:-1], len(at) > 0))
    last = np.append(first[1:] - 1, 0)[: len(first)]
    last[ends] = far
    phrase = start[np.searchsorted(row | depth, rows[at] | first, "right") - 1]
    parse = rest_start[np.searchsorted(rest_row | rest_depth, rows[at] | LENGTH - first, "right") - 1]
    offsets = np.concatenate([[0], ends + 1])
    rows = pa.StructArray.from_arrays([pa.array(x) for x in (phrase, parse, first, last)], names=["phrase", "parse", "first", "last"])
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)]


def uid(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))


def seed_of(docs: DataFrame) -> tuple[int, DataFrame]:
    """A seed with which uid() differs for rows that differ in doc_id or text, by 64 bits more, and (uid, n) of the rows that are repeated, kept."""
    seed = 0
    while True:
        other = F.xxhash64(F.lit("other"), F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))
        found = docs.select(uid(seed).alias("uid"), other.alias("other")).groupBy("uid").agg(F.count("*").alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"))
        found = kept(found.where("n > 1"), "repeated-rows")
        if found.where("lo <> hi").limit(1).count() == 0:
            return seed, found.select("uid", "n")
        seed += 1


def once_each(docs: DataFrame, seed: int, repeated: DataFrame) -> DataFrame:
    """(uid, text, again) of docs, a row for each uid; again: it is that of several rows. Only the texts of those are shuffled."""
    own = docs.select(uid(seed).alias("uid"), "text")
    few = small(repeated, KEYS)
    mark = few.select("uid", F.lit(True).alias("again"))
    marked = spread_join(own, mark, "uid", [], docs.count(), "left", repeated) if few is repeated else own.join(mark, "uid", "left")
    return marked.where("again IS NULL").union(marked.where("again").dropDuplicates(["uid"]))


def repeated_spans(docs: DataFrame, seed: int, repeated: DataFrame) -> DataFrame:
    """(uid, spans: array<struct<s, e>>): byte spans of repeated strings as maximal runs in order, for texts that have any."""
    with Scratch() as keep:
        texts = once_each(docs, seed, repeated)
        names = ["place", "core", "whole", "check", "times"]
        parsed = with_computed(texts.select("uid", "text"), _parsed, ", ".join([*(f"{c} array<bigint>" for c in names), "inside array<struct<s:bigint,e:bigint>>"]), drop=["text"])
        parsed = keep(parsed, "parsed")
        rows = parsed.agg(F.coalesce(F.sum(F.size("place")), F.lit(0))).first()[0]
        parse = parsed.select("uid", F.explode(F.arrays_zip(*names)).alias("x")).select("uid", "x.place", "x.core", F.struct("x.whole", "x.check").alias("kind"), "x.times")
        twice = lambda df, key, *more: df.groupBy(key).agg(F.count("*").alias("n"), F.sum("times").alias("all"), *more).where("all > 1")
        # written on its own, so that a core that very many triggers have is known
        again = keep(twice(parse, "core").select("core", "n"), "cores-twice")
        cand = keep(spread_join(parse, again.select("core"), "core", ["uid", "place"], rows, "left_semi", again), "repeated-cores")
        whole = keep(twice(cand, "kind", F.min(F.struct("uid", "place", "core")).alias("shown")).select("kind", "n", "shown"), "whole-twice")
        split = spread_join(cand, whole.select("kind", F.lit(True).alias("all")), "kind", ["uid", "place"], cand.count(), "left", whole)
        split = keep(split.select("uid", "place", "core", "all"), "repeats")
        t = F.shiftright("place", 16)
        low, high = t - F.shiftright("place", 8).bitwiseAND(F.lit(255)), t - F.col("place").bitwiseAND(F.lit(255))
        sure = split.where("all").select("uid", low.alias("span_start"), (high + LENGTH).alias("span_end"))
        sure = sure.union(parsed.select("uid", F.inline("inside")))
        length = F.octet_length("text").cast("long")
        sure = sure.union(texts.where("again").select("uid", F.lit(0).cast("long"), length).where(length >= LENGTH))

        # an open trigger may have strings of one that repeats as a whole; of these one of each kind is shown as well
        alone = split.where("all IS NULL").select("uid", "place", "core")
        one = whole.select("shown.*")
        left = keep(alone.union(one.join(alone.select("core").distinct(), "core", "left_semi").select("uid", "place", "core")), "open")
        wanted = keep(left.groupBy("uid").agg(F.collect_set("place").alias("places")), "open-triggers")
        shown = with_computed(texts.join(wanted, "uid").select("uid", "text", "places"), _contexts, "x array<struct<place:bigint,phrase:binary,parse:binary>>", drop=["text", "places"])
        contexts = keep(shown.select("uid", F.inline("x")), "contexts")
        n = contexts.count()
        for part in ("phrase", "parse"):
            order = keep(classes(keep(contexts.select(F.col(part).alias("s")).distinct(), f"{part}-strings"), keep), f"{part}-order")
            contexts = keep(spread_join(contexts, order.toDF(part, f"{part}_stack"), part, ["uid", "place"], n).drop(part), f"{part}-classes")
        spread = contexts.repartition(size_bins(n, 5_000, 1), "uid", "place")
        pieces = with_computed(spread, _pieces, "x array<struct<phrase:bigint,parse:bigint,first:bigint,last:bigint>>", drop=["phrase_stack", "parse_stack"])
        pieces = pieces.select("uid", "place", F.inline("x")).withColumn("classes", F.struct("phrase", "parse")).drop("phrase", "parse")
        pieces = keep(pieces, "pieces")
        # where two runs of the same classes overlap, both have the same strings; a pair of classes has WIDTH + 1 ends at most
        ends = pieces.select("classes", F.inline(F.array(F.struct(F.col("first").alias("far"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("far"), F.lit(-1).alias("step")))))
        ends = ends.groupBy("classes", "far").agg(F.sum("step").alias("step"))
        along = Window.partitionBy("classes").orderBy("far")
        runs = ends.select("classes", "far", F.sum("step").over(along).alias("n"), F.lead("far").over(along).alias("next")).where("n > 1")
        twice = runs.groupBy("classes").agg(F.collect_list(F.struct("far", "next")).alias("twice"))
        met = spread_join(pieces, twice, "classes", ["uid", "place"], pieces.count())
        both = met.select("uid", "place", "first", "last", F.inline("twice")).withColumns({"first": F.greatest("first", "far"), "last": F.least("last", F.col("next") - 1)}).where("first <= last")
        t = F.shiftright("place", 16)
        counted = both.select("uid", (t - F.col("last")).alias("span_start"), (t - F.col("first") + LENGTH).alias("span_end"))
        # spans of a text as maximal runs, before they stand in one cell
        order = Window.partitionBy("uid").orderBy("span_start", "span_end")
        before = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        begins = sure.union(counted).withColumn("begins", F.when(F.coalesce(before, F.lit(-1)) < F.col("span_start"), F.col("span_start")))
        run = F.max("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
        runs = begins.withColumn("s", run).groupBy("uid", "s").agg(F.max("span_end").alias("e"))
        return kept(runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with removed (array of byte spans) and kept_bytes added.

    A null text counts as empty. Texts under LENGTH bytes keep all. Equal texts, and repeated rows, repeat each other; rows equal in
    doc_id and text are parsed once, however many. Texts of any length are parsed whole. An empty table gives an empty one. Columns
    of the names added are replaced; others pass through, whatever their names.
    """
    docs = docs.drop("removed", "kept_bytes")
    key, runs_of = fresh(docs, "_uid", "_spans")
    seed, repeated = seed_of(docs)
    spans = repeated_spans(docs, seed, repeated)
    few = small(spans, KEYS)
    named, keyed = few.toDF(key, runs_of), docs.withColumn(key, uid(seed))
    joined = spread_join(keyed, named, key, [], docs.count(), "left", repeated.toDF(key, "n")) if few is spans else keyed.join(named, key, "left")

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        rest = []
        for text, runs in zip(batch["text"].to_pylist(), batch[runs_of].to_pylist(), strict=True):
            raw = (text or "").encode()
            edges = [0, *(x for run in runs or () for x in (run["s"], run["e"])), len(raw)]
            rest.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return [pa.array([x or [] for x in batch[runs_of].to_pylist()], SPANS), pa.array(rest, pa.binary())]

    return with_computed(joined.drop(key), cut, "removed array<struct<s:bigint,e:bigint>>, kept_bytes binary", drop=[runs_of])


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
