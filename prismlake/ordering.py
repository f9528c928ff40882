"""Sums and numbers over an order that is too long for one task, joins on keys that hold most rows, and repeated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.storage import Kept, small

#: Stands for null where a key is needed.
NO_KEY = "~"
#: A key with more than this share of a table's rows is dealt over several tasks where the table is joined, if it has so many rows at least.
SHARE, LEAST = 2_000, 500
#: Copies that one task makes of a row.
COPIES = 10_000
#: Rows of small tables, of which a key may have all in one task.
A_KEY = 200_000
#: Ranges whose sums are ordered in one task, and ranges whose starts are sent to all executors at most.
BLOCK, STARTS = 1_000, 1_000_000


def key_of(column: str | Column) -> Column:
    """A key that is never null, in the order of the column's code points, null last."""
    value = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(NO_KEY))


def size_bins(rows: int, a_bin: int = 20_000, least: int = 16) -> int:
    """So many bins that each holds about a_bin rows."""
    return max(least, -(-rows // a_bin))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names of working columns like the wanted ones, none of which a column of df has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running(df: DataFrame, keys: Sequence[str], bin_col: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before each one, for equal `keys`, ordered by `bin_col` and then `order`.

    Only the sums of the bins are ordered in one place; the rows are ordered bin by bin, so a key that holds most rows
    still spreads over as many tasks as it has bins. Null keys form a group of their own. Ties in `order` must be rows
    that the caller doesn't tell apart; where there may be many, they should come as one row with a value.
    """
    names = [f"_{k}_key" for k in keys]
    df = df.withColumns({n: key_of(k) for n, k in zip(names, keys, strict=True)} | {"_value": value})
    sums = df.groupBy(*names, bin_col).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*names).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*names, bin_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = own.join(starts, [*names, bin_col])
    return joined.withColumn(out, F.col("_start") + F.col("_inside")).drop(*names, "_value", "_inside", "_start")


def numbered(df: DataFrame, column: str, out: str, rows: int) -> DataFrame:
    """Adds `out`: 1, 2, 3 … in the order of a column of distinct integers that aren't null; rows: about how many there are."""
    ends = df.agg(F.min(column), F.max(column)).first()
    width = max(1, -(-((ends[1] or 0) - (ends[0] or 0) + 1) // size_bins(rows)))
    binned = df.withColumn("_bin", F.floor((F.col(column) - (ends[0] or 0)) / width))
    return running(binned, [], "_bin", [F.col(column)], F.lit(1), "_before").withColumn(out, F.col("_before") + 1).drop("_bin", "_before")


def in_order(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], rows: int) -> DataFrame:
    """Adds for each entry of `sums` the sum of its value over all rows before, in an order of any columns; rows: about how many there are.

    Rows are dealt by ranges of the order and written, so that each keeps its place; then only sums of ranges are ordered, see
    range_starts(). Rows of a single range are ordered as they are. Ties may stand in any order.
    """
    ranges = size_bins(rows, least=1)
    if ranges == 1:
        all_before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({c: F.coalesce(F.sum(v).over(all_before), F.lit(0)) for c, v in sums.items()})
    values = {f"_value_{c}": v for c, v in sums.items()}
    dealt = Kept(df.withColumns(values).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges").df
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = range_starts(dealt.groupBy("_range").agg(*(F.sum(f"_value_{c}").alias(c) for c in sums)), list(sums))
    own = dealt.withColumns({f"_inside_{c}": F.coalesce(F.sum(f"_value_{c}").over(inside), F.lit(0)) for c in sums})
    joined = own.join(small(starts, STARTS), "_range")
    return joined.withColumns({c: F.col(f"_start_{c}") + F.col(f"_inside_{c}") for c in sums}).select(*df.columns, *sums)


def range_starts(by_range: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_range, _start_<column>…), kept: for each of the ranges of by_range (_range: from 0, and the columns) the sums over all ranges before.

    In two levels: a task adds up BLOCK ranges, and only the sums of blocks are ordered in one place.
    """
    sums = Kept(by_range.withColumn("_block", F.floor(F.col("_range") / BLOCK)), "range-sums").df
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("_block").agg(*(F.sum(c).alias(f"_sum_{c}") for c in columns))
    blocks = blocks.select("_block", *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns))
    inside = Window.partitionBy("_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    found = sums.join(blocks, "_block").select("_range", *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_before_{c}")).alias(f"_start_{c}") for c in columns))
    return Kept(found, "range-starts").df


def placed(df: DataFrame, out: str) -> DataFrame:
    """df, whose partitions and rows stand in order, with `out`: 1, 2, 3 … in that order; kept."""
    at = fresh(df, "_at")[0]
    rows = Kept(df.withColumn(at, F.monotonically_increasing_id()), "placed").df  # the partition's number in the upper bits, the row's in the lower 33
    rows = rows.withColumn("_range", F.shiftrightunsigned(at, 33))
    starts = range_starts(rows.groupBy("_range").agg(F.count("*").alias("n")), ["n"])
    joined = rows.join(small(starts, STARTS), "_range")
    return Kept(joined.withColumn(out, F.col("_start_n") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at, "_range", "_start_n"), "in-order").df


def spread_join(many: DataFrame, one: DataFrame, key: str, by: Sequence[str], rows: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined with `one`, which has one row for a key, on `key`; how: inner, left or left_semi. rows: about how many `many` has.

    Where a key holds more than a share of the rows, its rows are dealt by a hash of the columns `by` (none: by their place in
    the table, for rows that may be equal), and its row of `one` is copied as often. Keys above the share are fewer than SHARE, so their list is sent to all. many should be kept, as it is read twice, unless
    counts (the key and `n`) are known.
    """
    salt, salts, hot = fresh(many, "_salt", "_salts", "_hot")
    limit = max(LEAST, rows // SHARE)
    held = many.groupBy(F.col(f"`{key}`").alias(hot)).agg(F.count("*").alias(salts)) if counts is None else counts.select(F.col(f"`{key}`").alias(hot), F.col("n").alias(salts))
    held = held.where(F.col(salts) > limit)
    held = F.broadcast(held.select(hot, F.ceil(F.col(salts) / limit).cast("int").alias(salts)))  # fewer than SHARE rows
    at = F.xxhash64(*(F.col(f"`{c}`") for c in by)) if by else F.monotonically_increasing_id()
    deal = F.coalesce(F.pmod(at, F.col(salts)), F.lit(0)).cast("int")
    dealt = many.join(held, F.col(f"`{key}`") == F.col(hot), "left").withColumn(salt, deal).drop(hot, salts)
    copied = one.join(held, F.col(f"`{key}`") == F.col(hot), "left")
    copied = copied.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(hot, salts)
    return dealt.join(copied, [key, salt], how).drop(salt)


def dealt_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int, by: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """left and right with the keys to join them by, for joins of many rows with many: left rows of a key that has more than `most` are
    dealt over several tasks by a hash of the columns `by`, and right rows of it are copied as often."""
    salt, salts = fresh(left, "_salt", "_salts")
    hot = Kept(left.groupBy(*keys).agg(F.count("*").alias(salts)).where(F.col(salts) > most), "hot-keys").df
    if hot.limit(1).count() == 0:
        return left, right, list(keys)
    hot = small(hot.withColumn(salts, F.ceil(F.col(salts) / most).cast("int")), STARTS)
    own = left.join(hot, list(keys), "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*by), F.col(salts)), F.lit(0)).cast("int")).drop(salts)
    other = right.join(hot, list(keys), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    return own, other, [*keys, salt]


def per_key(df: DataFrame, key: str, order: Sequence[Column], value: Column, out: str, rows: int) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of equal key before each one, however many the key has; rows: about how many there are."""
    if rows <= A_KEY:
        return df.withColumn(out, F.coalesce(F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held, first = fresh(df, "_held", "_first")
    summed = Kept(in_order(df, [F.col(key), *order], {held: value}, rows), "per-key").df
    starts = summed.groupBy(key).agg(F.min(held).alias(first))
    return spread_join(summed, starts, key, [], rows).withColumn(out, F.col(held) - F.col(first)).select(*df.columns, out)


def copies(df: DataFrame, n: str, number: str, rows: int) -> DataFrame:
    """Each row of df n times, numbered from 0 in `number`; rows: about how many come out. n is a long and not null.

    Rows with very many copies are dealt over tasks first, so that no task makes all of them. df should be kept, as it is read twice.
    """
    at = fresh(df, "_at")[0]
    first = F.lit(0).cast("long")
    few = df.where(F.col(n).between(1, COPIES)).withColumn(number, F.explode(F.sequence(first, F.col(n) - 1)))
    if df.where(F.col(n) > COPIES).limit(1).count() == 0:
        return few
    many = df.where(F.col(n) > COPIES).withColumn(at, F.explode(F.sequence(first, F.col(n) - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition(size_bins(rows, 10 * COPIES, 1), at)
    many = many.withColumn(number, F.explode(F.sequence(F.col(at), F.least(F.col(at) + COPIES, F.col(n)) - 1))).drop(at)
    return few.union(many.select(*few.columns))
