"""Joins of 64-bit hashes that differ in few bits, for thresholds of any width, by an index of bands.

Bits are cut into bands. Hashes that differ in no more bits than the threshold differ little in some band: if band i allows r_i bits, and
the r_i + 1 add up to more than the threshold, not all bands can be exceeded. Within a band one side emits its bits with up to r_i of
them changed, or both meet half way, and an equal value joins them. A pair may meet in several bands and at several values; it is
taken at one of them only, which both hashes decide. How many bands, and whether they meet half way, is what costs least: half way
emits far fewer values, but brings nearby pairs together at several of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.ordering import dealt_pairs

BITS = 64
#: Values that a row emits at most, and what emitting one costs, in comparisons.
VALUES, EMITTED = 20_000, 25
#: Left rows with a value beyond which they are dealt over several tasks.
HOT = 20_000
#: Pairs that one task compares, about.
AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Band:
    """Bits from `low` on; the left side changes up to `left` of them, the right side up to `right`."""

    number: int
    low: int
    width: int
    left: int
    right: int

    @property
    def radius(self) -> int:
        return self.left + self.right

    def of(self, bits: Column) -> Column:
        return bits if self.width == BITS else F.shiftrightunsigned(bits, self.low).bitwiseAND((1 << self.width) - 1)


def ball(width: int, radius: int) -> int:
    """Values that differ in so many bits or fewer."""
    return sum(comb(width, i) for i in range(radius + 1))


def bands(threshold: int, n: int, half: bool = True) -> list[Band]:
    """n bands, whose radii are as small as they may be without losing a pair; n is threshold + 1 at most. half: both sides change bits."""
    edges = [round(BITS * i / n) for i in range(n + 1)]
    radii = [(threshold + 1) // n - 1 + (i < (threshold + 1) % n) for i in range(n)]
    return [Band(i, lo, hi - lo, (r + 1) // 2 if half else r, r // 2 if half else 0) for i, (lo, hi, r) in enumerate(zip(edges, edges[1:], radii, strict=False))]


def layout(threshold: int, left: int, right: int, pairs: int | None = None) -> list[Band]:
    """The bands that cost least for so many rows on each side, of which so many pairs agree otherwise (all): values emitted, and pairs that meet by chance.

    No bands, if comparing all is cheapest, as with few rows or a threshold that most pairs are within.
    """
    pairs = left * right if pairs is None else pairs
    costs = [(EMITTED * (left + right) + pairs, 0, False)]
    for n in range(1, min(threshold, BITS - 1) + 2):
        for half in (True, False):
            found = bands(threshold, n, half)
            emitted = [sum(ball(b.width, getattr(b, side)) for b in found) for side in ("left", "right")]
            if max(emitted) <= VALUES:
                costs.append((EMITTED * (left * emitted[0] + right * emitted[1]) + pairs * chance(found), n, half))
    _, n, half = min(costs)
    return bands(threshold, n, half) if n else []


def cost(found: Sequence[Band], left: int, right: int, pairs: int, used: int | None = -1) -> float:
    """What bands cost, in comparisons: values emitted, and pairs that meet by chance; used: see chance()."""
    emitted = [sum(ball(b.width, getattr(b, side)) for b in found) if found else 1 for side in ("left", "right")]
    return EMITTED * (left * emitted[0] + right * emitted[1]) + pairs * chance(found, used)


def chance(found: Sequence[Band], used: int | None = -1) -> float:
    """How often a pair of random hashes meets, of which only the bits in `used` differ at all (None: none); in bands without such bits all meet."""
    if not found:
        return 1.0
    bits = [(((used or 0) >> b.low) & ((1 << b.width) - 1)).bit_count() for b in found]
    return sum(ball(n, b.left) * ball(n, b.right) / 2**n for b, n in zip(found, bits, strict=True))


def _changes(width: int, radius: int) -> Column:
    """All ways to change so many bits or fewer."""
    found = [sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(range(width), r)]
    return F.lit(np.array([x - (1 << BITS) if x >> (BITS - 1) else x for x in found], np.int64))


def _shift(found: Sequence[Band]) -> int:
    """Bits that a value has in a key, above which the band's number stands."""
    return max(b.width for b in found) if len(found) > 1 else 0


def _keys(bits: Column, found: Sequence[Band], side: str) -> Column:
    if not found:
        return F.array(F.lit(0).cast("long"))
    changed = lambda b: F.transform(_changes(b.width, getattr(b, side)), lambda c: b.of(bits).bitwiseXOR(c) + F.lit(b.number << _shift(found)))
    return F.flatten(F.array(*map(changed, found)))


def _first_key(left: Column, right: Column, found: Sequence[Band]) -> Column:
    """The one key at which a pair is taken: in the first band that is near enough; the left side changes the lowest bits that differ, as few as it must."""
    out = None if found else F.lit(0).cast("long")
    for b in found:
        differ = b.of(left.bitwiseXOR(right))
        n = F.bit_count(differ)
        rest = differ
        for k in range(1, b.left + 1):  # the lowest bits go one after another, as long as the right side can't change them all
            rest = F.when(n - b.right >= k, rest.bitwiseAND(rest - 1)).otherwise(rest)
        key = b.of(left).bitwiseXOR(differ.bitwiseXOR(rest)) + F.lit(b.number << _shift(found))
        out = F.when(n <= b.radius, key) if out is None else out.when(n <= b.radius, key)
    return out


def near(left: DataFrame, right: DataFrame, threshold: int, found: Sequence[Band], on: Sequence[str] = (), rows: int = 0, pairs: int = 0) -> DataFrame:
    """(a, b): structs of the rows of left and right whose `bits` (long) differ in no more bits than the threshold, and that agree in the columns `on`; each pair once.

    found: a layout() for the threshold. Rows without bits, or without a value in `on`, are near none. A value that over HOT left rows
    emit is dealt over several tasks, and the right rows that emit it are copied as often; without bands, where all values are one,
    so that a task compares about AT_ONCE pairs, for so many right rows. pairs: how many there are in all, of which tasks are made;
    by bytes alone they would be too few, as pairs cost more than rows.
    """
    emitted = lambda df, side, name: df.where("bits IS NOT NULL").select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name), *(F.col(f"`{c}`").alias(f"_on{i}") for i, c in enumerate(on)), F.explode(_keys(F.col("bits"), found, side)).alias("_key")
    )
    own, other = emitted(left, "left", "a"), emitted(right, "right", "b")
    keys = ["_key", *(f"_on{i}" for i in range(len(on)))]
    own, other, keys = dealt_pairs(own, other, keys, HOT if found or not rows else max(1, min(HOT, AT_ONCE // rows)), ["a"])
    tasks = min(4_000, int(pairs * chance(found)) // AT_ONCE)
    if tasks > 1:
        own, other = own.repartition(tasks, *keys), other.repartition(tasks, *keys)
    a, b = F.col("a.bits"), F.col("b.bits")
    return own.join(other, keys).where((F.bit_count(a.bitwiseXOR(b)) <= threshold) & (F.col("_key") == _first_key(a, b, found))).select("a", "b")
