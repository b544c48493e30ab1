"""Range joins without comparing every pair."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import block_of, quantiles


def band_join(points: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, slots: int | None = None) -> DataFrame:
    """Pairs with ``lo <= value < hi``, as an equi-join on slots of the value axis.

    The slots are cut at quantiles of the points, so each holds about as many of them, however dense a spot is. A
    value that takes several slots' share has one slot, whose points are dealt to as many copies of the intervals there.
    An interval is listed under every slot it touches, a point only under its own, so no pair is met twice, and an
    interval has at most twice as many copies as there are slots. A NULL is in no interval.
    """
    found, _, _ = quantiles(points, value, slots, keyed=False)
    bounds = sorted(set(found))
    # a slot ends with its cut point, so a repeated one tells how many shares the slot holds
    shares = Counter(found)
    copies = F.array(*[F.lit(shares[b]) for b in bounds], F.lit(1))
    salt = F.pmod(F.xxhash64(*points.columns), F.get(copies, F.col("_slot"))).cast("int")
    dealt = points.where(F.col(value).isNotNull()).withColumn("_slot", block_of(F.col(value), bounds)).withColumn("_copy", salt)
    near = intervals.where(F.col(lo) < F.col(hi))
    listed = near.withColumn("_slot", F.explode(F.sequence(block_of(F.col(lo), bounds), block_of(F.col(hi), bounds)))).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.get(copies, F.col("_slot")) - 1)))
    return dealt.join(listed, ["_slot", "_copy"]).where((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("_slot", "_copy")
