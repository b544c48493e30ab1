"""Minimax contiguous partition: shards of near-equal bytes that never part equal texts.

The atoms are the distinct texts, ordered by a hash of the text. An order-preserving histogram of atom
sizes is all the driver sees: at most ``FANOUT`` cells per refined cell. The smallest feasible capacity is
found by binary search; a capacity is checked by filling shards greedily along the prefix sums. Where a
fill would end inside a cell that holds several atoms, both ends of the cell are tried; if the answer
depends on it, just those cells are split further by one more aggregation. The result is exact, whatever
the number of texts, and a text with a third of all rows is one atom like any other.

Under that capacity every shard then ends as near as it can to an equal part of what is left, so that an atom
that is larger than a shard's part does not leave shards without rows.

Everything is DataFrame operations; the binary search runs on the driver over the bounded histogram.

Defined results: a NULL text counts as an empty one (size 1, crc 0) and both are one atom; an empty table
gives an empty result; repeated rows stay repeated, each with a slot of its own; a table with fewer atoms
than shards leaves the last shards empty; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, shuffle_width
from .registry import query

KEY_BITS, STEP_BITS = 60, 12
FANOUT = 1 << STEP_BITS
#: Slots are numbered in this many blocks per shard and shuffle partition.
BLOCKS_PER_TASK = 4


@dataclass(frozen=True)
class Cell:
    """The atoms whose key starts with ``prefix`` (``depth`` steps of 12 bits): their bytes, first and last key."""

    depth: int
    prefix: int
    size: int
    first: int
    last: int

    @property
    def whole(self) -> bool:
        return self.first == self.last


def split_cells(rows: DataFrame, cells: list[Cell]) -> list[Cell]:
    """The histogram of the given cells, one step finer: one aggregation per depth, at most FANOUT rows per cell."""
    out = []
    for depth in sorted({c.depth for c in cells}):
        here = [c for c in cells if c.depth == depth]
        shift = KEY_BITS - STEP_BITS * (depth + 1)
        inside = rows
        if depth:
            inside = rows.where(F.shiftright("key", shift + STEP_BITS).isin([c.prefix for c in here]))
        found = (inside.groupBy(F.shiftright("key", shift).alias("prefix"))
                 .agg(F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last")).collect())
        out += [Cell(depth + 1, r["prefix"], r["size"], r["first"], r["last"]) for r in found]
    return out


def fill(ends: list[int], cells: list[Cell], capacity: int, shards: int, late: bool) -> tuple[bool, list[int], set[int]]:
    """Greedy check: does ``capacity`` suffice; the index of the first cell of every further shard; the cells
    in whose inside a shard would end. ``late`` takes the best case for those, else the worst."""
    base, total, cuts, inside = 0, ends[-1], [], set()
    for _ in range(shards):
        limit = base + capacity
        at = bisect_right(ends, limit)
        base = ends[at - 1] if at else 0
        if at < len(cells) and not cells[at].whole and limit > base:
            inside.add(at)
            if late:
                base = min(limit, ends[at] - 1)
        cuts.append(at)
        if base >= total:
            break
    return base >= total, cuts[:-1] if base >= total else cuts, inside


def even_cuts(ends: list[int], cells: list[Cell], capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Cuts near equal parts of what is left, none larger than ``capacity``, which must suffice: the index of the
    first cell of every further shard, and the cells that must be split to tell."""
    bounds, inside, end = [0, *ends], set(), len(cells)
    need = [end]    # the first bound from which so many shards suffice
    for _ in range(shards - 1):
        limit = bounds[need[-1]] - capacity
        at = bisect_left(bounds, max(0, limit))
        if bounds[at] > max(0, limit) and not cells[at - 1].whole:
            inside.add(at - 1)
        need.append(at)
    at, cuts = 0, []
    for left in range(shards, 1, -1):
        base = bounds[at]
        most = bisect_right(bounds, base + capacity) - 1
        least = max(at + 1, need[left - 1])
        aim = base + (ends[-1] - base) / left
        near = bisect_left(bounds, aim)
        if bounds[near] > aim and not cells[near - 1].whole:
            inside.add(near - 1)
        if aim - bounds[near - 1] < bounds[near] - aim:
            near -= 1
        if most < max(near, least) and most < end and not cells[most].whole:
            inside.add(most)
        fewest = end - (left - 1)    # so that the shards after it get an atom each
        if near > fewest:
            inside |= {i for i in range(max(at, fewest), end) if not cells[i].whole}
        at = max(at + 1, min(most, fewest, max(near, least)))
        if at >= end:
            break
        cuts.append(at)
    return cuts, inside


def smallest_capacity(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest largest shard over all ways to cut the ordered atoms, and the keys at which even shards begin.

    ``rows`` has ``key`` and ``size``.
    """
    cells = sorted(split_cells(rows, [Cell(0, 0, 0, 0, 1)]), key=lambda c: c.first)
    if not cells:
        return 0, []
    low, high = 1, sum(c.size for c in cells)
    low = max(-(-high // shards), max(c.size for c in cells if c.whole) if any(c.whole for c in cells) else 1)
    while True:
        ends = list(accumulate(c.size for c in cells))
        unclear: set[int] = set()
        while low < high and not unclear:
            middle = (low + high) // 2
            sure, _, worst = fill(ends, cells, middle, shards, late=False)
            possible, _, best = fill(ends, cells, middle, shards, late=True)
            if sure:
                high = middle
            elif not possible:
                low = middle + 1
            else:
                unclear = worst | best
        if not unclear:
            enough, _, unclear = fill(ends, cells, low, shards, late=False)
            if not unclear:
                assert enough
                cuts, unclear = even_cuts(ends, cells, low, shards)
            if not unclear:
                assert all(b - a <= low for a, b in pairwise([0, *(ends[i - 1] for i in cuts), ends[-1]]))
                return low, [cells[i].first for i in cuts]
        kept = [c for i, c in enumerate(cells) if i not in unclear]
        cells = sorted(kept + split_cells(rows, [cells[i] for i in unclear]), key=lambda c: c.first)


def text_key(text: Column) -> Column:
    """A 60-bit order key of a text; two different texts with one key would only share a shard."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, key, shard, slot``.

    Texts are read once; what follows works on a narrow copy in the shared folder. Slots count from 0 in
    every shard: rows are dealt to blocks, counted, and numbered inside their block, so that neither a
    shard nor a text that many rows share is ordered in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = settle(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"),
        F.monotonically_increasing_id().alias("row")), "op2-narrow")
    _, starts = smallest_capacity(narrow, shards)
    shard = F.lit(0)
    for i, start in enumerate(starts, 1):
        shard = F.when(F.col("key") >= F.lit(start), F.lit(i)).otherwise(shard)
    blocks = min(8192, BLOCKS_PER_TASK * shuffle_width(docs.sparkSession))
    placed = narrow.select("*", shard.alias("shard"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    earlier = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = (placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
              .select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy("key", "doc_id", "row")) - 1
    return (placed.join(before, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("before") + inside).cast("bigint").alias("slot")))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
