"""Ordered computations that stay parallel when one key, or no key at all, holds most of the rows.

A plain window sorts all rows of a key in one task. Here the order column's value range is cut into
blocks by approximate quantiles of the whole table, so a block holds about ``1/blocks`` of all rows
whatever their keys are. Work is then done per (key, block): totals are pre-aggregated, carried forward
over the (few) blocks of each key, and joined back to the rows. Block limits are literals of the plan,
so a recomputed task always cuts its rows the same way, and any limits give exact results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_width

BLOCK = "_block"
KEY = "_key"


# Up to this many cut points a tree of comparisons is compiled; beyond, the cut points are searched.
TREE_LIMIT = 255
# Without keys there is one group per block, and several blocks per task even out their placement.
BLOCKS_PER_TASK = 4


def quantiles(df: DataFrame, order: str, blocks: int | None = None, keyed: bool = True) -> tuple[list[float], float, int]:
    """Approximate quantiles of the order column, one less than ``blocks``, from one pass over it: a value that many rows
    have comes several times. Also the share of NULLs, and the number of blocks."""
    width = shuffle_width(df.sparkSession)
    n = blocks or (width if keyed else min(8192, width * BLOCKS_PER_TASK))
    probs = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.col(order), probs, max(1000, 10 * n)).alias("q"),
                   F.count(F.when(F.col(order).isNull(), 1)).alias("nulls"), F.count("*").alias("n")).first()
    return sorted(found["q"] or []), found["nulls"] / max(1, found["n"]), n


def block_bounds(df: DataFrame, order: str, blocks: int | None = None, keyed: bool = True) -> list[float]:
    """Cut points for the order column: at most ``blocks`` numbers, from one pass over that column."""
    return sorted(set(quantiles(df, order, blocks, keyed)[0]))


def block_of(c: Column, bounds: Sequence[float]) -> Column:
    """The number of cut points below the value (0 for NULL, which sorts first): a balanced tree of comparisons,
    or a binary search."""
    if len(bounds) > TREE_LIMIT:
        return _search(c, bounds)
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return F.when(c.isNull(), 0).otherwise(tree(0, len(bounds))) if len(bounds) else F.lit(0)


def _search(c: Column, bounds: Sequence[float]) -> Column:
    return _search_in(c, F.array(*[F.lit(b) for b in bounds]), len(bounds))


def _search_in(c: Column, points: Column, most: int) -> Column:
    """How many of the points (an ascending array of at most so many) are below the value; 0 for NULL."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(points, at + step - 1) < c, F.lit(False)), at + step).otherwise(at))


# Block numbers of rows whose key is NULL start here, so such a row needs no NULL to be told apart.
NULL_BLOCKS = 1 << 28


class _Cut:
    """A table cut into order blocks, with one non-NULL key column that plain equality can join on.

    A single integer or text key is used as it is, NULL being replaced by a stand-in whose blocks are
    numbered apart; other keys are packed into a struct, which compares field by field with NULL equal
    to NULL. A shuffle on (key, block) made for the join thus also serves the window.

    A value that takes several blocks' share of all rows (NULL as well) would fill one of them. With numeric ``ties``
    its rows get blocks of their own, cut by quantiles of the first tie among them: ``parts`` of a hot value, numbered
    from 1, follow the other values of its block. Only rows with equal order value and tie then always share a block.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str, blocks: int | None,
                 bounds: Sequence[float] | None, ties: Sequence[str] = ()) -> None:
        if not isinstance(df.schema[order].dataType, T.NumericType):
            raise TypeError(f"{order} must be numeric to be cut into blocks")
        self.columns, self.keys, self.order = df.columns, list(keys), order
        self.parts: dict[float | None, list[float]] = {}
        if bounds is None:
            found, nulls, n = quantiles(df, order, blocks, bool(keys))
            self.bounds = sorted(set(found))
            if ties and isinstance(df.schema[ties[0]].dataType, T.NumericType):
                self._part(df, ties[0], {v: c for v, c in Counter(found).items() if c > 1}, int(nulls * n), n)
        else:
            self.bounds = list(bounds)
        self.tie, self.stride = ties[0] if self.parts else None, max(map(len, self.parts.values()), default=0) + 2
        kind = df.schema[keys[0]].dataType if len(self.keys) == 1 else None
        self.plain = isinstance(kind, (T.IntegralType, T.StringType))
        self.by = [KEY, BLOCK] if keys else [BLOCK]
        packed, self.apart = [], F.lit(0)
        if self.plain:
            k = F.col(keys[0])
            packed = [F.coalesce(k, F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)).alias(KEY)]
            self.apart = F.when(k.isNull(), NULL_BLOCKS).otherwise(0)
        elif keys:
            packed = [F.struct(*keys).alias(KEY)]
        kept = [c for c in df.columns if c not in self.keys or c == order]
        self.rows = df.select(*packed, *kept, self.block(F.col(order)).alias(BLOCK))
        parts = [F.col(KEY), F.col(BLOCK) >= NULL_BLOCKS] if self.plain else [F.col(KEY)]
        self.per_key = W.partitionBy(*parts) if keys else W.partitionBy(F.lit(0))

    def _part(self, df: DataFrame, tie: str, hot: dict[float, int], nulls: int, n: int) -> None:
        """Cut points of the tie among the rows of each hot value, as many as it has blocks' shares."""
        if nulls > 1:
            hot = {**hot, None: nulls}
        if not hot:
            return
        same = F.col(self.order).isNull() if set(hot) == {None} else F.col(self.order).isin([v for v in hot if v is not None])
        rows = df.where(same | F.col(self.order).isNull() if None in hot else same)
        probs = [i / n for i in range(1, n)]
        for r in rows.groupBy(self.order).agg(F.percentile_approx(F.col(tie), probs, max(1000, 10 * n)).alias("q")).collect():
            cuts, most = r["q"] or [], hot.get(r[0], 1)
            self.parts[r[0]] = sorted({cuts[len(cuts) * i // most] for i in range(1, most)} if cuts else set())

    def block(self, c: Column) -> Column:
        if not self.parts:
            return block_of(c, self.bounds) + self.apart
        base = F.when(c.isNull(), 0).otherwise(block_of(c, self.bounds) + 1)
        points = F.lit(None).cast("array<double>")
        for value, cuts in self.parts.items():
            mine = c.isNull() if value is None else c == F.lit(value)
            points = F.when(mine, F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>")).otherwise(points)
        part = F.when(points.isNull(), 0).otherwise(1 + _search_in(F.col(self.tie).cast("double"), points, self.stride))
        return (base * self.stride + part).cast("int") + self.apart

    def part(self) -> Column:
        """0, or the number of the block among those of its hot value."""
        return F.col(BLOCK) % NULL_BLOCKS % self.stride if self.parts else F.lit(0)

    def base(self) -> Column:
        return F.floor(F.col(BLOCK) % NULL_BLOCKS / self.stride) if self.parts else F.col(BLOCK)

    def key(self, name: str) -> Column:
        if self.plain:
            return F.when(F.col(BLOCK) < NULL_BLOCKS, F.col(KEY)).alias(name)
        return F.col(KEY)[name].alias(name)

    def window(self, reverse: bool = False, ties: Sequence[str] = ()):
        cols = [F.col(c) for c in [self.order, *ties]]
        return W.partitionBy(*self.by).orderBy(*[c.desc() if reverse else c.asc() for c in cols])

    def before(self, totals: DataFrame, names: Sequence[str], reverse: bool = False) -> DataFrame:
        """Totals per block to sums over the earlier blocks of the same key: at most one row per block each."""
        w = self.per_key.orderBy(F.col(BLOCK).desc() if reverse else F.col(BLOCK).asc()).rowsBetween(W.unboundedPreceding, -1)
        return totals.select(*self.by, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names])

    def unpack(self, df: DataFrame, *new: str) -> DataFrame:
        return df.select(*[self.key(c) if c in self.keys and c != self.order else F.col(c) for c in self.columns], *new)


def running(df: DataFrame, keys: Sequence[str], order: str, sums: Mapping[str, Column],
            reverse: bool = False, blocks: int | None = None, ties: Sequence[str] = (),
            bounds: Sequence[float] | None = None) -> DataFrame:
    """Inclusive running sums per key in the given order, as new columns.

    ``order`` (with ``ties`` as further order columns) must order the rows of a key uniquely. An order value that very
    many rows have needs a numeric first tie, by which its rows are cut again. Without keys the running sums
    go over the whole table. ``bounds`` reuses cut points found before.
    """
    names = list(sums)
    valued = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    cut = _Cut(valued, keys, order, blocks, bounds, ties)
    totals = cut.rows.groupBy(*cut.by).agg(*[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in names])
    before = cut.before(totals, [f"_c_{n}" for n in names], reverse)
    w = cut.window(reverse, ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = cut.rows.join(before, cut.by).withColumns({n: F.sum(f"_v_{n}").over(w) + F.col(f"_c_{n}") for n in names})
    replaced = [c for c in cut.columns if not c.startswith("_v_") and c not in names]
    return cut.unpack(out, *names).select(*replaced, *names)


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                blocks: int | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """Inclusive running maximum per key, in the manner of :func:`running`."""
    cut = _Cut(df.withColumn("_v", value), keys, order, blocks, bounds)
    tops = cut.rows.groupBy(*cut.by).agg(F.max("_v").alias("_top"))
    w = cut.per_key.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    before = tops.select(*cut.by, F.max("_top").over(w).alias("_before"))
    inside = F.max("_v").over(cut.window().rowsBetween(W.unboundedPreceding, W.currentRow))
    out = cut.rows.join(before, cut.by).withColumn(name, F.greatest(inside, "_before"))
    return cut.unpack(out, name).drop("_v")


def number_rows(df: DataFrame, order: str, name: str = "_rid", keys: Sequence[str] = (), start: int = 1,
                reverse: bool = False, blocks: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Dense row numbers ``start, start+1, …`` in order, per key or over the whole table."""
    out = running(df, keys, order, {name: F.lit(1).cast("bigint")}, reverse, blocks, ties)
    return out.withColumn(name, F.col(name) + F.lit(start - 1).cast("bigint"))


def keep_newest(df: DataFrame, keys: Sequence[str], order: str, n: int, blocks: int | None = None,
                ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of each key with the highest order value.

    Blocks whose later blocks already hold ``n`` rows are left out of the join, so of a key of any size
    only the newest blocks are ranked.
    """
    cut = _Cut(df, keys, order, blocks, None, ties)
    totals = cut.rows.groupBy(*cut.by).agg(F.count("*").alias("_later"))
    later = cut.before(totals, ["_later"], reverse=True).where(F.col("_later") < n)
    near = cut.rows.join(later, cut.by)
    ranked = near.withColumn("_at", F.row_number().over(cut.window(reverse=True, ties=ties)))
    return cut.unpack(ranked.where(F.col("_at") + F.col("_later") <= n))


def rank_rows(df: DataFrame, keys: Sequence[str], order: str, blocks: int | None = None,
              ties: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Window ranking columns per key without one task per key.

    Adds ``row_number`` (ties broken by ``ties``), ``rank``, ``dense_rank``, ``percent_rank`` and
    ``cume_dist`` of the order column, and ``ntile`` when ``buckets`` is given. Equal order values share a block, or
    all blocks that are parts of a hot value, so ranks need the counts of the earlier blocks added, or are those of
    the first of the parts.
    """
    cut = _Cut(df, keys, order, blocks, None, ties)
    per_value = cut.rows.groupBy(*cut.by, order).agg(F.count("*").alias("_n"))
    totals = per_value.groupBy(*cut.by).agg(F.sum("_n").alias("_rows"), F.count("*").alias("_values"))
    totals = totals.select(*cut.by, "_rows", "_values", cut.part().alias("_part"), cut.base().alias("_base"))
    keyed = [KEY] if keys else []
    apart = [F.col(BLOCK) >= NULL_BLOCKS] if cut.plain else []
    of_value = W.partitionBy(*keyed, *apart, "_base", F.col("_part") > 0)
    # a hot value counts once, in the first of its parts that this key has
    first = (F.col("_part") == 0) | (F.col("_part") == F.min("_part").over(of_value))
    totals = totals.withColumn("_values", F.when(first, F.col("_values")).otherwise(0))
    w = cut.per_key.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*cut.by, "_part", "_base", F.col("_rows").alias("_own"), F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_rows"),
                           F.coalesce(F.sum("_values").over(w), F.lit(0)).alias("_values"), F.sum("_rows").over(cut.per_key).alias("_size"))
    before = before.withColumns({"_g_rows": F.min("_rows").over(of_value), "_g_values": F.min("_values").over(of_value),
                                 "_g_end": F.max(F.col("_rows") + F.col("_own")).over(of_value)}).drop("_base", "_own")
    by, exact = cut.window(), cut.window(ties=ties)
    through = by.rangeBetween(W.unboundedPreceding, W.currentRow)
    hot = F.col("_part") > 0
    out = cut.rows.join(before, cut.by).withColumns({
        "row_number": F.row_number().over(exact) + F.col("_rows"),
        "rank": F.when(hot, F.col("_g_rows") + 1).otherwise(F.rank().over(by) + F.col("_rows")),
        "dense_rank": F.when(hot, F.col("_g_values") + 1).otherwise(F.dense_rank().over(by) + F.col("_values")),
        "_upto": F.when(hot, F.col("_g_end")).otherwise(F.count("*").over(through) + F.col("_rows")),
    })
    out = out.withColumns({
        "percent_rank": F.when(F.col("_size") > 1, (F.col("rank") - 1) / (F.col("_size") - 1)).otherwise(0.0),
        "cume_dist": F.col("_upto") / F.col("_size"),
    })
    new = ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist"]
    if buckets:
        big, small = F.col("_size") % buckets, F.floor(F.col("_size") / buckets)
        at = F.col("row_number") - 1
        edge = big * (small + 1)
        out = out.withColumn("ntile", F.when(at < edge, F.floor(at / (small + 1)))
                             .otherwise(big + F.floor((at - edge) / F.greatest(small, F.lit(1)))) + 1)
        new.append("ntile")
    return cut.unpack(out, *new)


def neighbours(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, str], ahead: bool = False,
               blocks: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """The value of the previous (or next) row of the same key: ``values`` maps new name to source column.

    Only the first row of a block needs the last row of the key's previous non-empty block, and those
    edge rows are one per (key, block).
    """
    cut = _Cut(df, keys, order, blocks, None, ties)
    place = F.struct(F.col(order), *[F.col(t) for t in ties])
    value = F.struct(*[F.col(s).alias(n) for n, s in values.items()])
    edge, shift = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    edges = cut.rows.groupBy(*cut.by).agg(edge(value, place).alias("_edge"))
    edges = edges.withColumn("_edge", shift("_edge").over(cut.per_key.orderBy(BLOCK)))
    out = cut.rows.join(edges, cut.by).withColumn("_inside", shift(value).over(cut.window(ties=ties)))
    pick = F.when(F.col("_inside").isNotNull(), F.col("_inside")).otherwise(F.col("_edge"))
    return cut.unpack(out.withColumns({n: pick[n] for n in values}), *values)


def rolling(df: DataFrame, keys: Sequence[str], order: str, aggs: Mapping[str, Column], back: float, ahead: float = 0,
            blocks: int | None = None) -> DataFrame:
    """Aggregates over the rows of a key whose order value lies between ``-back`` and ``+ahead`` of the row's.

    Every row is also listed in the further blocks its value can reach; a frame much shorter than a
    block copies hardly any rows. On a dense row number this is a ROWS frame, on a dense rank a GROUPS
    frame. ``aggs`` are aggregate expressions such as ``F.sum("x")``.
    """
    cut = _Cut(df, keys, order, blocks, None)
    apart = F.when(F.col(BLOCK) >= NULL_BLOCKS, NULL_BLOCKS).otherwise(0)
    first, last = (block_of(F.col(order) + shift, cut.bounds) + apart for shift in (-ahead, back))
    spread = (cut.rows.withColumns({"_home": F.col(BLOCK), "_reach": F.sequence(first, last)}).drop(BLOCK)
              .withColumn(BLOCK, F.explode("_reach")).drop("_reach"))
    w = W.partitionBy(*cut.by).orderBy(order).rangeBetween(-back, ahead)
    out = spread.withColumns({n: c.over(w) for n, c in aggs.items()}).where(F.col(BLOCK) == F.col("_home"))
    return cut.unpack(out, *aggs)


#: How the totals of blocks are merged, and what an empty frame has.
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
SEGMENT = "_segment"
# Cells are numbered up to here, so that numbers of segments fit; farther values share the last one.
LAST_CELL = 1 << 60


def rolling_totals(df: DataFrame, keys: Sequence[str], order: str, aggs: Mapping[str, tuple[str, str]], back: float,
                   ahead: float = 0, blocks: int | None = None) -> DataFrame:
    """Like :func:`rolling`, for frames of any width: ``aggs`` maps a new name to (``sum``, ``count``, ``min`` or ``max``, column).

    Blocks are cut again into cells no wider than a frame, so that a frame is the rest of the segment in which it begins,
    whole segments, and the head of the segment in which it ends: running totals from either end of a segment, each row
    being added once. Rows go to the segment where their frame begins, and meet its values there; then to the one where it
    ends. Totals of the whole segments between are made once for every pair of segments, of which a key has a few per
    block. So every row is shuffled twice, and its values once with either, whatever the frame. Frames that begin and end
    in one segment (NULL, or values too far out for steps of a frame to be told apart) are made as RANGE frames there.
    """
    cut = _Cut(df, keys, order, blocks, None)
    span = back + ahead
    values = [F.col(c).alias(f"_v_{n}") for n, (_, c) in aggs.items()]
    key = [KEY] if keys else []
    by = [*key, SEGMENT]
    whole = isinstance(df.schema[order].dataType, T.IntegralType)

    def segment(c: Column) -> Column:
        """Block and cell both grow with the value, and so does their sum, which is new wherever one of them is; rows whose
        key is NULL have the odd numbers."""
        if whole:
            cell = F.call_function("div", c, F.lit(max(span, 1))) - F.when(c < 0, 1).otherwise(0)
        else:    # two cells a frame: what is lost in dividing must not bring its ends into one
            c = c.cast("double")
            cell = F.when(F.isnan(c), LAST_CELL).otherwise(F.floor(c / F.lit(span / 2 or 1.0)))
        cell = F.when(c.isNull(), -2 * LAST_CELL).otherwise(F.greatest(F.lit(-LAST_CELL), F.least(cell, F.lit(LAST_CELL))))
        return (block_of(c, cut.bounds) + cell) * 2 + F.when(F.col(BLOCK) >= NULL_BLOCKS, 1).otherwise(0)

    begins, ends = F.col(order) - F.lit(back), F.col(order) + F.lit(ahead)
    home = cut.rows.withColumns({"_first": segment(begins), "_last": segment(ends)})
    across, alone = home.where("_first < _last"), home.where("_first = _last")
    data = cut.rows.select(*key, segment(F.col(order)).alias(SEGMENT), F.col(order).alias("_pos"), *values).withColumn("_probe", F.lit(False))
    inside = [f"_v_{n}" for n in aggs]

    def over(window, suffix: str) -> dict[str, Column]:
        out = {}
        for n, (kind, _) in aggs.items():
            c = F.col(f"_v_{n}")
            out[f"{suffix}{n}"] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](c).over(window)
        return out

    def met(probes: DataFrame, at: str, pos: Column, *others: DataFrame) -> DataFrame:
        out = probes.withColumnRenamed(at, SEGMENT).withColumns({"_pos": pos, "_probe": F.lit(True)})
        for other in others:
            out = out.unionByName(other, allowMissingColumns=True)
        return out

    w = W.partitionBy(*by).orderBy("_pos")
    through = W.unboundedPreceding, W.currentRow
    # the frame's part in its first segment
    back_from_end = W.partitionBy(*by).orderBy(F.col("_pos").desc()).rangeBetween(*through)
    begun = met(across, "_first", begins, data).withColumns(over(back_from_end, "_a_")).where("_probe").drop("_pos", *inside).withColumnRenamed(SEGMENT, "_first")
    # whole segments between
    totals = data.groupBy(*by).agg(*[{"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in aggs.items()])
    pairs = home.where("_last > _first + 2").select(*key, "_first", "_last").distinct()
    listed = pairs.withColumn(SEGMENT, F.explode(F.sequence(F.col("_first") + 2, F.col("_last") - 2, F.lit(2).cast("bigint"))))
    middle = listed.join(totals, by).groupBy(*key, "_first", "_last").agg(*[MERGE[k](f"_t_{n}").alias(f"_m_{n}") for n, (k, _) in aggs.items()])
    # the frame's part in its last segment
    both = met(begun, "_last", ends, data, middle.withColumnRenamed("_last", SEGMENT).withColumn("_probe", F.lit(False)))
    told = {f"_m_{n}": F.first(f"_m_{n}", ignorenulls=True).over(W.partitionBy(*by, "_first").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            for n in aggs}
    ended = both.withColumns({**over(w.rangeBetween(*through), "_b_"), **told}).where("_probe")
    # frames in one segment
    near = data.join(alone.select(*key, F.col("_first").alias(SEGMENT)).distinct(), by, "left_semi")
    short = met(alone, "_first", begins, near).withColumns(over(w.rangeBetween(0, span), "_a_")).where("_probe").drop("_last", SEGMENT, "_pos", *inside)
    found = ended.drop("_first", SEGMENT, "_pos", *inside).unionByName(short, allowMissingColumns=True)
    result = {}
    for n, (kind, _) in aggs.items():
        parts = [F.col(f"_{part}_{n}") for part in "amb"]
        if kind in ("sum", "count"):
            some = F.coalesce(*parts)
            result[n] = F.when(some.isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))
        else:
            result[n] = {"min": F.least, "max": F.greatest}[kind](*parts)
    return cut.unpack(found.withColumns(result), *aggs)
