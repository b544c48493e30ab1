"""Reshaping datasets: project, merge, tidy extraction and query results as datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions.regexes import re_extract_all
from ..model import (RESCUED, RID, SPARK_TYPE, as_dataset, display_of, find_field, logical_of, sanitize_columns,
                     tagged, user_fields)
from .sequence import number_rows
from .writes import dedup

# Row ids of the n-th merged source start at n << 44, which keeps source order without any shuffle.
SOURCE_SHIFT = 44


def project(df: DataFrame, columns: Sequence[str | Mapping], dedup_keys: Sequence[str] = ()) -> DataFrame:
    """Selected columns under new display names, types carried over; unknown columns are ignored."""
    by_display = {display_of(f): f for f in user_fields(df)}
    picks = []
    for item in columns:
        source, target = (item, item) if isinstance(item, str) else (item.get("from"), item.get("to") or item.get("from"))
        if source in by_display:
            picks.append((by_display[source], target))
    if not picks:
        raise ValueError("none of the columns exists")
    names = sanitize_columns(target for _, target in picks)
    inner = [F.col(RID)] if RID in df.columns else []
    if RESCUED in df.columns:
        inner.append(_renamed_rescue({f.name: n for (f, _), n in zip(picks, names)}))
    out = df.select(*inner, *[tagged(F.col(f"`{f.name}`"), n, target, logical_of(f))
                              for (f, target), n in zip(picks, names)])
    return dedup(out, dedup_keys) if dedup_keys else out


def _renamed_rescue(names: Mapping[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kept = F.map_filter(F.col(RESCUED), lambda k, v: k.isin(list(names)))
    return F.transform_keys(kept, lambda k, v: F.element_at(lookup, k)).alias(RESCUED)


def merge(frames: Sequence[DataFrame], dedup_keys: Sequence[str] = ()) -> DataFrame:
    """Stack datasets. Columns meet by display name in any case; differing types become text.

    Earlier sources come first in row order, so with dedup keys they win. Each source needs ``_rid``; a source
    whose ids leave no room beside others (one that was merged itself) is numbered anew first.
    """
    frames = [df if (df.agg(F.max(RID)).first()[0] or 0) < 1 << SOURCE_SHIFT else number_rows(df, RID) for df in frames]
    plan: dict[str, list] = {}
    for df in frames:
        for f in user_fields(df):
            entry = plan.setdefault(display_of(f).strip().lower(), [display_of(f), logical_of(f)])
            if entry[1] != logical_of(f):
                entry[1] = "text"
    names = dict(zip(plan, sanitize_columns(display for display, _ in plan.values())))
    parts = []
    for i, df in enumerate(frames):
        fields = {display_of(f).strip().lower(): f for f in user_fields(df)}
        cols = [(F.col(RID) + F.lit(i << SOURCE_SHIFT)).cast("bigint").alias(RID)]
        moved = {f.name: names[k] for k, f in fields.items() if logical_of(f) == plan[k][1]}
        if any(RESCUED in d.columns for d in frames):
            cols.append(_renamed_rescue(moved) if RESCUED in df.columns and moved
                        else F.lit(None).cast("map<string,string>").alias(RESCUED))
        for key, (display, logical) in plan.items():
            f = fields.get(key)
            if f is None:
                c = F.lit(None).cast(SPARK_TYPE[logical])
            elif logical == "text" and logical_of(f) != "text":
                c = cells.text_of(F.col(f"`{f.name}`"), f.dataType)
                if RESCUED in df.columns:
                    c = F.coalesce(c, F.try_element_at(F.col(RESCUED), F.lit(f.name)))
            else:
                c = cells.coerce_cell(F.col(f"`{f.name}`"), f.dataType, logical)
            cols.append(tagged(c, names[key], display, logical))
        parts.append(df.select(*cols))
    out = reduce(DataFrame.unionByName, parts)
    return dedup(out, dedup_keys) if dedup_keys else out


def query(spark: SparkSession, datasets: Mapping[str, DataFrame], sql: str,
          max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a SELECT over named datasets: the rows, and a one-row DataFrame telling whether any were cut.

    The datasets are bound to the statement by name (``{name}`` in the text), so nothing is registered
    in the session.
    """
    result = spark.sql(sql, **datasets)
    if max_rows is None:
        return result, result.agg(F.count("*").alias("row_count")).withColumn("truncated", F.lit(False))
    probe = result.limit(max_rows + 1).agg(F.count("*").alias("n"))
    return result.limit(max_rows), probe.select(F.least("n", F.lit(max_rows)).alias("row_count"),
                                                (F.col("n") > max_rows).alias("truncated"))


def query_to_dataset(spark: SparkSession, datasets: Mapping[str, DataFrame], sql: str,
                     dedup_keys: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """A SELECT's result as a typed dataset: numeric columns become numbers, everything else text."""
    result = spark.sql(sql, **datasets)
    order_col = F.col(order).cast("bigint") if order else F.monotonically_increasing_id()
    specs = [{"display": f.name, "type": "number" if isinstance(f.dataType, T.NumericType) else "text"}
             for f in result.schema.fields]
    out = as_dataset(result.withColumn(RID, order_col), specs)
    return dedup(out, dedup_keys) if dedup_keys else out


def extract_to_tidy(sources: Sequence[tuple[DataFrame, str]], pattern: str, name: str, group: int = 0) -> DataFrame:
    """Every distinct match of a pattern over columns of several tables, as one tidy column."""
    parts = [df.select(F.explode(re_extract_all(F.col(f"`{c}`"), pattern, group)).alias(name)) for df, c in sources]
    return reduce(DataFrame.union, [p.distinct() for p in parts]).distinct()


def unique_preserve_order(c: Column) -> Column:
    return F.array_distinct(c)
