"""Changing rows. Every operator returns new DataFrames; callers write them to a fresh place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..model import (RESCUED, RID, SPARK_TYPE, display_of, find_field, key_fields, logical_of, rescue_map,
                     sanitize_columns, tagged, user_fields)
from ..session import settle
from .sequence import number_rows


class Append(NamedTuple):
    rows: DataFrame      # the dataset after the append
    added: DataFrame     # only the new rows
    counts: DataFrame    # one row: inserted, skipped


def match_columns(base: DataFrame, incoming: DataFrame, extend: bool = False,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Incoming columns renamed and coerced to the base's columns, matched by display name in any case.

    Unknown columns are ignored, or join the schema as text when ``extend`` is set.
    """
    arriving = {}
    for f in user_fields(incoming):
        if f.name not in keep:
            arriving[display_of(f).strip().lower()] = f     # the last of two equal names wins
    out, rescue, used = [], [], set()
    for f in user_fields(base):
        key, logical = display_of(f).strip().lower(), logical_of(f)
        src = arriving.get(key)
        used.add(key)
        if src is None:
            value = F.lit(None).cast(f.dataType)
        else:
            c = F.col(f"`{src.name}`")
            value = cells.coerce_cell(c, src.dataType, logical).cast(f.dataType)
            if logical == "number" and isinstance(src.dataType, T.StringType):
                rescue.append((f.name, cells.rescue_number(c)))
        out.append(tagged(value, f.name, display_of(f), logical))
    if extend:
        new = [f for key, f in arriving.items() if key and key not in used]
        names = sanitize_columns([display_of(f) for f in new], [f.name for f in user_fields(base)])
        out += [tagged(cells.text_of(F.col(f"`{f.name}`"), f.dataType), n, display_of(f), "text")
                for f, n in zip(new, names)]
    if rescue:
        out.append(rescue_map(rescue).alias(RESCUED))
    return incoming.select(*[F.col(k) for k in keep], *out)


def append_key(df: DataFrame, fields: Sequence[T.StructField]) -> list[Column]:
    """Key parts as text in which NULL and the empty string are the same."""
    parts = []
    for f in fields:
        c = cells.text_of(F.col(f"`{f.name}`"), f.dataType)
        if RESCUED in df.columns:
            c = F.coalesce(c, F.try_element_at(F.col(RESCUED), F.lit(f.name)))
        parts.append(F.coalesce(c, F.lit("")))
    return parts


def append(base: DataFrame, incoming: DataFrame, keys: Sequence[str] | None = None, extend: bool = False,
           order: str = "_seq", renumber: bool = True) -> Append:
    """Append rows, skipping those whose key exists already or came earlier in the batch.

    ``order`` is the numeric column of ``incoming`` that says which row came first. The base's keys are
    reduced to distinct ones before they meet the batch on the same partitioning, so a key that fills
    the base costs one row.
    """
    batch = match_columns(base, incoming, extend, keep=[order])
    fields = key_fields(base, keys)
    if fields:
        names = [f"_k{i}" for i in range(len(fields))]
        have = base.select(*[c.alias(n) for c, n in zip(append_key(base, fields), names)]).distinct()
        keyed = batch.select("*", *[c.alias(n) for c, n in zip(append_key(batch, fields), names)])
        firsts = (keyed.groupBy(*names).agg(F.min_by(F.struct(*batch.columns), F.col(order)).alias("_row"))
                  .join(have, names, "left_anti"))
        fresh = firsts.select("_row.*")
        fresh = fresh.select(*[F.col(c).alias(c, metadata=batch.schema[c].metadata) for c in fresh.columns])
    else:
        fresh = batch
    if RID in base.columns and renumber:
        fresh = settle(fresh, "append")     # numbering reads the new rows more than once
        last = base.agg(F.coalesce(F.max(RID), F.lit(0)).alias("m")).scalar()
        fresh = number_rows(fresh, order, RID).withColumn(RID, F.col(RID) + last)
    counts = fresh.agg(F.count("*").alias("inserted")).withColumn(
        "skipped", incoming.select(F.count("*").alias("n")).scalar() - F.col("inserted"))
    added = fresh.drop(order)
    return Append(base.unionByName(added, allowMissingColumns=True), added, counts)


def insert_rows(base: DataFrame, incoming: DataFrame, order: str = "_seq") -> DataFrame:
    """Append without looking for duplicates."""
    return append(base, incoming, None, order=order).rows


def apply_cell_edits(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Set single cells: ``edits`` holds ``_rid``, ``column`` (display name), ``value`` (text) and ``seq``.

    The last edit of a cell wins; edits of unknown rows or columns change nothing; a NULL value blanks
    the cell.
    """
    fields = user_fields(base)
    names = {display_of(f): f for f in fields}
    last = edits.where(F.col("column").isin(list(names))).groupBy(RID).agg(
        *[F.max_by(F.struct(F.col("value").alias("v")), F.when(F.col("column") == d, F.col("seq"))).alias(f"_e{i}")
          for i, d in enumerate(names)])
    joined = base.join(last, RID, "left")
    out = []
    for i, (d, f) in enumerate(names.items()):
        new = cells.coerce_cell(F.col(f"_e{i}.v"), T.StringType(), logical_of(f)).cast(f.dataType)
        out.append(F.when(F.col(f"_e{i}").isNotNull(), new).otherwise(F.col(f"`{f.name}`"))
                   .alias(f.name, metadata=f.metadata))
    inner = [F.col(c) for c in base.columns if c not in {f.name for f in fields}]
    return joined.select(*inner, *out)


def delete_rows(base: DataFrame, rids: DataFrame) -> DataFrame:
    return base.join(rids.select(RID).distinct(), RID, "left_anti")


def dedup(df: DataFrame, keys: Sequence[str] | None = None, default_keys: Sequence[str] = (),
          order: str = RID) -> DataFrame:
    """Keep the first row of each key; NULL keys equal each other but not the empty string.

    Keys default to the dataset's own, else to all columns. Partial aggregation reduces every group
    before anything is shuffled, so a key with very many copies costs one row per input task.
    """
    wanted = list(keys or default_keys)
    fields = key_fields(df, wanted) if wanted else user_fields(df)
    if not fields:
        return df
    names = [f.name for f in fields]
    rest = [c for c in df.columns if c not in names and c != order]
    if not rest:
        best = df.groupBy(*names).agg(F.min(order).alias(order))
    else:
        best = df.groupBy(*names).agg(F.min(order).alias(order), F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    cols = [(F.col(f"_row.`{c}`") if c in rest else F.col(f"`{c}`")).alias(c, metadata=df.schema[c].metadata)
            for c in df.columns]
    return best.select(*cols)


def update_where(df: DataFrame, changes: Mapping[str, Column], condition: Column) -> DataFrame:
    """Set columns where the condition holds; every expression sees the old values."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, changes[c].cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`"))
                       .alias(c, metadata=df.schema[c].metadata) if c in changes else F.col(f"`{c}`")
                       for c in df.columns])


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows where the condition holds; an unknown condition keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def affected(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("rows_affected"))


def insert_select(target: DataFrame, query: DataFrame) -> DataFrame:
    """Rows of a query added to a dataset by column name, without dedup."""
    named = [F.col(f"`{c}`").cast(target.schema[c].dataType).alias(c) for c in query.columns if c in target.columns]
    return target.unionByName(query.select(*named), allowMissingColumns=True)


def attach_file(base: DataFrame, attach: DataFrame, column: str) -> DataFrame:
    """Put file ids into cells: ``attach`` holds ``_rid``, ``file_id`` and ``seq``.

    A file cell takes the last id; a file list gains each new id once, in the order given.
    """
    f = find_field(base, column)
    if f is None:
        raise ValueError(f"no column {column}")
    if logical_of(f) == "file_list":
        firsts = attach.groupBy(RID, "file_id").agg(F.min("seq").alias("seq"))
        per_row = firsts.groupBy(RID).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "file_id"))), lambda x: x["file_id"]).alias("_new"))
        cell = F.array_union(F.coalesce(F.col(f.name), F.array().cast(SPARK_TYPE["file_list"])), F.col("_new"))
        value = F.when(F.col("_new").isNull(), F.col(f.name)).otherwise(cell)
    else:
        per_row = attach.groupBy(RID).agg(F.max_by("file_id", "seq").alias("_new"))
        value = F.coalesce(F.col("_new"), F.col(f.name))
    return base.join(per_row, RID, "left").select(
        *[value.alias(c, metadata=f.metadata) if c == f.name else F.col(f"`{c}`") for c in base.columns])
