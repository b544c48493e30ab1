"""Reading rows: search, sort, page and newest-per-group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..model import RESCUED, RID, display_of, find_field, user_fields
from .sequence import keep_newest

#: Rows of a result preview where no number is given.
PREVIEW_ROWS = 5000


def contains_text(c: Column, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))


def search_condition(df: DataFrame, term: str, columns: list[str] | None = None) -> Column:
    """True when any single user column contains the term, ignoring case."""
    fields = [f for f in user_fields(df) if columns is None or f.name in columns]
    tests = []
    for f in fields:
        text = cells.text_of(F.col(f"`{f.name}`"), f.dataType)
        if RESCUED in df.columns and isinstance(f.dataType, T.DoubleType):
            text = F.coalesce(text, F.try_element_at(F.col(RESCUED), F.lit(f.name)))
        tests.append(contains_text(text, term))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def search(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    return df.where(search_condition(df, term, columns)) if term else df


def result_filter(df: DataFrame, needle: str) -> DataFrame:
    """Free-text filter over the text columns of a result."""
    if not needle.strip():
        return df
    return search(df, needle, [f.name for f in user_fields(df) if isinstance(f.dataType, T.StringType)])


def sort_order(df: DataFrame, column: str | None, direction: str = "asc", tie: str = RID) -> list[Column]:
    f = find_field(df, column) if column else None
    if f is None:
        return [F.col(tie).asc()]
    c = F.col(f"`{f.name}`")
    parts = [c]
    if RESCUED in df.columns and isinstance(f.dataType, T.DoubleType):
        # numbers come before cells that kept their text, and blanks before both
        kept = F.try_element_at(F.col(RESCUED), F.lit(f.name))
        parts = [F.when(c.isNotNull(), 1).when(kept.isNotNull(), 2).otherwise(0), c, kept]
    down = direction.lower() == "desc"
    return [p.desc_nulls_last() if down else p.asc_nulls_first() for p in parts] + [F.col(tie).asc()]


def sort_rows(df: DataFrame, column: str | None, direction: str = "asc", tie: str = RID) -> DataFrame:
    """Sort by a display or physical column name; an unknown name sorts by row id."""
    return df.orderBy(*sort_order(df, column, direction, tie))


def mixed_sort(df: DataFrame, column: str, direction: str = "asc", tie: str = RID) -> DataFrame:
    """Sort text cells with numbers first by value and other text after them, as one total order."""
    c = F.coalesce(F.col(column), F.lit(""))
    number = cells.coerce_number(c)
    parts = [number.isNull(), number, c]
    return df.orderBy(*[p.desc() if direction == "desc" else p.asc() for p in parts], F.col(tie).asc())


def page(df: DataFrame, limit: int = 200, offset: int = 0, column: str | None = None, direction: str = "asc",
         tie: str = RID) -> DataFrame:
    """One page of ``limit`` rows. Shallow pages only; walk deep ones with :func:`page_after`."""
    limit, offset = max(1, limit), max(0, offset)
    return sort_rows(df, column, direction, tie).offset(offset).limit(limit)


def page_after(df: DataFrame, last_rid: int, limit: int = 200, tie: str = RID) -> DataFrame:
    """The page following a known row id: a pushed-down filter, so cost does not grow with depth."""
    return df.where(F.col(tie) > last_rid).orderBy(tie).limit(max(1, limit))


def page_with_total(df: DataFrame, term: str = "", **paging) -> DataFrame:
    """A page of the matching rows, each carrying how many rows matched in all."""
    hits = search(df, term)
    total = hits.select(F.count("*").alias("total")).scalar()
    return page(hits, **paging).withColumn("total", total)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, keys: list[str], order: str, n: int, ties: list[str] = ()) -> DataFrame:
    """The newest ``n`` rows of each group."""
    return keep_newest(df, keys, order, n, ties=ties)


def result_preview(df: DataFrame, n: int = PREVIEW_ROWS, tie: str = RID) -> tuple[DataFrame, DataFrame]:
    """The first rows of a result, and a one-row DataFrame with its columns and full row count."""
    names = ",".join(display_of(f) for f in user_fields(df))
    return df.orderBy(tie).limit(n), df.agg(F.count("*").alias("row_count")).withColumn("columns", F.lit(names))
