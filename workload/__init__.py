"""The registered queries: each runs a library operator over whole tables, most with an SQL counterpart.

Derived tables are written once as SQL that both engines read, see :mod:`workload.derived`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.session import settle

from .derived import DERIVED

Query = Callable[[SparkSession, str], DataFrame]

PARTS = ["datasets", "functions", "sqlsurface", "files", "runs", "campaigns", "pages", "agents", "workflows"]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# How the two engines spell what is not common to both.
SPARK_WORDS = [
    (r"SPREAD\[(.*?)\]", r"explode(sequence(0, CAST(\1 AS INT) - 1))"),
    (r"SHA\[(.*?)\]", r"sha2(\1, 256)"),
    (r"EPOCH\(([^()]*)\)", r"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1) / 1e6)"),
]
SQL_WORDS = [
    (r"SPREAD\[(.*?)\]", r"unnest(range(0, CAST(\1 AS INT)))"),
    (r"SHA\[(.*?)\]", r"sha256(\1)"),
    (r"EPOCH\(([^()]*)\)", r"(epoch_us(\1) / 1e6)"),
]


def _spell(sql: str, words: list[tuple[str, str]]) -> str:
    for pattern, text in words:
        sql = re.sub(pattern, text, sql)
    return sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame."""
    sql = DERIVED[name]
    used = {n: derived(spark, sf, n) if n in DERIVED else table(spark, sf, n) for n in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(_spell(sql, SPARK_WORDS), **used)


def _ctes(names: list[str], done: dict[str, str]) -> dict[str, str]:
    for name in names:
        if name in DERIVED and name not in done:
            _ctes(re.findall(r"\{(\w+)\}", DERIVED[name]), done)
            done[name] = _spell(re.sub(r"\{(\w+)\}", r"\1", DERIVED[name]), SQL_WORDS)
    return done


def oracle(sql: str, uses: tuple[str, ...] = ()) -> str:
    """SQL text with the derived tables it uses as common table expressions."""
    sql = _spell(sql.strip(), SQL_WORDS)
    ctes = ",\n".join(f"{n} AS ({body})" for n, body in _ctes(list(uses), {}).items())
    if not ctes:
        return sql
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, uses)
        return fn
    return add


def place_of(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Numbers the rows of a sorted table from 1 in their order, partition after partition."""
    at = ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    at = settle(at, "places")    # the rows of a partition must not move between counting and numbering
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)    # one row per partition
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return at.join(starts, "_part").withColumn(name, F.col("_row") - F.col("_first") + F.col("_before") + 1).drop(
        "_part", "_row", "_first", "_before")


def load_all() -> None:
    import importlib
    for part in PARTS:
        importlib.import_module(f"workload.{part}")
