"""Workflows: named DataFrame transforms with typed parameters and column contracts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import looks_like_id
from ..model import SPARK_TYPE, add_column, coerce, column_specs, find_field, sanitize_columns
from ..operators.reshape import project
from ..operators.runs import DEFAULT_TIMEOUT, TIMEOUT_RANGE

Transform = Callable[[SparkSession, Mapping[str, Any], DataFrame | None], DataFrame]


@dataclass(frozen=True)
class Param:
    name: str
    label: str = ""
    type: str = "string"
    required: bool = False
    default: Any = None


@dataclass(frozen=True)
class Workflow:
    id: str
    transform: Transform
    params: tuple[Param, ...] = ()
    input_contract: tuple = ()
    output_contract: tuple = ()
    timeout_sec: int = DEFAULT_TIMEOUT
    builtin: bool = False


def normalize_params(params: Sequence[Mapping[str, Any]] | None) -> tuple[Param, ...]:
    """Parameter definitions: a name is enough; nameless ones are dropped."""
    known = Param.__dataclass_fields__
    named = [p for p in params or [] if isinstance(p, Mapping) and str(p.get("name") or "").strip()]
    return tuple(Param(**{"label": p["name"], **{k: v for k, v in p.items() if k in known}}) for p in named)


def missing(params: Sequence[Param], values: Mapping[str, Any]) -> list[str]:
    return [p.label or p.name for p in params if p.required and not values.get(p.name)]


@dataclass
class Registry:
    """Workflows by id. A built-in is never overwritten: saving under its id makes a copy beside it."""

    workflows: dict[str, Workflow] = field(default_factory=dict)

    def add(self, wf: Workflow) -> Workflow:
        old = self.workflows.get(wf.id)
        if old is not None and old.builtin and not wf.builtin:
            wf = replace(wf, id=f"{wf.id}-user")
        low, high = TIMEOUT_RANGE
        wf = replace(wf, timeout_sec=max(low, min(high, int(wf.timeout_sec))))
        self.workflows[wf.id] = wf
        return wf

    def workflow(self, id: str, params: Sequence[Mapping[str, Any]] = (), input: Sequence = (), output: Sequence = (),
                 **options) -> Callable[[Transform], Workflow]:
        """Decorator that registers ``fn(spark, params, input) -> DataFrame``."""
        def register(fn: Transform) -> Workflow:
            return self.add(Workflow(id, fn, normalize_params(params), tuple(input), tuple(output), **options))
        return register

    def run(self, spark: SparkSession, id: str, values: Mapping[str, Any] | None = None,
            rows: DataFrame | None = None) -> DataFrame:
        """The lazy result of a workflow, its input and output brought to the contracts."""
        wf = self.workflows[id]
        given = {p.name: p.default for p in wf.params if p.default is not None} | dict(values or {})
        lacking = missing(wf.params, given)
        if lacking:
            raise ValueError(f"missing required parameter: {', '.join(lacking)}")
        if wf.input_contract:
            if rows is None:
                raise ValueError(f"{id} needs input rows")
            rows = conform(rows, wf.input_contract)
        out = wf.transform(spark, given, rows)
        return conform(out, wf.output_contract) if wf.output_contract else out

    def chain(self, spark: SparkSession, steps: Sequence[tuple], rows: DataFrame | None = None) -> DataFrame:
        """Run workflows one after the other as one plan.

        A step is ``(workflow id, params)`` or ``("project", columns)``; nothing is stored in between.
        """
        for name, arg in steps:
            rows = project(rows, arg) if name == "project" else self.run(spark, name, arg, rows)
        return rows


def conform(df: DataFrame, contract: Sequence) -> DataFrame:
    """Contract columns coerced to their types and missing ones added; further columns stay."""
    out = coerce(df, contract)
    for c in column_specs(list(contract)):
        if find_field(out, c["display"]) is None:
            out = add_column(out, c["display"], c["type"])
    return out


def check_params(runs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Table form: parameters given to runs, judged one by one.

    ``runs`` has ``run_id, workflow, args`` (JSON object text); ``definitions`` has ``workflow, name,
    type, required``. Every defined parameter and every unknown argument gives one row with its value
    and a state: ok, blank, missing, unknown or unreadable (a list parameter whose text is no JSON).
    """
    args = runs.withColumn("_m", F.coalesce(F.from_json("args", "map<string,string>"), F.create_map().cast("map<string,string>")))
    defs = definitions.select(F.col("workflow").alias("_w"), "name", "type", "required")
    known = args.join(defs, F.col("workflow") == F.col("_w")).select(
        "run_id", "workflow", "name", "type", "required", F.try_element_at("_m", F.col("name")).alias("value"))
    extra = args.select("run_id", "workflow", F.explode("_m").alias("name", "value")).join(
        defs.select(F.col("_w").alias("workflow"), "name"), ["workflow", "name"], "left_anti").select(
        "run_id", "workflow", "name", F.lit(None).cast("string").alias("type"), F.lit(False).alias("required"), "value")
    blank = F.coalesce("value", F.lit("")) == ""
    list_ok = F.from_json("value", "array<string>").isNotNull() | looks_like_id(F.col("value"))
    state = (F.when(F.col("type").isNull(), "unknown").when(blank & F.col("required"), "missing").when(blank, "blank")
             .when((F.col("type") == "file_list") & ~list_ok, "unreadable")
             .when((F.col("type") == "number") & F.col("value").try_cast("double").isNull(), "unreadable").otherwise("ok"))
    return known.unionByName(extra).withColumn("state", state)


def map_rows(df: DataFrame, fn: Callable[[dict], dict | None], output: Sequence, keep: Sequence[str] = ()) -> DataFrame:
    """Run a plain Python function on every row and collect its results under an output contract.

    The hook for logic no expression can state; it runs on Arrow batches. A row that raises is not lost:
    it comes back with status ``error`` and the message, others with ``ok``; None means ``empty``.
    """
    specs = column_specs(list(output))
    kept = [df.schema[c] for c in keep]
    names = sanitize_columns(["status", "detail"], [s["name"] for s in specs] + list(keep))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept]
                          + [T.StructField(s["name"], SPARK_TYPE[s["type"]], True, {"display": s["display"], "logical": s["type"]}) for s in specs]
                          + [T.StructField(n, T.StringType()) for n in names])
    makers = {"number": float, "boolean": bool, "file_list": list}

    def one(row: dict) -> list:
        try:
            result, status, detail = fn(row), "ok", ""
            if result is None:
                result, status = {}, "empty"
            values = [result.get(s["display"], result.get(s["name"])) for s in specs]
            values = [None if v is None else makers.get(s["type"], str)(v) for v, s in zip(values, specs)]
        except Exception as e:  # one bad row never fails the job
            values, status, detail = [None] * len(specs), "error", str(e)
        return [*[row[c] for c in keep], *values, status, detail]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(r) for r in batch.to_dict("records")], columns=schema.names)

    return df.mapInPandas(run, schema)
