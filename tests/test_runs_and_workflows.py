"""Run state, streams in odd order, workflows and their contracts."""

import pytest
from pyspark.sql import functions as F

from gridweave import model
from gridweave.operators import runs
from gridweave.plans import workflows as wf
from gridweave.streaming.appends import append_stream, read_appended

EVENT = "run_id bigint, seq bigint, hb_event string, state string, collected bigint, total bigint, message string, url string, csv string, rows bigint"


def test_fold_precedence(spark):
    ev = [(r, 1, "status", "running", 0, 0, "", "", "", 0) for r in range(1, 8)]
    ev += [(1, 3, "progress", "", 5, 9, "late", "", "", 0), (1, 2, "progress", "", 1, 9, "early", "u1", "", 0), (2, 2, "error", "", 0, 0, "boom", "u2", "", 0)]
    exits = [(1, 0, False, False, False, True, 60), (2, 0, False, False, False, False, 60), (3, 0, True, True, False, True, 60), (4, 1, False, True, False, False, 60),
             (5, 0, False, False, True, True, 60), (6, 3, False, False, False, True, 60)]
    got = {r["run_id"]: r for r in runs.fold_runs(spark.createDataFrame(ev, EVENT), spark.createDataFrame(
        exits, "run_id bigint, code int, canceled boolean, timed_out boolean, controlled boolean, has_output boolean, timeout int")).collect()}
    assert {k: (r["status"], r["error"]) for k, r in got.items()} == {
        1: ("succeeded", None), 2: ("failed", "boom"), 3: ("canceled", None), 4: ("failed", "workflow timed out after 60s"), 5: ("controlled", None),
        6: ("failed", "workflow exited with code 3"), 7: ("running", None)}
    assert (got[1]["message"], got[1]["last_url"], got[1]["log_lines"]) == ("late", "u1", 2)


def test_partial_folds_merge_in_any_order(spark):
    ev = spark.createDataFrame([(s % 3, s, ["progress", "log", "result", "error", "status"][s % 5], "running" if s % 2 else "", s, 100, f"m{s}", f"u{s}" if s % 4 else "", f"c{s}", s)
                                for s in range(60)], EVENT)
    whole = sorted(map(str, runs.fold_runs(ev).collect()))
    parts = [runs.partial_fold(ev.where(F.col("seq") % 4 == k)) for k in (2, 0, 3, 1)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert sorted(map(str, runs.run_state(runs.merge_folds(merged)).collect())) == whole


def test_schedules(spark):
    df = spark.createDataFrame([(0.0, 10.0), (5.0, 0.0), (25.0, 10.0)], "start_at double, every_seconds double")
    assert sorted(r["fire_at"] for r in runs.expand_schedule(df, 30.0).collect()) == [0.0, 5.0, 10.0, 20.0, 25.0, 30.0]
    assert sorted((r["start_at"], r["next_at"]) for r in runs.due(df, 10.0).collect()) == [(0.0, 20.0), (5.0, None)]
    plan = spark.createDataFrame([(100.5, None), (200.0, None), (None, 50.0), (None, None)], "start_at double, in_seconds double")
    assert [(r["status"], r["start_at"]) for r in runs.resolve_start(plan, F.lit(100.0)).collect()] == [
        ("queued", None), ("scheduled", 200.0), ("scheduled", 150.0), ("queued", None)]


def test_append_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    data = spark.createDataFrame([(i, f"n{i % 7}", float(i)) for i in range(40)], "_seq bigint, Name string, V double")
    ds = model.as_dataset(data.select("Name", "V"))
    data.repartition(5).write.parquet(str(tmp_path / "in"))
    def run():
        stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), ds.schema, ["Name"]).awaitTermination()
        return sorted(r["name"] for r in read_appended(spark, str(tmp_path / "out"), ds.schema).collect())
    assert run() == [f"n{i}" for i in range(7)] == run()


def test_workflow_registry(spark):
    reg = wf.Registry()

    @reg.workflow("double", params=[{"name": "factor", "label": "Factor", "required": True}, {"label": "nameless"}], input=[{"name": "N", "type": "number"}],
                  output=[{"name": "Result", "type": "number"}, "Note"], builtin=True, timeout_sec=1)
    def double(spark, params, rows):
        return rows.select((F.col("n") * params["factor"]).cast("string").alias("result"))

    assert double.timeout_sec == 30 and [p.name for p in double.params] == ["factor"]
    rows = spark.createDataFrame([("1,000",), ("x",)], "N string")
    out = reg.run(spark, "double", {"factor": 2}, rows)
    assert [(s["display"], s["type"]) for s in model.specs_of(out)] == [("result", "number"), ("Note", "text")]
    assert [r["result"] for r in out.collect()] == [2000.0, None]
    with pytest.raises(ValueError, match="Factor"):
        reg.run(spark, "double", {}, rows)
    copy = reg.add(wf.Workflow("double", lambda *a: None))
    assert copy.id == "double-user" and reg.workflows["double"].builtin
    twice = reg.chain(spark, [("double", {"factor": 2}), ("project", [{"from": "result", "to": "N"}]), ("double", {"factor": 3})], rows)
    assert [r["result"] for r in twice.collect()] == [6000.0, None]


def test_bad_rows_do_not_fail_the_job(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "i int")
    out = wf.map_rows(df, lambda r: {"half": 1 / r["i"]} if r["i"] != 3 else None, [{"name": "half", "type": "number"}], keep=["i"])
    assert [(r["i"], r["half"], r["status"]) for r in out.orderBy("i").collect()] == [(0, None, "error"), (1, 1.0, "ok"), (2, 0.5, "ok"), (3, None, "empty")]


def test_plans_stay_in_the_engine(spark):
    """No row-at-a-time Python anywhere, and Arrow stages only where stated."""
    import __spark_entry__ as entry
    from conftest import SF
    arrow = {"x05", "x06", "x07", "x08", "x09", "f14", "a05", "u05"}
    skip = {"s01", "s02", "s03", "s05", "s08", "s09", "w10", "e03", "e11", "a03", "a14"}   # these write files first
    for name, fn in entry.queries().items():
        if name[:3] in skip:
            continue
        plan = fn(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "BatchEvalPython" not in plan and "PythonUDF" not in plan.replace("ArrowEvalPython", "") or name[:3] in arrow, name
        if name[:3] not in arrow:
            assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "Join Cross" not in plan, name
