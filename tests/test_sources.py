"""CSV, JSON, run logs and files with awkward content."""

import json
import os

from conftest import DATA
from pyspark.sql import functions as F

from gridweave import model
from gridweave.operators.writes import append
from gridweave.sources import logs, tables


def test_csv_quirks(spark):
    df = tables.read_csv(spark, os.path.join(DATA, "quirks.csv"))
    assert [s["display"] for s in model.specs_of(df)] == ["Name", "Score", "Name", "Note"]
    assert [s["name"] for s in model.specs_of(df)] == ["name", "score", "name_2", "note"]
    rows = [r.asDict() for r in df.orderBy("_rid").collect()]
    assert rows[0]["name"] == "Ann" and rows[0]["name_2"] == "Ann B" and rows[0]["note"] == 'says "hi"'
    assert rows[1]["note"] == "two\nlines"
    assert rows[2]["name"] == "Short" and rows[2]["note"] is None and rows[2]["_corrupt_record"] is not None
    assert rows[3]["name"] == "Long" and "extra" in rows[3]["_corrupt_record"]
    assert rows[4]["name"].startswith("Bad") and len(rows) == 5


def test_csv_contract(spark):
    df = tables.read_csv(spark, os.path.join(DATA, "contract.csv"), [
        {"name": "Score", "type": "number"}, {"name": "Active", "type": "bool"}, {"name": "Missing", "type": "image"}])
    assert {s["display"]: s["type"] for s in model.specs_of(df)} == {
        "NAME": "text", "SCORE": "number", "active": "boolean", "Missing": "file"}
    rows = df.orderBy("_rid").collect()
    assert [r["score"] for r in rows] == [1234.5, None] and [r["active"] for r in rows] == [True, False]
    assert rows[1]["_rescued"] == {"score": "n/a"}


def test_rows_json(spark):
    text = open(os.path.join(DATA, "rows.json")).read()
    good, bad = tables.read_rows_json(spark.createDataFrame([(1, text), (2, "oops"), (3, "")], "id bigint, p string"), "p",
                                      ["Name", {"name": "Rank", "type": "number"}, "Tags"])
    rows = good.orderBy("_rid").collect()
    assert [(r["name"], r["rank"]) for r in rows] == [("Acme", 1.0), ("Beta", None)]
    assert json.loads(rows[1]["tags"]) == ["x", {"y": 1}]
    assert sorted((r["id"], r["index"], r["reason"]) for r in bad.collect()) == [
        (1, 1, "not an object"), (1, 2, "not an object"), (2, -1, "not an array")]


def test_run_log(spark):
    parsed = logs.read_run_events(spark, os.path.join(DATA, "run.log"))
    assert {r["part"]: r["count"] for r in parsed.groupBy("part").count().collect()} == {"event": 5, "log": 2, "reject": 1}
    typed = {r["hb_event"]: r for r in logs.normalize_run_events(parsed).collect()}
    assert typed["progress"]["collected"] == 3 and typed["progress"]["total"] == 0 and typed["progress"]["page"] == 2
    assert typed["result"]["rows"] == 7 and typed["status"]["message"] == "" and typed["error"]["run_id"] == "run"


def test_export_and_import_again(spark, tmp_path):
    df = model.as_dataset(spark.createDataFrame([(1, 'a "b", c', 2.0, None), (2, "line\nbreak", None, ["x", "y"])],
                                                "_rid bigint, T string, N double, L array<string>"))
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), [{"name": "N", "type": "number"}, {"name": "L", "type": "files"}])
    rows = back.orderBy("_rid").collect()
    assert [(r["t"], r["n"], r["l"]) for r in rows] == [('a "b", c', 2.0, None), ("line\nbreak", None, ["x", "y"])]


def test_append_twice_is_append_once(spark):
    base = model.as_dataset(spark.createDataFrame([(1, "a", 1.0)], "_rid bigint, Name string, N double"))
    more = spark.createDataFrame([(1, "a", "5"), (2, "b", "1,5"), (3, "b", "7"), (4, None, "x"), (5, "", "8")],
                                 "_seq bigint, NAME string, n string")
    once = append(base, more, ["Name"]).rows
    twice = append(once, more, ["Name"])
    assert [(r["name"], r["n"], r["_rid"]) for r in once.orderBy("_rid").collect()] == [("a", 1.0, 1), ("b", 15.0, 2), (None, None, 3)]
    assert twice.counts.first().asDict() == {"inserted": 0, "skipped": 5}
    assert twice.rows.count() == 3
    extended = append(base, more.withColumn("Extra", F.lit("e")), ["Name"], extend=True).rows
    assert "extra" in extended.columns and extended.where("extra = 'e'").count() == 2


def test_dataset_table_keeps_metadata(spark, tmp_path):
    df = model.as_dataset(spark.createDataFrame([(1, "x")], "_rid bigint, v string"), [{"name": "My File!", "type": "image"}])
    df.write.parquet(str(tmp_path / "t"))
    assert model.specs_of(spark.read.parquet(str(tmp_path / "t"))) == [{"name": "my_file", "display": "My File!", "type": "file"}]


def test_sanitize():
    assert model.sanitize_columns(["Name", "name", "name 2", "", "9 lives", "rowid", "Na me", "name"]) == [
        "name", "name_2", "name_2_2", "col", "c_9_lives", "rowid_2", "na_me", "name_3"]
    assert [model.normalize_type(t) for t in ("Integer", "IMG", None, "odd", "files ")] == ["number", "file", "text", "text", "file_list"]
