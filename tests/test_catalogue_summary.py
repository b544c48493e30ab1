"""Saved datasets as the catalogue tells of them; long schedules; more media types."""

import uuid

from pyspark.sql import functions as F

from gridweave import model
from gridweave.operators import catalogue, runs


def test_the_last_updated_comes_first(spark):
    name = "t12_" + uuid.uuid4().hex[:8]
    one = model.as_dataset(spark.createDataFrame([(1, "a", 2.0)], "_rid bigint, Name string, Score double"))
    two = model.as_dataset(spark.createDataFrame([(i, "x") for i in range(3)], "_rid bigint, Name string"))
    try:
        model.save_dataset(one, f"{name}_one", ["Name"], {"kind": "it's"}, name="Peo'ple", dataset_id="d1", at=100.0)
        model.save_dataset(two, f"{name}_two", name="Others", at=200.0)
        spark.range(3).write.saveAsTable(f"{name}_plain")
        rows = model.catalogue_summary(spark, [f"{name}_plain", f"{name}_one", f"{name}_two"]).collect()
        assert [(r.name, r.row_count, r.dedup_keys) for r in rows] == [("Others", 3, []), ("Peo'ple", 1, ["Name"])]
        assert rows[1].id == "d1" and rows[1].table == f"{name}_one" and [tuple(c) for c in rows[1].columns] == [("name", "Name", "text"), ("score", "Score", "number")]
        model.touch_dataset(spark, f"{name}_one", 300.0)
        assert [r.table for r in model.catalogue_summary(spark).collect() if r.table.startswith(name)] == [f"{name}_one", f"{name}_two"]
        back, keys, source = model.load_dataset(spark, f"{name}_one")
        assert keys == ["Name"] and source == {"kind": "it's"} and back.count() == 1
    finally:
        for t in ("one", "two", "plain"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")


def test_a_definition_that_fires_very_often_is_spread(spark):
    defs = spark.createDataFrame([(1, 0.0, 1.0), (2, 10.0, 0.0), (3, 5.0, 1e9), (4, 1e9, 1.0)], "id int, start_at double, every_seconds double")
    out = runs.expand_schedule(defs, 200_000.0, at_once=1000)
    assert {r.id: (r.n, r.last) for r in out.groupBy("id").agg(F.count("*").alias("n"), F.max("fire_at").alias("last")).collect()} == {
        1: (200_001, 200_000.0), 2: (1, 10.0), 3: (1, 5.0)}
    parts = [r.n for r in out.where("id = 1").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(parts) < 80_000


def test_types_by_the_registry(spark):
    names = ["a.avi", "b.webm", "c.tar", "d.py", "e.js", "f.css", "g.rtf", "h.nosuch", "i.MD", "j.mkv"]
    df = spark.createDataFrame([(n, b"\xff\x00\xfe\x01" * 30) for n in names], "name string, content binary")
    got = {r.name: r.t.mime for r in df.select("name", catalogue.sniff(F.col("content"), F.col("name")).alias("t")).collect()}
    assert got["a.avi"] == "video/x-msvideo" and got["b.webm"] == "video/webm" and got["c.tar"] == "application/x-tar"
    assert got["g.rtf"] in ("text/rtf", "application/rtf") and got["h.nosuch"] == "application/octet-stream" and got["i.MD"] == "text/markdown"
