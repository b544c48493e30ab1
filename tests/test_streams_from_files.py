"""Log files as a stream through parsing, typing and both folds; row ids of parts, merges and late NULLs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gridweave import model
from gridweave.operators import reshape, runs, sequence
from gridweave.sources import logs, tables
from gridweave.streaming import runs as live


@pytest.fixture
def log_folder(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for n, name in enumerate(["r1", "r2", "night-7"]):
        events = [{"hb_event": "status", "state": "running", "t": 1.0}, {"hb_event": "progress", "collected": 1 + n, "total": 9, "message": "a"},
                  {"hb_event": "progress", "collected": 5 + n, "total": 9, "message": "b", "url": "u"}, {"hb_event": "result", "csv": "o.csv", "rows": n}]
        (folder / f"{name}.log").write_text("plain line\n" + "".join("\x1e" + json.dumps(e) + "\n" for e in events))
    return str(folder)


def test_stream_of_log_files_equals_the_batch(spark, tmp_path, log_folder):
    batch = runs.run_state(runs.merge_folds(runs.partial_fold(logs.normalize_run_events(logs.read_run_events(spark, log_folder)))))
    stream = logs.normalize_run_events(logs.read_run_events_stream(spark, log_folder, files_per_trigger=1))
    live.fold_runs_stream(stream, str(tmp_path / "folds"), str(tmp_path / "cp")).awaitTermination()
    facts = sorted(batch.collect(), key=lambda r: r.run_id)
    want = [tuple(r) for r in facts]
    assert [r.run_id for r in facts] == ["night-7", "r1", "r2"] and facts[0].total == 9
    assert sorted(map(tuple, live.read_run_state(spark, str(tmp_path / "folds")).collect())) == want
    out = live.live_run_state(logs.normalize_run_events(logs.read_run_events_stream(spark, log_folder)))
    rows: list = []
    query = (out.writeStream.outputMode("update").foreachBatch(lambda df, _: rows.extend(df.collect()))
             .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    query.awaitTermination()
    latest = {r.run_id: r for r in rows}    # a later update of a run replaces the earlier
    assert sorted((r.run_id, r.status, r.collected, r.rows) for r in latest.values()) == [(f.run_id, "running", f.collected, f.rows) for f in facts]


def streamed(spark, tmp_path, name, batches, schema):
    """A stream with one file a batch, in order."""
    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for part in folder.glob("part-*"):
            if part.stat().st_mtime > 1e9 + 1000:
                os.utime(part, (1e9 + i, 1e9 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


EVENTS = "run_id string, seq bigint, t double, hb_event string, state string, collected bigint, total bigint, message string, url string, csv string, rows bigint"
EXITS = "run_id string, t double, code int, canceled boolean, timed_out boolean, controlled boolean, has_output boolean, timeout bigint"


def timeline():
    def status(run, t):
        return (run, 1, t, "status", "running", 0, 0, "", "", "", 0)

    def progress(run, seq, t, n):
        return (run, seq, t, "progress", "", n, 9, "m", "u", "", 0)

    def result(run, seq, t):
        return (run, seq, t, "result", "", 0, 0, "", "", "o.csv", 3)
    first = [status("done", 1000.0), result("done", 3, 1030.0), status("stuck", 1000.0), progress("stuck", 2, 1005.0, 4), status("ended", 1000.0),
             status("late", 1001.0), status("handed", 1002.0)]
    second = [progress("stuck", 3, 1055.0, 6), result("late", 9, 1059.0), progress("other", 1, 1058.0, 1)]
    third = [status("new", 1500.0), progress("new", 2, 1501.0, 1), progress("done", 4, 1502.0, 7)]
    fourth = [status("newer", 1530.0)]
    exits = [[("ended", 1020.0, 0, False, False, False, True, 60)], [("handed", 1040.0, 1, False, False, True, False, 60)], [("new", 1503.0, 2, False, False, False, False, 60)]]
    return [first, second, third, fourth], exits


def latest_of(query_source, tmp_path, name):
    rows: list = []
    query = (query_source.writeStream.outputMode("update").foreachBatch(lambda df, _: rows.extend(df.collect()))
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination()
    return {r.run_id: r for r in rows}


def test_only_unfinished_runs_time_out(spark, tmp_path):
    batches, exits = timeline()
    out = live.live_run_state(streamed(spark, tmp_path, "ev", batches, EVENTS), timeout_ms=60_000, exits=streamed(spark, tmp_path, "ex", exits, EXITS), lateness="5 seconds")
    got = latest_of(out, tmp_path, "cp")
    events = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    ends = spark.createDataFrame([r for b in exits for r in b], EXITS)
    batch = {r.run_id: r for r in runs.fold_runs(events, ends.drop("t")).collect()}
    late = {r.run_id: r.error for r in runs.timed_out_runs(events, 60, ends, now=1525.0).collect()}
    assert set(late) == {"stuck", "other"}
    assert set(got) == set(batch)
    for run, r in got.items():
        b = batch[run]
        want = ("failed", late[run]) if run in late else (b.status, b.error)
        assert (r.status, r.error) == want, run
        assert (r.collected, r.total, r.message, r.last_url, r.csv, r["rows"], r.log_lines) == (b.collected, b.total, b.message, b.last_url, b.csv, b["rows"], b.log_lines), run
    assert got["done"].status == "running" and got["done"].csv == "o.csv" and got["ended"].status == "succeeded"
    assert got["handed"].status == "controlled" and got["new"].error == "workflow exited with code 2" and got["newer"].status == "running"


def test_a_replayed_backlog_ends_as_it_did(spark, tmp_path):
    """All of the log in one batch, long after it was written: no clock starts at now."""
    batches, exits = timeline()
    out = live.live_run_state(streamed(spark, tmp_path, "ev", [[r for b in batches for r in b]], EVENTS), timeout_ms=60_000,
                              exits=streamed(spark, tmp_path, "ex", [[r for b in exits for r in b]], EXITS), lateness="5 seconds", abandon_after_ms=10_000_000)
    got = latest_of(out, tmp_path, "cp")
    assert {k for k, r in got.items() if r.status == "failed"} == {"stuck", "other", "new"}


def test_abandoned_runs_are_dropped(spark, tmp_path):
    batches = [[("a", 1, 100.0, "progress", "", 1, 9, "m", "u", "", 0)], [("b", 1, 5000.0, "progress", "", 1, 9, "m", "u", "", 0)],
               [("b", 2, 5001.0, "progress", "", 2, 9, "m", "u", "", 0)], [("a", 2, 5002.0, "log", "", 0, 0, "again", "", "", 0)]]
    out = live.live_run_state(streamed(spark, tmp_path, "ev", batches, EVENTS), timeout_ms=10**9, abandon_after_ms=60_000, lateness="1 second")
    got = latest_of(out, tmp_path, "cp")
    assert got["a"].log_lines == 1 and got["a"].collected is None    # what was known of it is gone
    assert got["b"].collected == 2 and got["b"].log_lines == 2


def test_parts_keep_their_order_and_their_columns(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-0.csv").write_text("k,v\n1,a\n")
    (folder / "part-1.csv").write_text("k,v\n" + "".join(f"{i},{'b' * 50}\n" for i in range(2, 400)))
    (folder / "part-2.csv").write_text("k,v\n400,c\n")
    for quoted in (True, False):
        df = tables.read_csv(spark, str(folder), quoted_newlines=quoted)
        assert [(r["_rid"], r["k"]) for r in df.orderBy("_rid").collect()] == [(i, str(i)) for i in range(1, 401)]
    (folder / "part-3.csv").write_text("v,k\nd,401\n")
    with pytest.raises(ValueError, match="part begins"):
        tables.read_csv(spark, str(folder))


def test_nested_merges_keep_ids_apart(spark):
    a, b, c = (model.as_dataset(spark.createDataFrame([(1, f"{n}1"), (2, f"{n}2")], "_rid bigint, T string")) for n in "abc")
    rows = reshape.merge([reshape.merge([a, b]), c]).orderBy("_rid").collect()
    assert [r[1] for r in rows] == ["a1", "a2", "b1", "b2", "c1", "c2"] and len({r["_rid"] for r in rows}) == 6


@pytest.mark.parametrize("blocks", [8, 400])
def test_null_order_values_come_first(spark, blocks):
    df = spark.range(1000).select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 97).alias("v"), (F.col("id") % 3).alias("k"))
    got = sequence.rank_rows(df, ["k"], "v", blocks=blocks, ties=["id"]).select("id", "row_number", "rank")
    want = spark.sql("""SELECT id, row_number() OVER (PARTITION BY k ORDER BY v, id) AS row_number, rank() OVER (PARTITION BY k ORDER BY v) AS rank
                        FROM {df}""", df=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    before = sequence.neighbours(df, ["k"], "v", {"before": "id"}, blocks=blocks, ties=["id"]).select("id", "before")
    lag = spark.sql("SELECT id, lag(id) OVER (PARTITION BY k ORDER BY v, id) AS before FROM {df}", df=df)
    assert sorted(map(str, before.collect())) == sorted(map(str, lag.collect()))
    back = sequence.running(df.withColumn("o", F.col("v")), ["k"], "o", {"n": F.lit(1)}, reverse=True, blocks=blocks, ties=["id"]).select("id", "n")
    down = spark.sql("SELECT id, row_number() OVER (PARTITION BY k ORDER BY v DESC, id DESC) AS n FROM {df}", df=df)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, down.collect()))


def test_numbers_print_in_plain_digits(spark):
    from gridweave.functions.cells import number_to_text
    values = [15000000.25, 12345678.9, 0.0005, 1e15, 1.5e19, -2.5e-7, -3.25e22, 1.0, 0.1, 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(number_to_text(F.col("x"))).collect()]
    assert got[:4] == ["15000000.25", "12345678.9", "0.0005", "1000000000000000"]
    assert all(g is None if v is None else float(g) == v and "E" not in g for v, g in zip(values, got, strict=True))


def test_titles_resolve_all_references(spark):
    from gridweave.operators.pages import unescape_html
    text = "It&#8217;s &#x27;x&#x27; &#039;y&#039; &trade; &amp;lt; &nosuch; &#150; &#0; a & b &eacute;&#x1F600;"
    got = spark.createDataFrame([(text,)], "t string").select(unescape_html(F.col("t"))).first()[0]
    assert got == "It’s 'x' 'y' ™ &lt; &nosuch; – � a & b é😀"


def test_a_group_that_took_no_part_gives_the_whole_match(spark):
    from gridweave.operators import dom
    nodes = dom.dom_nodes(spark.createDataFrame([(1, "<div class=c>a</div><form><input type=password value=secret></form>")], "page_id bigint, html string"))
    assert dom.extract_records(nodes, ".c", {"x": "regex:a(b)?"}).first()["x"] == "a"
    assert "secret" not in dom.page_outline(dom.snapshot(nodes)).first()["outline"]


def test_reading_nothing_is_not_an_error_but_a_fault_is(spark, tmp_path):
    from gridweave.streaming.appends import read_appended
    schema = spark.range(1).schema
    assert read_appended(spark, str(tmp_path / "none"), schema).count() == 0
    os.makedirs(tmp_path / "bad")
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        read_appended(spark, str(tmp_path / "bad"), schema).count()
