"""Quoted CSV in many splits against Python's reader and the one-task read."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gridweave.sources import records, tables


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def some_rows(rnd, n):
    cells = ["a", "", "x,y", 'say "hi"', "two\nlines", "\n\n", '"', "é 中", " space", "long " * 40, 'q",\n"', "\n,\n" * 30, "plain text"]
    return [[f"{i}", rnd.choice(cells), rnd.choice(cells)] for i in range(n)]


def text_of(rows, newline, rnd=None):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    for row in rows:
        writer.writerow(row)
        if rnd and rnd.random() < 0.1:
            out.write(newline)    # blank lines between rows
    return out.getvalue()


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_split_files_equal_the_python_reader(small_splits, tmp_path, newline):
    rnd = random.Random(3)
    want = []
    for part in range(3):
        rows = some_rows(rnd, 120)
        want += rows
        text = text_of([["id", "one", "two"], *rows], newline, rnd)
        (tmp_path / f"part-{part}.csv").write_bytes((b"\xef\xbb\xbf" if part == 1 else b"") + text.encode())
    df = tables.read_csv(small_splits, str(tmp_path))
    got = df.orderBy("_rid").collect()
    assert records.lines_of(small_splits, str(tmp_path)).rdd.getNumPartitions() > 20
    assert [r["_rid"] for r in got] == list(range(1, len(want) + 1))
    assert [[r["id"], r["one"] or "", r["two"] or ""] for r in got] == [[c.replace("\r\n", "\n") for c in row] for row in want]
    assert all(r["_corrupt_record"] is None for r in got)


def test_equal_to_the_read_in_one_task(small_splits, tmp_path):
    """Also where quotes stand in odd places."""
    rnd = random.Random(9)
    lines = ["k,v,w"] + [rnd.choice(['1,5" pipe,x', '2,"a"b,c', '3,"open\nline",z', '4, "spaced,quote"', '5,a', '6,a,b,c', '7,"x""y",""', '"8","\n\n","q"', ",,", "9,\"\"\"\",e"])
                             for _ in range(300)]
    path = str(tmp_path / "odd.csv")
    (tmp_path / "odd.csv").write_text("\n".join(lines) + "\n")
    split = [tuple(r) for r in tables.read_csv(small_splits, path).select("_rid", "k", "v", "w").orderBy("_rid").collect()]
    whole = small_splits.read.schema("k string, v string, w string, _corrupt_record string").option("header", True).option("multiLine", True).option("quote", '"').option(
        "escape", '"').option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    assert split == [(i, r.k, r.v, r.w) for i, r in enumerate(whole.collect(), 1)]


def test_a_record_over_many_splits(small_splits, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"' + "line\n" * 2000 + '"\n2,c\n')
    rows = tables.read_csv(small_splits, str(tmp_path / "x.csv")).orderBy("_rid").collect()
    assert [(r["_rid"], r["a"], len(r["b"])) for r in rows] == [(1, "1", 10_000), (2, "2", 1)]


def test_headers_over_lines_and_empty_files(small_splits, tmp_path):
    (tmp_path / "h.csv").write_text('\n"a\nb",c\n1,2\n')
    df = tables.read_csv(small_splits, str(tmp_path / "h.csv"))
    assert [tuple(r)[:2] for r in df.select("_rid", *[c for c in df.columns if not c.startswith("_")]).collect()] == [(1, "1")]
    (tmp_path / "none.csv").write_text("")
    assert tables.read_csv(small_splits, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "only.csv").write_text("a,b")
    assert tables.read_csv(small_splits, str(tmp_path / "only.csv")).count() == 0
    (tmp_path / "plain.csv").write_text('a,b\n1,"x\n2,y"\n')
    assert [r["a"] for r in tables.read_csv(small_splits, str(tmp_path / "plain.csv"), quoted_newlines=False).orderBy("_rid").collect()] == ["1", "2"]


def test_changed_splits_are_told(small_splits, tmp_path):
    (tmp_path / "x.csv").write_text("a\n" + "row of some length\n" * 300)
    df = tables.read_csv(small_splits, str(tmp_path / "x.csv"))
    assert df.agg(F.max("_rid")).first()[0] == 300
