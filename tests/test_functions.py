"""Cell typing and text helpers, value by value."""

import pytest
from pyspark.sql import functions as F

from gridweave.functions import cells, regexes, text


def values(spark, inputs, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    rows = df.select("i", *[e.alias(f"e{n}") for n, e in enumerate(exprs)]).orderBy("i").collect()
    return [tuple(r[1:]) if len(exprs) > 1 else r[1] for r in rows]


def test_numbers(spark):
    v = F.col("v")
    got = values(spark, ["7", " 1,234.5 ", "1_000", "1__0", ".5", "1e3", "+2.", "12d", "0x1", "inf", "nan", "", "n/a", None, "1e999"],
                 cells.coerce_number(v), cells.rescue_number(v))
    assert got == [(7.0, None), (1234.5, None), (1000.0, None), (None, "1__0"), (0.5, None), (1000.0, None), (2.0, None), (None, "12d"),
                   (None, "0x1"), (float("inf"), None), (None, None), (None, None), (None, "n/a"), (None, None), (float("inf"), None)]


def test_booleans_and_lists(spark):
    assert values(spark, ["Yes", " on ", "1", "t", "", None], cells.coerce_boolean(F.col("v"))) == [True, True, True, False, False, None]
    assert values(spark, ['[" a ", "", "b"]', "one", " ", "[bad", None], cells.coerce_file_list(F.col("v"))) == [
        ["a", "b"], ["one"], None, ["[bad"], None]


def test_number_text(spark):
    d = F.col("v").cast("double")
    assert values(spark, ["5", "5.5", "-3", None], cells.number_to_text(d)) == ["5", "5.5", "-3", None]


def test_regexes(spark):
    v = F.col("v")
    inputs = ["id=42 id=7", "none", None]
    assert values(spark, inputs, regexes.re_match(v, r"id=\d")) == [True, False, False]
    assert values(spark, inputs, regexes.re_extract(v, r"id=(?P<n>\d+)", 1)) == ["42", None, None]
    assert values(spark, inputs, regexes.re_extract(v, r"id=(\d+)", 5)) == [None] * 3
    assert values(spark, inputs, regexes.re_extract_all(v, r"id=(\d+)", 1)) == [["42", "7"], [], []]
    assert values(spark, inputs, regexes.re_replace(v, r"id=(\d+)", r"<\1$>")) == ["<42$> <7$>", "none", None]
    assert values(spark, inputs, regexes.re_match(v, "("), regexes.re_replace(v, "(", "x")) == [(False, i) for i in inputs]


def test_sql_functions(spark):
    regexes.register_sql(spark)
    r = spark.sql(r"SELECT re_match('b+', 'abb') AS a, re_match(NULL, 'x') AS b, re_extract('a1', '[0-9]') AS c, re_extract('a', '[0-9]') AS d, "
                  r"re_replace('aXb', 'X', NULL) AS e, re_replace('a', NULL, 'b') AS f").first()
    assert tuple(r) == (True, False, "1", None, "ab", "a")


def test_texts(spark):
    v = F.col("v")
    assert values(spark, ["abcdef", "abc", None], text.clip(v, 3)) == ["abc… (+3 chars)", "abc", None]
    assert values(spark, [" a\n b\tc ", None], text.clip_line(v, 3)) == ["a b…", ""]
    assert values(spark, ["﻿A​ B", None], text.clean_invisible(v)) == ["A B", ""]
    assert values(spark, ["Hello, World!", "---", None], text.slug(v, "x")) == ["hello-world", "x", "x"]
    assert values(spark, [" a, ,b ,", None], text.split_list(v)) == [["a", "b"], []]
    assert values(spark, ["Ünïcôdé ñ", "é", "ß"], text.fold_accents(v)) == ["Unicode n", "e", "ß"]
    assert values(spark, ["0", "512", "1536", "10240", "5242880", "2147483648"], text.format_bytes(v.cast("bigint"))) == [
        "empty", "512 B", "1.5 KB", "10 KB", "5.0 MB", "2.0 GB"]
    assert values(spark, ["12ab34cd", "12AB34CD", "x", None], text.looks_like_id(v)) == [True, False, False, False]


@pytest.mark.parametrize("seconds, ago, until", [(5, "5s ago", "in 5s"), (125, "2m ago", "in 2m"), (7200, "2h ago", "in 2h"), (200000, "2d ago", "in 2d")])
def test_times(spark, seconds, ago, until):
    now = F.lit(1e9)
    r = spark.range(1).select(text.relative_time(now - seconds, now), text.until_time(now + seconds, now), text.until_time(now - 1, now),
                              text.duration_text(F.lit(None).cast("double"), now)).first()
    assert tuple(r) == (ago, until, "now", "—")
