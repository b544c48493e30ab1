"""Block-wise sequences against plain Python, with one key holding most rows and NULL keys."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.operators import ranges
from gridweave.operators import sequence as seq


def make(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = None if i % 17 == 0 else (1 if rnd.random() < 0.6 else rnd.randint(2, 6))
        rows.append((key, i * 3, rnd.randint(0, 9), rnd.randint(-5, 5)))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k int, o bigint, v int, w int"), rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("blocks", [2, 7, 40])
@pytest.mark.parametrize("reverse", [False, True])
def test_running(spark, blocks, reverse):
    df, rows = make(spark)
    got = {(r["k"], r["o"]): (r["s"], r["n"]) for r in seq.running(
        df, ["k"], "o", {"s": F.col("w"), "n": F.lit(1)}, reverse=reverse, blocks=blocks).collect()}
    want = {}
    for key, group in by_key(rows).items():
        total = 0
        for i, r in enumerate(reversed(group) if reverse else group, 1):
            total += r[3]
            want[(key, r[1])] = (total, i)
    assert got == want


def test_running_without_keys_and_max(spark):
    df, rows = make(spark)
    ordered = sorted(rows, key=lambda r: r[1])
    got = {r["o"]: r["_rid"] for r in seq.number_rows(df, "o", blocks=9).collect()}
    assert got == {r[1]: i for i, r in enumerate(ordered, 1)}
    tops = {(r["k"], r["o"]): r["m"] for r in seq.running_max(df, ["k"], "o", F.col("w"), "m", blocks=9).collect()}
    for key, group in by_key(rows).items():
        best = -99
        for r in group:
            best = max(best, r[3])
            assert tops[(key, r[1])] == best


def test_keep_newest(spark):
    df, rows = make(spark)
    got = sorted((str(r["k"]), r["o"]) for r in seq.keep_newest(df, ["k"], "o", 11, blocks=13).collect())
    assert got == sorted((str(k), r[1]) for k, g in by_key(rows).items() for r in g[-11:])


def test_rank_rows_with_repeats(spark):
    df, rows = make(spark)
    got = {(r["k"], r["o"]): r for r in seq.rank_rows(df, ["k"], "v", blocks=5, ties=["o"], buckets=3).collect()}
    for key, group in by_key(rows).items():
        group = sorted(group, key=lambda r: (r[2], r[1]))
        values = sorted({r[2] for r in group})
        n = len(group)
        for i, r in enumerate(group, 1):
            below = sum(x[2] < r[2] for x in group)
            g = got[(key, r[1])]
            assert (g["row_number"], g["rank"], g["dense_rank"]) == (i, below + 1, values.index(r[2]) + 1)
            assert g["cume_dist"] == pytest.approx(sum(x[2] <= r[2] for x in group) / n)
            assert g["percent_rank"] == pytest.approx(below / (n - 1) if n > 1 else 0)
            big, small = n % 3, n // 3
            edge = big * (small + 1)
            assert g["ntile"] == ((i - 1) // (small + 1) if i - 1 < edge else big + (i - 1 - edge) // max(small, 1)) + 1


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours(spark, ahead):
    df, rows = make(spark)
    got = {(r["k"], r["o"]): r["x"] for r in seq.neighbours(df, ["k"], "o", {"x": "v"}, ahead=ahead, blocks=11).collect()}
    for key, group in by_key(rows).items():
        for i, r in enumerate(group):
            j = i + 1 if ahead else i - 1
            assert got[(key, r[1])] == (group[j][2] if 0 <= j < len(group) else None)


def test_rolling(spark):
    df, rows = make(spark)
    got = {(r["k"], r["o"]): r["s"] for r in seq.rolling(df, ["k"], "o", {"s": F.sum("w")}, back=40, ahead=7, blocks=50).collect()}
    for key, group in by_key(rows).items():
        for r in group:
            assert got[(key, r[1])] == sum(x[3] for x in group if r[1] - 40 <= x[1] <= r[1] + 7)


def skewed(spark, n=4000):
    """Few order values, one of them and NULL with much of the rows."""
    rnd = random.Random(21)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.choice([5, 5, 5, 5, 5, 5, 3, 7, None, None])) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k int, id bigint, v int").repartition(5)


def test_hot_order_values_are_cut_again(spark):
    df = skewed(spark)
    got = seq.rank_rows(df, ["k"], "v", blocks=40, ties=["id"], buckets=7)
    want = spark.sql("""SELECT k, id, v, row_number() OVER (PARTITION BY k ORDER BY v, id) AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
        percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist, ntile(7) OVER (PARTITION BY k ORDER BY v, id) AS ntile FROM {df} WINDOW w AS (PARTITION BY k ORDER BY v)""", df=df)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    for keys in (["k"], []):
        cut = seq._Cut(df, keys, "v", 40, None, ["id"])
        assert max(r["count"] for r in cut.rows.groupBy(*cut.by).count().collect()) < 4000 / 40 * 2.5
    run = seq.running(df, ["k"], "v", {"s": F.col("id")}, blocks=40, ties=["id"]).select("id", "s")
    plain = spark.sql("SELECT id, sum(id) OVER (PARTITION BY k ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS s FROM {df}", df=df)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, plain.collect()))
    newest = seq.keep_newest(df, ["k"], "v", 60, blocks=40, ties=["id"]).select("id")
    top = spark.sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY k ORDER BY v DESC, id DESC) AS n FROM {df}) WHERE n <= 60", df=df)
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, top.collect()))
    near = seq.neighbours(df, ["k"], "v", {"x": "id"}, blocks=40, ties=["id"]).select("id", "x")
    lag = spark.sql("SELECT id, lag(id) OVER (PARTITION BY k ORDER BY v, id) AS x FROM {df}", df=df)
    assert sorted(map(str, near.collect())) == sorted(map(str, lag.collect()))


@pytest.mark.parametrize(("back", "ahead"), [(700, 0), (2, 900), (5000, 5000)])
def test_rolling_totals(spark, back, ahead):
    df, _ = make(spark)
    df = df.withColumn("w", F.when(F.col("w") != 0, F.col("w")))
    late = df.withColumn("o", F.when(F.col("o") % 50 != 0, F.col("o")))
    for given, keys in ((df, ["k"]), (late, [])):
        got = seq.rolling_totals(given, keys, "o", {"s": ("sum", "w"), "n": ("count", "w"), "lo": ("min", "v"), "hi": ("max", "w")}, back, ahead, blocks=30)
        part = "PARTITION BY k" if keys else ""
        frame = f"OVER ({part} ORDER BY o RANGE BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
        want = spark.sql(f"SELECT k, o, v, w, sum(w) {frame} AS s, count(w) {frame} AS n, min(v) {frame} AS lo, max(w) {frame} AS hi FROM {{df}}", df=given)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_frames_within_a_block_are_running_totals(spark):
    """Two blocks, frames much shorter than either: no row goes through all values of its frame."""
    df = spark.range(20_000).select((F.col("id") - 10_000).alias("id"), (F.col("id") % 10).alias("w"))
    out = seq.rolling_totals(df, [], "id", {"s": ("sum", "w"), "top": ("max", "w")}, back=300, ahead=20, blocks=2)
    frame = "OVER (ORDER BY id RANGE BETWEEN 300 PRECEDING AND 20 FOLLOWING)"
    assert sorted(out.collect()) == sorted(spark.sql(f"SELECT id, w, sum(w) {frame} AS s, max(w) {frame} AS top FROM {{df}}", df=df).collect())
    text = out._jdf.queryExecution().optimizedPlan().toString()
    sliding = [line for line in text.split("\n") if "RangeFrame, cast(0" in line or "RangeFrame, 0" in line or "RangeFrame, currentrow$(), 320" in line]
    assert "unboundedpreceding$(), currentrow$()" in text and len(sliding) <= 1    # only that of frames in one segment


@pytest.mark.parametrize(("back", "ahead"), [(0, 0), (3, 4), (-2, 9)])
def test_rolling_totals_of_odd_values(spark, back, ahead):
    """NULL keys and orders, NaN, infinities, values too large for the frame to move them, negative ones and equal ones."""
    rnd = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 1e17, 1e17 + 16, -1e17, 0.0, -0.0]
    rows = [(rnd.choice([None, 0, 1]), rnd.choice([rnd.choice(odd), rnd.randint(-30, 30) / 2, float(rnd.randint(-9, 9))]), i, rnd.choice([None, rnd.randint(-9, 9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, x double, i bigint, v bigint")
    ints = df.where("abs(x) < 100 or x is null").withColumn("x", F.floor("x").cast("bigint"))
    for given in (df, ints):
        got = seq.rolling_totals(given, ["k"], "x", {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, back, ahead, blocks=6)
        kind = given.schema["x"].dataType.simpleString()
        a, b = (F.lit(y).cast(kind) for y in (-back, ahead))
        pairs = given.alias("p").join(given.alias("q"), F.expr("p.k <=> q.k") & (
            (F.col("p.x").isNull() & F.col("q.x").isNull()) | ((F.col("q.x") >= F.col("p.x") + a) & (F.col("q.x") <= F.col("p.x") + b))), "left")
        want = pairs.groupBy("p.i").agg(F.sum("q.v"), F.count("q.v"), F.min("q.v"), F.max("q.v"))
        assert sorted(map(tuple, got.select("i", "s", "n", "lo", "hi").collect())) == sorted(map(tuple, want.collect()))


def test_wide_frames_shuffle_rows_twice(spark):
    """No copies for the blocks between: what is met in windows is three rows for a row, whatever the frame."""
    df = spark.range(20_000).select("id", (F.col("id") % 10).alias("w"))
    out = seq.rolling_totals(df, [], "id", {"s": ("sum", "w")}, back=7000, blocks=64)
    first = [0]
    for i in range(20_000):
        first.append(first[-1] + i % 10)
    assert out.agg(F.sum("s")).first()[0] == sum(first[i + 1] - first[max(0, i - 7000)] for i in range(20_000))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence") == 1 and "_first" in plan    # only pairs of blocks are listed


def test_a_dense_spot_is_dealt_out(spark):
    rnd = random.Random(2)
    points = spark.createDataFrame([(i, 50.0 if rnd.random() < 0.9 else rnd.uniform(0, 100)) for i in range(3000)] + [(9999, None)], "i bigint, x double")
    bands = spark.createDataFrame([(n, lo, lo + rnd.choice([0.0, 0.5, 5.0, 200.0])) for n, lo in enumerate([-5.0, 0.0, 49.9, 50.0, 49.5, 99.0, 120.0])], "n int, lo double, hi double")
    got = ranges.band_join(points, "x", bands, "lo", "hi", slots=40)
    given = bands.collect()
    want = sorted((p.i, b.n) for p in points.collect() for b in given if p.x is not None and b.lo <= p.x < b.hi)
    assert sorted((r.i, r.n) for r in got.collect()) == want
    found, _, _ = seq.quantiles(points, "x", 40)
    assert len(set(found)) < 10 and found.count(50.0) > 30
    assert ranges.band_join(points.where("false"), "x", bands, "lo", "hi").count() == 0


def test_search_equals_tree(spark):
    bounds = [float(i * 7) for i in range(600)]
    df = spark.range(-5, 4300).select((F.col("id") * 1.0).alias("x"))
    bad = df.where(seq.block_of(F.col("x"), bounds) != F.greatest(F.lit(0), F.least(F.lit(600), F.ceil(F.col("x") / 7).cast("int"))))
    assert bad.count() == 0


def test_only_block_totals_meet_in_one_partition(spark):
    """The single-partition window runs over one row per block, not over the rows."""
    df, _ = make(spark)
    plan = seq.number_rows(df, "o", blocks=8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "Aggregate [_block" in plan
