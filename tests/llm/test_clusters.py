"""Clusters against plain integer arithmetic over every centroid."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import pytest

from gridweave.llm import clusters

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, distance double, x string"


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(Fraction(v) * 64) for v in x]) for i, x in rows
            if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [x for _, x in order[:k]]

    def assign(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, x in kept:
            groups[assign(x)[1]].append(x)
        cents = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, cents, strict=True)]
    out = [(i, *assign(x)) for i, x in kept]
    inertia = [sum(d for _, d, c in out if c == n) for n in range(len(cents))]

    def fits(n):
        return n if n < 1 << 63 else None
    lost = [any(d >= 1 << 63 for _, d, c in out if c == n) for n in range(len(cents))]
    return sorted(((i, c, fits(d), None if lost[c] else fits(inertia[c]), None if any(lost) else fits(sum(inertia)),
                    hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in out), key=repr)


def run(spark, path, rows):
    spark.createDataFrame([(i, x, "a", 1.0, "b") for i, x in rows], SCHEMA).repartition(3).write.parquet(str(path / "embeddings.parquet"))
    return sorted((tuple(r) for r in clusters.op12_centroid_clustering(spark, str(path)).collect()), key=repr)


def vectors(n, spread=1.0, seed=5, steps=40):
    rnd = random.Random(seed)
    return [(i, [spread * rnd.randint(-steps, steps) / steps for _ in range(64)]) for i in range(n)]


def test_equals_brute_force(spark, tmp_path):
    rows = vectors(300)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, 1.0])] + [0.0] * 63) for i in range(40)] + [(100 + i, [0.0] * 64) for i in range(9)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)


def test_a_hot_vector_and_copies(spark, tmp_path):
    rows = vectors(60) + [(1000 + i, [0.25] * 64) for i in range(200)] + [(7, [0.5] * 64), (7, [0.5] * 64), (None, [0.75] * 64)]
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("spread", [3e4, 1e9, 1e200])
def test_large_components_are_exact(spark, tmp_path, spread):
    rows = vectors(40, 1.0) + [(500 + i, x) for i, x in vectors(12, spread, seed=9)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    good = vectors(5)
    bad = [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [None] + [1.0] * 63), (55, [float("nan")] + [0.0] * 63),
           (56, [float("inf")] + [0.0] * 63), (57, [float("-inf")] * 64)]
    assert run(spark, tmp_path / "few", good + bad) == brute(good + bad)
    assert run(spark, tmp_path / "bad", bad) == []


def test_tournament_counts_its_tests(spark):
    """The winner of the sign tests is the nearest centroid also where many distances are equal."""
    import numpy as np
    rnd = random.Random(2)
    cents = [tuple(rnd.randint(-1, 1) for _ in range(64)) for _ in range(16)]
    x = np.array([[rnd.randint(-2, 2) for _ in range(64)] for _ in range(400)], float)
    winner, distance = clusters.Tournament(cents).nearest(x)
    for v, w, d in zip(x.astype(int).tolist(), winner, distance, strict=True):
        assert (int(d), int(w)) == min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in clusters.op12_centroid_clustering(spark, sf).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(db.execute(clusters._oracle()).fetchall()) == got
