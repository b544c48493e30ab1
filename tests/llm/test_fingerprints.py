"""Fingerprints against a plain one-permutation MinHash in Python, and likeness against true similarity."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import xxhash
from odd_rows import LONG, documents, none, odd
from pyspark.sql import functions as F

from gridweave.llm import fingerprints as fp


def long_hash(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed=seed)
    return seed


def shingles(text):
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    if not words:
        return set()
    return {long_hash(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


ORDERS = np.random.default_rng(fp.SEED).permuted(np.tile(np.arange(fp.BINS), (fp.BINS, 1)), axis=1)


def brute(text):
    held = {}
    for h in shingles(text):
        b = (h >> 57) ^ 64    # bins in the order of signed hashes
        held[b] = min(held.get(b, h), h)
    if not held:
        return ""
    low = [held[next(int(j) for j in [i, *ORDERS[i]] if int(j) in held)] & 255 for i in range(fp.BINS)]
    return "".join(f"{sum(v << 8 * i for i, v in enumerate(low[n:n + 8])):016x}" for n in range(0, fp.BINS, 8))


def like(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    same = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b), strict=True)) / fp.BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def some_texts(n=60):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 5, 6, 12, 80, 700]))) for _ in range(n)]
    return [*texts, texts[5], None, "", " \t", LONG, "ÄÖ ß é 中文 😀   x y Z"]


def check(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = fp.op13_fingerprints(spark, str(tmp_path)).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, xxhash.xxh64_intdigest((r.text or "").encode(), seed=42)), r.doc_id, r.text or "")
                   for r in docs.select("doc_id", "text").collect())
    order.sort(key=lambda r: (r[0][0], r[0][1], r[0][2] - (1 << 64) if r[0][2] >> 63 else r[0][2]))
    want = []
    for i, (_, doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = brute(text), brute(edited), brute(after)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, c), 9)))
    key = repr
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in got), key=key) == sorted(want, key=key)


def test_every_row_equals_brute_force(spark, tmp_path):
    check(spark, documents(spark, some_texts()), tmp_path)


def test_odd_rows(spark, tmp_path):
    check(spark, odd(spark), tmp_path / "odd")
    check(spark, documents(spark, ["just one document of seven words here"]), tmp_path / "one")
    none(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert fp.op13_fingerprints(spark, str(tmp_path / "none")).collect() == []


def test_likeness_estimates_similarity(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        words = [f"{rnd.random():.6f}" for _ in range(400)]
        cut = rnd.randint(0, 400)
        rows.append((i, " ".join(words), " ".join(words[:cut] + [f"{rnd.random():.6f}" for _ in range(400 - cut)])))
    got = (spark.createDataFrame(rows, "i int, a string, b string").select("*", fp.packed_fingerprint(F.col("a")).alias("p"),
                                                                             fp.packed_fingerprint(F.col("b")).alias("q"))
           .select("a", "b", fp.likeness(F.col("p"), F.col("q")).alias("likeness")).collect())
    errors = []
    for r in got:
        a, b = shingles(r.a), shingles(r.b)
        errors.append(r.likeness - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05 and max(map(abs, errors)) < 0.2


def test_no_python_in_the_plan(spark):
    plan = fp.op13_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
