"""Collocations against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from odd_rows import documents, none, odd
from pyspark.sql import functions as F

from gridweave.llm import phrases


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute_counts(rows):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    return n, f


def brute(rows, least, top):
    n, f = brute_counts(rows)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(len(q) > len(p) and g == lang and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (g, q), b in cand.items()):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s)
                  for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def some_rows(n=400, seed=11):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "Ж", "中文", "_"]
    fixed = ["alpha beta gamma delta", "one two", "once upon a time", "to be or not to be"]
    rows = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choices(words, weights=range(1, 11))[0] for _ in range(rnd.randint(0, 30))]
        rows.append((rnd.choice(["en", "de", None]), "".join(p + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", " \v"]) for p in parts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1) for i, (g, t) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, n int").repartition(4)


@pytest.mark.parametrize(("sample", "least"), [(4, 30), (50, 12)])
def test_every_phrase_is_counted(spark, sample, least):
    rows = some_rows()
    got = phrases.frequent_phrases(frame(spark, rows), least, sample).collect()
    n, f = brute_counts(rows)
    assert sorted((r.lang, r.phrase, r.n) for r in got if r.words) == sorted((g, " ".join(p), a) for (g, p), a in f.items() if a >= least)
    assert {r.lang: r.n for r in got if not r.words} == dict(n)


def test_ranked_phrases(spark):
    rows = some_rows(seed=2)
    for top in (7, 2000):
        got = phrases.collocations(frame(spark, rows), 20, top).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 20, top)


def test_copies_and_a_hot_text(spark):
    rows = [("en", "the same few words again and again the same few words")] * 300 + some_rows(50)
    got = phrases.collocations(frame(spark, rows), 30).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 30, 2000)


def test_odd_rows(spark):
    docs = documents(spark, [*[r.text for r in odd(spark).collect()], "a b", "a b"])
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = phrases.collocations(docs, 2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2, 2000)
    assert phrases.collocations(none(spark)).collect() == []
    assert phrases.collocations(documents(spark, [None, "", " .,; "])).collect() == []


def test_chunks_of_any_size(monkeypatch):
    """Whole counts whatever the cuts, in one process."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["a", "bb", "ccc.", "é"], k=500)), "", "x", " ".join(["a"] * 300), "long" * 50]
    rows = [("en" if i % 2 else "de", t) for i, t in enumerate(texts)]
    n, f = brute_counts(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])
    for chunk in (7, 64, 1000, 1 << 20):
        monkeypatch.setattr(phrases, "CHUNK", chunk)
        got = Counter()
        for out in phrases.counter(None, None, range(1, 2), True)([batch]):
            for r in out.to_pylist():
                got[r["lang"], r["words"], r["phrase"]] += r["n"]
        everything = phrases.Filter(phrases.np.full(1024, 255, phrases.np.uint8))
        for out in phrases.counter(lambda e=everything: e.cells, None, range(2, 5), False)([batch]):
            for r in out.to_pylist():
                got[r["lang"], r["words"], r["phrase"]] += r["n"]
        assert {k: v for k, v in got.items() if not k[1]} == {(g, 0, ""): v for g, v in n.items()}
        assert {k: v for k, v in got.items() if k[1]} == {(g, len(p), " ".join(p)): v for (g, p), v in f.items()}


def test_scores_beyond_64_bits(spark):
    big = (1 << 62) + 12345
    rows = [("en", 1, "a", big + 7), ("en", 1, "b", big + 2), ("en", 1, "c", big + 1), ("en", 2, "a b", big), ("en", 2, "b c", big - 5), ("en", 3, "a b c", big // 5 * 4)]
    frequent = spark.createDataFrame(rows, "lang string, words int, phrase string, n bigint")
    f = {p: n for _, _, p, n in rows}
    got = {r.phrase: r for r in phrases.scored(frequent).collect()}
    for p in ("a b", "b c", "a b c"):
        w = p.split()
        score, k = min((2000000 * f[p] // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w)))
        r = got[p]
        assert (r.score, r.l, r.r, r.a) == (score, f[" ".join(w[:k])], f[" ".join(w[k:])], f[p])
    left = {r.phrase for r in phrases.uncovered(phrases.scored(frequent)).collect()}
    want = {p for p in got if len(p) == 5 or 100 * f["a b c"] < 80 * f[p]}
    assert left == want


def test_one_task_never_holds_a_language(spark):
    rows = spark.range(20_000).select(F.lit("en").alias("lang"), (F.col("id") % 97).alias("score"), F.col("id").alias("a"), F.col("id").cast("string").alias("phrase"))
    got = phrases.best_of_each(rows, "lang", 50, F.desc("score"), F.desc("a"), F.asc("phrase")).orderBy("rank").collect()
    want = sorted(((i % 97, i) for i in range(20_000)), reverse=True)[:50]
    assert [(r.score, r.a, r["rank"]) for r in got] == [(s, i, n) for n, (s, i) in enumerate(want, 1)]
