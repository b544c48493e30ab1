"""Decontamination, language, quality and near copies against brute force, and held-out accuracy."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from odd_rows import documents, none, odd

from gridweave.llm import decontaminate as dc
from gridweave.llm import language, near, quality


def brute_hits(items, text, window):
    words, hit, which = dc.words_of(text or ""), set(), set()
    for item_id, item in items:
        own = dc.words_of(item or "")
        n = min(window, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == own[a:a + n]:
                    hit |= set(range(p, p + n))
                    which.add(item_id)
    return len(words), hit, which


def test_matches_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(120):
        letters, window = "abcdefghijklmnopqrstuvwxyz"[:rnd.choice([2, 3, 8, 26])], rnd.choice([2, 3, 5, 10])
        some = lambda n: " ".join(rnd.choice(letters) for _ in range(n))
        items = [(str(i), some(rnd.choice([0, 1, 2, 4, 9, 12, 60]))) for i in range(6)]
        texts = [some(rnd.choice([0, 3, 30, 80])) + rnd.choice(["", " zz ", " ZZ-q "]) + rnd.choice(items)[1] for _ in range(6)]
        counts, found = dc.find(dc.Benchmark(items, window), texts)
        ids = dc.Benchmark(items, window).ids
        for t, text in enumerate(texts):
            n, hit, which = brute_hits(items, text, window)
            mine = [m for m in found if m[0] == t]
            assert counts[t] == n
            assert {k for m in mine for k in range(m[3], m[3] + m[4])} == hit
            assert {ids[m[1]] for m in mine} == which


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "Two words"), (3, None), (None, "one"), (4, "?!")], "item_id bigint, text string")


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_decontamination_of_odd_rows(spark, items, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)    # the small one: several passes
    docs = odd(spark)
    pairs = [(r.item_id, r.text) for r in items.collect()]
    got = dc.find_matches(docs, items)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = got.select("doc_id", "n_words", dc.hit_words(dc.F.col("matches")).alias("n_hit")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, hit, _ = brute_hits(pairs, texts[r.doc_id], 10)
        assert (r.n_words, r.n_hit) == (n, len(hit))
    clean = dc.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(
        str(r.doc_id) for r in docs.collect() if not brute_hits(pairs, r.text, 10)[1])


def test_decontamination_of_empty_tables(spark, items):
    assert dc.find_matches(none(spark), items).collect() == []
    assert dc.decontaminate(odd(spark), items.where("false")).count() == odd(spark).count()


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, matrix = language.train(language.training_rows(docs))
    told = language.annotate(docs, langs, matrix).where(language.is_held_out(dc.F.col("doc_id"))).collect()
    assert told and sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)
    assert all(0 <= r.score <= 1 for r in told)


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    langs, matrix = language.train(language.training_rows(docs))
    got = language.annotate(docs, langs, matrix).collect()
    assert len(got) == docs.count()
    for r in got:
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und" and r.score == 0) if blank else r.lang_pred == "en"
    assert language.annotate(none(spark), langs, matrix).collect() == []
    unlabelled = language.train(docs.where("lang is null"))
    assert {r.lang_pred for r in language.annotate(docs, *unlabelled).collect()} == {"und"}


def test_a_rare_language_is_learned_under_the_bound(spark):
    words = {"aa": "the house and the garden", "bb": "der garten und das haus", "zz": "xyq wqz kvx qyw zxk"}
    rows = [(i, words["aa" if i % 3 else "bb"] + f" {i}", "aa" if i % 3 else "bb") for i in range(9000)] + [
        (100_000 + i, words["zz"], "zz") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.training_rows(docs, most=300)
    n = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    held = {r.lang: r.n for r in docs.where(~language.is_held_out(docs.doc_id)).groupBy("lang").agg(dc.F.count("*").alias("n")).collect()}
    assert n["zz"] == held["zz"] and 200 < sum(n.values()) < 400 and abs(n["aa"] - n["bb"]) < 80
    langs, matrix = language.train(sample)
    assert langs == ["aa", "bb", "zz"]
    prior = [2.718281828 ** float(x) for x in matrix[-1]]
    assert all(abs(p - held[k] / sum(held.values())) < 0.1 for k, p in zip(langs, prior, strict=True)) and prior[2] < 0.01
    got = language.annotate(docs.where("lang = 'zz'"), langs, matrix).collect()
    assert {r.lang_pred for r in got} == {"zz"}
    assert sum(language.shares({"a": 10, "b": 10_000, "c": 50_000}, 900)[k] * v for k, v in {"a": 10, "b": 10_000, "c": 50_000}.items()) == 900


def test_language_features_stay_in_their_text():
    alone = [language.features([t]) for t in ("abc def", "", "xyz", "q")]
    grams, starts = language.features(["abc def", "", "xyz", "q"])
    assert np.array_equal(grams, np.concatenate([g for g, _ in alone]))
    assert starts.tolist() == np.cumsum([0, *[len(g) for g, _ in alone][:-1]]).tolist()


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(covered)


def test_quality_figures_of_odd_rows(spark):
    docs = odd(spark)
    got = quality.judge(quality.measure(docs)).collect()
    for r in got:
        want = brute_figures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert quality.filter_documents(none(spark)).collect() == []
    assert quality.judge(quality.measure(none(spark))).collect() == []


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.judge(quality.measure(docs)).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").collect()
    assert judged and sum(r.kept == (r.label == 1) for r in judged) >= 0.97 * len(judged)


def test_vote_model_finds_reliable_rules():
    rnd = np.random.default_rng(3)
    truth = rnd.random(20000) < 0.85
    chance = np.where(truth[:, None], [0.01, 0.01, 0.02, 0.4], [0.6, 0.5, 0.7, 0.4])    # the last rule knows nothing
    votes = np.where(rnd.random((20000, 4)) < chance, quality.BAD, quality.GOOD)
    votes[rnd.random((20000, 4)) < 0.2] = quality.NONE
    model = quality.VoteModel(4).fit(votes, np.ones(20000))
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.95
    assert abs(model.bad_vote[0][3] - model.bad_vote[1][3]) < 0.1 and model.bad_vote[0][2] > 0.5


def brute_components(texts, k, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(lower))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and sets[j] and den * o >= num * (len(a) + len(sets[j]) - o):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_near_copies_equal_brute_force(spark, k, num):
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([1, 2, 8, 40, 120]))] for _ in range(12)]
    texts = [None, "", "  "]
    for b in base:
        for _ in range(6):    # copies with growing numbers of changes: chains of links, not all pairs of which link
            texts.append(" ".join(b))
            b = list(b)
            for _ in range(max(1, len(b) // 60)):
                b[rnd.randrange(len(b))] = rnd.choice(words)
    texts += texts[3:6]
    want, sizes = brute_components(texts, k, num, 100)
    got = {r.doc_id: r for r in near.near_copies(documents(spark, texts), k, num, 100).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    kept = near.deduplicate(documents(spark, texts), k, num, 100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_one_large_group_needs_no_round_of_all_pairs(spark):
    rnd = random.Random(1)
    base = [f"x{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        b = list(base)
        b[rnd.randrange(200)] = f"y{rnd.random()}"
        texts.append(" ".join(b))
    got = near.near_copies(documents(spark, texts), 3, 90, 100).collect()
    assert {r.component_id for r in got} == {0}


def test_near_copies_of_odd_rows(spark):
    docs = odd(spark)
    kept = near.deduplicate(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    texts = sorted((r.text or "") for r in kept.collect())
    assert texts == sorted([*{t for t in (r.text for r in docs.collect()) if t and t.strip()}, "", "", "   \n\t "])[:len(texts)] or len(texts) == len(set(texts)) + 1
    assert near.near_copies(none(spark), 3, 90, 100).collect() == []
    assert near.deduplicate(none(spark)).collect() == []


def test_search_counts_overlaps():
    rnd = np.random.default_rng(8)
    for _ in range(200):
        q = np.unique(rnd.integers(0, 60, 40)).astype(np.uint64)
        some = [np.unique(np.concatenate([q[rnd.random(len(q)) < 0.9], rnd.integers(0, 80, 4).astype(np.uint64)])) for _ in range(5)]
        for c, n in zip(some, near.search(q, some, 80, 100), strict=True):
            o = len(np.intersect1d(q, c))
            assert n == (o if 100 * o >= 80 * (len(q) + len(c) - o) else 0)
