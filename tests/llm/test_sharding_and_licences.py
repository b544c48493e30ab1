"""Shards against a brute-force minimax; licence places against a word-by-word scan."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

from odd_rows import documents, none, odd
from pyspark.sql import functions as F

from gridweave.llm import licences, shards


def least_largest(sizes, n):
    """The smallest largest part over all ways to cut the sizes into n runs, by dynamic programming."""
    best = [0] + [10**18] * len(sizes)
    for _ in range(n):
        new = best[:]
        for j in range(1, len(sizes) + 1):
            total = 0
            for i in range(j - 1, -1, -1):
                total += sizes[i]
                new[j] = min(new[j], max(best[i], total))
        best = new
    return best[len(sizes)]


def check_shards(spark, docs, n):
    rows = shards.shard_documents(docs, n).collect()
    given = sorted(((r.doc_id is None, r.doc_id or 0), (r.text or "")) for r in docs.select("doc_id", "text").collect())
    assert len(rows) == len(given)
    slots, of_key, total = defaultdict(list), defaultdict(set), defaultdict(int)
    atoms = defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        of_key[r.key].add(r.shard)
        total[r.shard] += r.size
        atoms[r.key] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_key.values())
    assert all(0 <= s < n for s in slots)
    ordered = [atoms[k] for k in sorted(atoms)]
    if ordered:
        assert max(total.values()) == least_largest(ordered, n)
    by_key = sorted((k, s) for k, v in of_key.items() for s in v)
    assert [s for _, s in by_key] == sorted(s for _, s in by_key)


def test_shards_are_minimax(spark):
    rnd = random.Random(4)
    for n, atoms in ((8, 60), (3, 5), (8, 4)):
        texts = ["x" * rnd.choice([0, 3, 40, 700]) + str(i) for i in range(atoms)]
        check_shards(spark, documents(spark, [t for t in texts for _ in range(rnd.choice([1, 1, 4]))]), n)


def test_a_hot_text_leaves_no_shard_empty(spark):
    docs = documents(spark, ["the same text " * 20] * 300 + [f"text {i:03} " * 30 for i in range(600)])
    check_shards(spark, docs, 8)
    sizes = sorted(r.n for r in shards.shard_documents(docs, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect())
    hot = 300 * 281
    assert len(sizes) == 8 and sizes[-1] == hot and sizes[0] > (sum(sizes) - hot) / 7 / 2


def test_even_cuts_of_any_sizes():
    rnd = random.Random(5)
    for _ in range(300):
        sizes = [rnd.choice([1, 2, 5, 30, 200]) for _ in range(rnd.randint(1, 40))]
        n = rnd.randint(1, 9)
        ends = [sum(sizes[:i + 1]) for i in range(len(sizes))]
        cells = [shards.Cell(5, i, x, i, i) for i, x in enumerate(sizes)]
        most = least_largest(sizes, n)
        cuts, unclear = shards.even_cuts(ends, cells, most, n)
        parts = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)]
        assert not unclear and len(parts) == min(n, len(sizes)) and 0 < min(parts) and max(parts) == most


def test_shards_when_cells_must_be_split(spark, monkeypatch):
    monkeypatch.setattr(shards, "STEP_BITS", 4)    # 16 cells a step, so most cuts fall inside one
    check_shards(spark, documents(spark, [f"text {i} " * (i % 7) for i in range(120)]), 8)


def test_shards_of_odd_rows(spark):
    check_shards(spark, odd(spark), 8)
    assert shards.shard_documents(none(spark)).collect() == []
    row = shards.shard_documents(documents(spark, [None])).first()
    assert (row.size, row.text_crc32, row.slot) == (1, 0, 0)
    assert shards.shard_documents(documents(spark, ["é"])).first().text_crc32 == zlib.crc32("é".encode())


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_places(text):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    found = []
    for t in licences.TEMPLATES:
        n = len(t.key_words)
        found += [(t.label, t.base, i) for i in range(len(words) - n + 1) if words[i:i + n] == t.key_words]
    return len(words), sorted(found)


def test_licence_places(spark):
    texts = ["Released under the MIT License.", "under the mit license under the mit license", "under THE mit licence",
             "Licensed under CC BY-NC 4.0; Apache License, Version 2.0", "cc by nc", "mit license the under", "All rights reserved.",
             "underthe mit license xunder the mit license", "Under the MİT license under the mit license",
             "This work is licensed under the GNU General Public License, version 3.", None, "", "é under the MIT license é"]
    got = licences.scan_licences(documents(spark, texts)).collect()
    for r in got:
        n, want = brute_places(texts[r.doc_id])
        assert r.n_words == n
        assert sorted((m.label, m.base, s) for m in r.matches for s in m.starts) == want
        assert all(0 < m.score <= 1 for m in r.matches)


def test_licences_of_odd_rows(spark):
    docs = odd(spark)
    got = {(r.doc_id, r.n_words) for r in licences.scan_licences(docs).collect()}
    assert got == {(r.doc_id, brute_places(r.text)[0]) for r in docs.select("doc_id", "text").collect()}
    assert licences.scan_licences(none(spark)).collect() == []


def test_full_score_for_a_whole_template(spark):
    out = licences.scan_licences(documents(spark, ["Released under the MIT License.", "under the MIT license"]))
    scores = {r.doc_id: r.s for r in out.select("doc_id", F.array_max(F.transform("matches", lambda m: m["score"])).alias("s")).collect()}
    assert scores[0] == 1.0 and scores[1] < 1.0
