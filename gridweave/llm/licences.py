"""Licence scan with a positional index of the licences' rarest words.

1. The words of all key phrases are counted over all documents (one count per document), which gives their
   inverse document frequency.
2. Every template is indexed under the ``ANCHORS`` highest-IDF words of its key phrase, with their relative
   positions. A document's occurrences of such a word propose template starts; the starts proposed by all
   anchors of a template are intersected.
3. A start counts when the whole key phrase stands there. As a key phrase contains its own anchors, no
   place is missed. The score is the IDF-weighted share of the template's words found at their places.

All of it is DataFrame expressions over one document at a time; the only shuffle is that of the counts of
the few words of the templates.

Defined results: a NULL or empty text has no words, no labels, NULL first_word and last_word, score 0; every
place of a repeated or overlapping phrase counts; repeated rows give repeated rows; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How many of a key phrase's rarest words are intersected.
ANCHORS = 3


@dataclass(frozen=True)
class Template:
    """A licence line: its words, and the key phrase inside that must stand in the text word for word."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i:i + n] == self.key_words)


TEMPLATES = [
    Template("mit", "released under the mit license", "under the mit license", base=True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", base=True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", base=True),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "licensed under the mozilla public license version 2 0", "mozilla public license version 2"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "hereby granted free of charge to any person obtaining a copy"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
             "permission to use copy modify and or distribute this software for any purpose"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
]


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased.

    ``lower`` also changes other letters; the only two that it would turn into a-z (the Kelvin sign and the
    dotted capital I) are first replaced by another letter beyond ASCII, so ASCII words come out the same.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å")), F.lit("İ"), F.lit("å"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_idf(docs: DataFrame, templates: Sequence[Template], text_col: str = "text") -> dict[str, float]:
    """ln((documents + 1) / (documents with the word + 1)) of every template word, over all documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = docs.select(words_of(F.col(text_col)).alias("words")).select(
        F.array_append(F.array_intersect("words", strings(vocabulary)), F.lit("")).alias("present"))
    counts = {r["word"]: r["n"] for r in present.select(F.explode("present").alias("word"))
              .groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most one row per template word
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def anchors_of(template: Template, idf: dict[str, float]) -> list[tuple[int, str]]:
    """(position in the key phrase, word) of the key phrase's highest-IDF words; a repeated word counts once."""
    first = {w: i for i, w in reversed(list(enumerate(template.key_words)))}
    return [(first[w], w) for w in sorted(first, key=lambda w: (-idf[w], w))[:ANCHORS]]


def key_starts(words: Column, positions: Column, template: Template, idf: dict[str, float]) -> Column:
    """Where the template's key phrase stands: anchors' starts intersected, then the phrase verified."""
    def from_anchor(at: int, word: str) -> Column:
        return F.transform(F.filter(positions, lambda p: p["word"] == F.lit(word)), lambda p: p["at"] - at)

    proposed = None
    for at, word in anchors_of(template, idf):
        starts = from_anchor(at, word)
        proposed = starts if proposed is None else F.array_intersect(proposed, starts)
    phrase = strings(template.key_words)
    return F.filter(proposed, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, len(template.key_words)) == phrase))


def match_score(words: Column, starts: Column, template: Template, idf: dict[str, float]) -> Column:
    """The best IDF-weighted share of template words that stand at their places around a start."""
    weight = {w: max(idf[w], 1e-3) for w in template.words}
    total = sum(weight[w] for w in template.words)

    def share(start: Column) -> Column:
        found = F.lit(0.0)
        for i, w in enumerate(template.words):
            at = start + F.lit(i - template.key_at)
            found = found + F.when((at >= 0) & (F.get(words, at) == F.lit(w)), F.lit(weight[w])).otherwise(F.lit(0.0))
        return found / F.lit(total)

    return F.array_max(F.transform(starts, share))


def scan_licences(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words`` and ``matches``, an array of (label, base, starts, score)."""
    idf = word_idf(docs, templates, text_col)
    anchors = sorted({w for t in templates for _, w in anchors_of(t, idf)})
    told = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    positions = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
                         lambda p: p["word"].isin(anchors))
    told = told.select("doc_id", "words", F.size("words").cast("bigint").alias("n_words"),
                       F.array_intersect("words", strings(anchors)).alias("present"))
    # A document without the anchors of any template is not looked at word by word.
    complete = [F.size(F.array_intersect(F.col("present"), strings([w for _, w in anchors_of(t, idf)]))) == len(anchors_of(t, idf))
                for t in templates]
    any_complete = complete[0]
    for c in complete[1:]:
        any_complete = any_complete | c
    told = told.select("doc_id", "n_words", "words", F.when(any_complete, positions).alias("positions"))
    starts = [key_starts(F.col("words"), F.col("positions"), t, idf).alias(f"s{i}") for i, t in enumerate(templates)]
    told = told.select("doc_id", "n_words", "words", *starts)
    found = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.col(f"s{i}").alias("starts"),
                               match_score(F.col("words"), F.col(f"s{i}"), t, idf).alias("score"))
                      for i, t in enumerate(templates)])
    return told.select("doc_id", "n_words", F.filter(found, lambda m: F.size(F.coalesce(m["starts"], F.array().cast("array<int>"))) > 0).alias("matches"))


def _labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def _sql() -> str:
    templates = TEMPLATES
    vocabulary = sorted({w for t in templates for w in t.words})
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ",\n".join(f"({i}, '{t.label}', {str(t.base).lower()}, {quoted(t.words)}, {quoted(t.key_words)}, {t.key_at})"
                      for i, t in enumerate(templates))
    return rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
templates(id, label, base, words, key, key_at) AS (VALUES {rows}),
total AS (SELECT count(*) AS n FROM docs),
vocabulary AS (SELECT unnest({quoted(vocabulary)}) AS word),
present AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_intersect(words, {quoted(vocabulary)})) AS word FROM docs) GROUP BY word),
idf AS (SELECT v.word, greatest(ln((t.n + 1)::DOUBLE / (coalesce(p.n, 0) + 1)), 1e-3) AS weight
        FROM vocabulary v CROSS JOIN total t LEFT JOIN present p USING (word)),
token AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS at FROM docs),
place AS (SELECT k.row, t.id, t.label, t.base, t.words, t.key_at, k.at AS start FROM token k JOIN templates t ON k.word = t.key[1]
          JOIN docs d ON d.row = k.row WHERE d.words[k.at + 1:k.at + len(t.key)] = t.key),
piece AS (SELECT row, id, start, key_at, unnest(words) AS word, unnest(range(len(words))) AS i FROM place),
scored AS (SELECT p.row, p.id, p.start, sum(CASE WHEN p.start - p.key_at + p.i >= 0 AND d.words[p.start - p.key_at + p.i + 1] = p.word
             THEN f.weight ELSE 0 END) / sum(f.weight) AS score
           FROM piece p JOIN docs d ON d.row = p.row JOIN idf f ON f.word = p.word GROUP BY p.row, p.id, p.start),
found AS (SELECT p.row, count(*) FILTER (p.base) AS n_base, min(p.start) FILTER (p.base) AS first_word,
            max(p.start) FILTER (p.base) AS last_word,
            coalesce(array_to_string(list_sort(list(DISTINCT p.label) FILTER (p.base)), ','), '') AS base_labels,
            array_to_string(list_sort(list(DISTINCT p.label)), ',') AS labels, max(s.score) AS score
          FROM place p JOIN scored s USING (row, id, start) GROUP BY p.row)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(f.n_base, 0)::BIGINT AS n_base, f.first_word::BIGINT AS first_word,
  f.last_word::BIGINT AS last_word, coalesce(f.base_labels, '') AS base_labels, coalesce(f.labels, '') AS labels,
  coalesce(round(f.score, 6), 0.0) AS score
FROM docs d LEFT JOIN found f ON f.row = d.row
"""


@query("op10_licence_scan", _sql())
def op10_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = scan_licences(spark.read.parquet(f"{sf}/documents.parquet"))
    base = F.filter("matches", lambda m: m["base"])
    places = F.flatten(F.transform(base, lambda m: m["starts"]))
    return out.select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), 6).alias("score"))
