"""Rows that every operator must get through: nulls, blanks, very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

LONG = "Aal b2 ccc. " * 30_000
TEXTS = [None, "", "   \n\t ", "one", "Two words", "the same text twice over", "the same text twice over", LONG,
         "ÄÖ ß é 中文 😀   x y", "!!! ### $$$", "a b c d e f g h i j k l m n o p", "line one\nline two\nline one\n"]


def documents(spark, texts=TEXTS, ids=None):
    """Documents with columns named like those that operators make, a repeated row and a NULL id."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if n % 2 else None, "s", n, "x", 1.5) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    schema = "doc_id bigint, text string, lang string, source string, n_words bigint, shard string, score double"
    return spark.createDataFrame(rows, schema).repartition(3)


def odd(spark):
    return documents(spark, [*TEXTS, "the same text twice over", "no id"], [*range(len(TEXTS)), 5, None])


def none(spark):
    return odd(spark).where("false")
