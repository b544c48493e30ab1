"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of labelled texts per language; the counts are added up per task, then by
Spark, so the model is a matrix of languages by ``BUCKETS`` log-probabilities whatever the number of texts. It
is broadcast (32 bytes a bucket with 8 languages), and documents are scored in numpy: the n-grams of a batch are
looked up in the matrix and summed per document.

Only lower-cased letters count, every other run of characters being one space. The text decides alone.

Defined results: a text that is NULL or has no letter is ``und`` with score 0; with no labelled text at all, all
are; equal scores go to the language that sorts first; NULL labels are not learned from; repeated rows stay
repeated; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import slices, texts_of, tidy
from .registry import query

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: About so many labelled documents are learned from, chosen by a hash of doc_id within each language: small languages
#: whole, the others in equal shares. In the prior each stands for all of its language that it was chosen from.
TRAIN_DOCUMENTS = 40_000
#: Characters counted or scored at a time.
BATCH_CHARS = 1 << 18
#: Added to every count.
SMOOTHING = 0.5


def normal(text: str) -> str:
    """Lower case, letters only, single spaces around and between."""
    if text.isascii():
        return " " + " ".join(text.lower().translate(_ASCII).split()) + " "
    return " " + " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split()) + " "


_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts, and where each text's begin; a text without letters has none."""
    pad = max(ORDERS) - 1  # so that no n-gram reaches into the next text
    plain = [normal(t) for t in texts]
    size = np.array([len(p) if len(p) > 2 else 0 for p in plain], np.int64)
    joined = "".join([p + " " * pad for p in plain if len(p) > 2])
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    ends = np.cumsum(size[size > 0] + pad)
    own = np.ones(len(chars), bool)
    for i in range(1, pad + 1):
        own[ends - i] = False
    out, hashed = [], np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        hashed = hashed * np.uint32(0x01000193) + np.roll(chars, 1 - n)
        if n in ORDERS:
            mixed = hashed * np.uint32(0x9E3779B1) + np.uint32(n)
            out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)) & np.uint32(BUCKETS - 1))
    return np.stack(out, axis=1)[own].reshape(-1), (np.cumsum(size) - size) * len(ORDERS)


COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.float64())])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", weight_col: str = "_weight") -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix of log-probabilities with the prior in an additional last row.

    ``weight_col``, where it is there: for how many documents of its language each stands in the prior.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs, weights = texts_of(batch, "text"), batch.column("lang").to_pylist(), batch.column("weight").to_pylist()
            for a, b in slices(texts, map(len, texts), BATCH_CHARS):
                for lang in set(langs[a:b]):
                    grams, _ = features([texts[i] for i in range(a, b) if langs[i] == lang])
                    total = totals.setdefault(lang, np.zeros(BUCKETS + 1))
                    total[:-1] += np.bincount(grams, minlength=BUCKETS)
                    total[-1] += sum(weights[i] for i in range(a, b) if langs[i] == lang)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], schema=COUNTS)

    weight = F.col(weight_col) if weight_col in labelled.columns else F.lit(1.0)
    found = (labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), weight.cast("double").alias("weight"))
             .where("lang is not null and text is not null").mapInArrow(tidy(count), "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # At most BUCKETS + 1 rows per language.
    rows = found.toArrow()
    names = rows["lang"].to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((BUCKETS + 1, len(langs)))
    number = {lang: i for i, lang in enumerate(langs)}
    counts[rows["bucket"].to_numpy(), [number[x] for x in names]] = rows["n"].to_numpy()
    grams = counts[:-1] + SMOOTHING
    prior = counts[-1:] + SMOOTHING
    return langs, np.concatenate([np.log(grams / grams.sum(axis=0, keepdims=True)), np.log(prior / max(prior.sum(), 1))]).astype(np.float32)


def score(texts: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior probability."""
    grams, starts = features(texts)
    total = np.tile(matrix[-1].astype(np.float64), (len(texts), 1))
    size = np.diff(np.concatenate([starts, [len(grams)]]))
    some = np.flatnonzero(size)
    if len(some) and langs:
        total[some] += np.add.reduceat(matrix[grams], starts[some], axis=0, dtype=np.float64)
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    best = total.argmax(axis=1)
    chance = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return ([langs[k] if n else "und" for k, n in zip(best, size, strict=True)],
            [float(min(1.0, c)) if n else 0.0 for c, n in zip(chance, size, strict=True)])


def annotate(docs: DataFrame, langs: list[str], matrix: np.ndarray, text_col: str = "text",
             pred: str = "lang_pred", chance: str = "score") -> DataFrame:
    """The rows of ``docs`` with the predicted language and its posterior probability as new columns."""
    shipped = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shipped.value
        for batch in batches:
            texts = texts_of(batch, text_col)
            named: list[str] = []
            chances: list[float] = []
            for a, b in slices(texts, map(len, texts), BATCH_CHARS):
                found = score(texts[a:b], langs, matrix)
                named += found[0]
                chances += found[1]
            yield batch.append_column(pred, pa.array(named, pa.string())).append_column(chance, pa.array(chances, pa.float64()))

    kept = docs.drop(pred, chance)
    schema = kept.select("*", F.lit("").alias(pred), F.lit(0.0).alias(chance)).schema
    return kept.mapInArrow(tidy(run), schema)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shares(counts: dict[str, int], most: int) -> dict[str, float]:
    """The rate at which each language is sampled: all of small ones, and equal numbers of the others, ``most`` in all."""
    rates, left = {}, most
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(counts) - i))
        rates[lang] = take / n
        left -= take
    return rates


def training_rows(docs: DataFrame, most: int = TRAIN_DOCUMENTS, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Labelled rows that are not held out, about ``most`` of them: of each language those whose hash lies below its
    limit. ``_weight`` tells for how many documents of its language a row stands.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if sum(counts.values()) <= most:
        return labelled.withColumn("_weight", F.lit(1.0))
    # A literal map, as a join would shuffle the texts.
    rate = F.create_map(*[F.lit(x) for pair in shares(counts, most).items() for x in pair])[F.col(lang_col)]
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    return labelled.where(place < rate * (1 << 30)).withColumn("_weight", 1 / rate)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, matrix = train(training_rows(docs))
    told = annotate(docs.select("doc_id", "text"), langs, matrix)
    return told.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
