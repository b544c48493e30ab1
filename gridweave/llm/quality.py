"""Quality by weak supervision: rules vote or abstain, and their votes are weighed by how reliable they are.

Every rule looks at one figure of a text and votes good, bad, or not at all. Documents with the same votes are
counted together, so all that the estimation needs is at most 3^(number of rules) counts over all documents.
Expectation-maximisation on these counts estimates, for good and for bad documents, how often each rule votes
which way, and how many documents are good. A document is kept if the posterior probability that it is good
reaches ``threshold``; no single rule decides.

Words are runs of characters other than white space; a text fails beforehand with fewer than ``MIN_WORDS`` words,
or if more than half of its words stand in 3-word windows that occur twice or more in it.

Defined results: a NULL or empty text has no words and fails; repeated rows stay repeated; an empty table gives an
empty result; other columns are not looked at (:func:`filter_documents` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .batches import slices, texts_of, tidy
from .registry import query
from .wordhash import mix, runs, word_hashes

MIN_WORDS, WINDOW = 50, 3
BATCH_CHARS = 2 << 20
GOOD, BAD, NONE = 1, 0, 2
#: Share of good documents that the estimation starts from.
PRIOR = 0.85

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_letters",
           "n_digits", "n_exclaims", "n_marks", "n_fresh_windows"]


def repeated_words(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many words lie in a window of WINDOW words that occurs twice or more in that text, and how
    many different windows there are."""
    text = np.repeat(np.arange(len(counts)), counts)
    window = runs(words, WINDOW)
    if not len(window):
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    inside = np.flatnonzero(text[:len(window)] == text[WINDOW - 1:])
    key = mix(window[inside] + mix(text[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    fresh = np.ones(len(key), bool)
    fresh[order[1:][same]] = False
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[inside[twice] + i] = True
    return np.bincount(text[covered], minlength=len(counts)), np.bincount(text[inside[fresh]], minlength=len(counts))


def figures(texts: list[str]) -> list[list[int]]:
    """The FIGURES of some texts, column by column."""
    words, counts = word_hashes(texts)
    repeated, fresh = repeated_words(words, counts)
    out: list[list[int]] = [counts.tolist(), [], [], [], repeated.tolist(), [], [], [], [], [], [], [], fresh.tolist()]
    without = lambda data, chars: len(data) - len(data.translate(None, chars))
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
        ended = sum(line.rstrip(" \t\v\f\r\"')").endswith((".", "!", "?", "…", ":", ";")) for line in lines)
        row = (len(text) - without(data, _SPACES), without(data, _SYMBOLS), len(lines) - len(set(lines)), len(lines), ended,
               without(data, _UPPER), without(data, _LETTERS), without(data, _DIGITS), data.count(b"!"), without(data, _MARKS))
        for column, value in zip((1, 2, 3, 5, 6, 7, 8, 9, 10, 11), row, strict=True):
            out[column].append(value)
    return out


@dataclass(frozen=True)
class Rule:
    """Votes on a ratio of two figures: good below one limit, bad above another, else not at all; it abstains on
    texts of fewer than ``least`` of the second figure."""

    name: str
    part: str
    whole: str
    good_below: float
    bad_above: float
    least: int = 20
    good_above: float | None = None
    bad_below: float | None = None

    def vote(self) -> Column:
        ratio = F.col(self.part) / F.greatest(F.col(self.whole), F.lit(1))
        good, bad = ratio <= self.good_below, ratio > self.bad_above
        if self.good_above is not None:
            good = good & (ratio >= self.good_above)
        if self.bad_below is not None:
            bad = bad | (ratio < self.bad_below)
        return (F.when(F.col(self.whole) < self.least, NONE).when(bad, BAD).when(good, GOOD).otherwise(NONE))


# Each kind of bad text is in reach of two rules or more, as the estimation learns from rules that agree.
RULES = [
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.05),
    Rule("punctuation", "n_marks", "n_words", 0.35, 0.45),
    Rule("line ends", "n_ended_lines", "n_lines", 1.0, 1.0, least=1, good_above=0.8, bad_below=0.5),
    Rule("capitals", "n_upper", "n_letters", 0.15, 0.4),
    Rule("exclamations", "n_exclaims", "n_words", 0.05, 0.2),
    Rule("repeats", "n_repeat_words", "n_words", 0.15, 0.35),
    Rule("fresh windows", "n_fresh_windows", "n_words", 1.0, 1.0, good_above=0.85, bad_below=0.7),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.1, 0.35, least=4),
    Rule("word length", "word_chars", "n_words", 6.5, 7.0, good_above=3.5, bad_below=2.5),
    Rule("digits", "n_digits", "word_chars", 0.05, 0.2, least=100),
]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with FIGURES as further columns (columns of these names are replaced)."""
    kept = docs.drop(*FIGURES)
    schema = T.StructType(kept.schema.fields + [T.StructField(n, T.LongType()) for n in FIGURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_col)
            columns: list[list[int]] = [[] for _ in FIGURES]
            for a, b in slices(texts, map(len, texts), BATCH_CHARS):
                for column, more in zip(columns, figures(texts[a:b]), strict=True):
                    column += more
            for name, column in zip(FIGURES, columns, strict=True):
                batch = batch.append_column(name, pa.array(column, pa.int64()))
            yield batch

    return kept.mapInArrow(tidy(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ballot(rules: Sequence[Rule]) -> Column:
    """The votes of all rules as one number, in base 3."""
    code = F.lit(0)
    for rule in rules:
        code = code * 3 + rule.vote()
    return code


def votes_of(codes: np.ndarray, n: int) -> np.ndarray:
    return np.stack([(codes // 3 ** (n - 1 - i)) % 3 for i in range(n)], axis=1)


class VoteModel:
    """Two classes of documents, and for each how a rule votes when it does."""

    def __init__(self, n_rules: int) -> None:
        # Before any data: a bad vote is very rare on good documents; a bad document fails one or two rules of many.
        self.prior = PRIOR
        self.bad_vote = np.tile([[0.15], [0.002]], n_rules)  # by class (BAD, GOOD) and rule

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that a document with these votes is good; abstentions say nothing."""
        bad, good = votes == BAD, votes == GOOD
        score = [bad @ np.log(p) + good @ np.log1p(-p) for p in self.bad_vote]
        odds = score[GOOD] - score[BAD] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 100, weight: float = 5.0) -> VoteModel:
        """Expectation-maximisation; the start values count as ``weight`` documents of each class."""
        start = self.bad_vote.copy()
        for _ in range(rounds):
            good = self.posterior(votes)
            share = {GOOD: good * counts, BAD: (1 - good) * counts}
            self.prior = float(np.clip((share[GOOD].sum() + PRIOR * weight) / (counts.sum() + weight), 1e-4, 1 - 1e-4))
            for k in (BAD, GOOD):
                bad = share[k] @ (votes == BAD)
                cast = share[k] @ (votes != NONE)
                self.bad_vote[k] = np.clip((bad + start[k] * weight) / (cast + weight), 1e-6, 1 - 1e-6)
            # A rule is no worse than a coin: it votes bad at least as often on bad documents.
            self.bad_vote[BAD] = np.maximum(self.bad_vote[BAD], self.bad_vote[GOOD])
        return self


def fit_votes(measured: DataFrame, rules: Sequence[Rule] = RULES) -> dict[int, float]:
    """The posterior of every pattern of votes that occurs, at most 3^rules of them."""
    rows = measured.groupBy(ballot(rules).alias("code")).agg(F.count("*").alias("n")).collect()
    codes, counts = np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
    if not len(codes):
        return {}
    votes = votes_of(codes, len(rules))
    return dict(zip(codes.tolist(), VoteModel(len(rules)).fit(votes, counts).posterior(votes).tolist(), strict=True))


def judge(measured: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``quality`` (the posterior) and ``kept`` to measured rows."""
    posterior = fit_votes(measured, rules)
    pairs = [x for code, p in sorted(posterior.items()) for x in (F.lit(code), F.lit(p))]
    quality = F.coalesce(F.element_at(F.create_map(*pairs), ballot(rules)), F.lit(0.0)) if pairs else F.lit(0.0)
    return measured.select("*", base_failed().alias("base_failed"), quality.alias("quality")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def filter_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns they came with. Texts are measured twice rather than stored."""
    posterior = fit_votes(measure(docs.select(text_col), text_col), rules)
    good = [code for code, p in posterior.items() if p >= threshold]
    clashing = {n: f"{n} as it came" for n in docs.columns if n in FIGURES}
    measured = measure(docs.withColumnsRenamed(clashing), text_col)
    kept = measured.where(~base_failed() & ballot(rules).isin(good))
    return kept.select(*[F.col(f"`{clashing.get(c, c)}`").alias(c) for c in docs.columns])


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    measured = settle(measure(docs).drop("text"), "op6-figures")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                  F.round("quality", 6).alias("quality"))


