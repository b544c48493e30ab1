"""Collocations by Toivonen's method: a sample proposes frequent phrases, full passes count them and their border.

A phrase is a run of 2 to 4 words inside a piece of text. The set S of proposed phrases (words included) comes from a
sample of the documents, mined level by level at a lowered threshold. The full pass counts, over all documents, every
phrase whose first words and whose last words (all but one) are in S: these are the phrases of S and its negative
border. If a border phrase of at most 3 words turns out to be frequent, S has missed it; S grows by all such phrases,
and an expansion pass counts only the phrases that thereby became candidates, and those that have such new candidates
for parts, as these may be frequent too. A frequent phrase has frequent parts, each of them either counted in the full
pass, so that it is in S by now, or a new candidate itself; so every frequent phrase has been counted exactly,
whatever the sample was. The sample only decides how much the expansion pass finds, and whether it is needed.

Tasks ask S through a Bloom filter of at most ``FILTER_BYTES``, so what is broadcast has a fixed bound however many
phrases are frequent; a false positive makes a phrase be counted that need not be, and nothing else. Each task numbers
the words and phrases of about ``CHUNK`` bytes of text, counts them there and passes on one row for each; copies of a
text or a frequent word thus become one row a chunk. Counts are keyed by the phrase itself, never by a hash.

Defined results: a NULL text is empty, a NULL lang is ``und``; copies and repeated rows count every time; a text is
taken in chunks that are cut between words and hold the next three words too, so one of any length is counted whole; equal scores are ordered by frequency, then by the phrase's bytes; an empty table
gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle, shuffle_width
from . import wordhash
from .batches import tidy
from .registry import query

LONGEST, LEAST, TOP, COVERED = 4, 30, 2000, 80
#: One of so many documents is sampled; the threshold there is so many standard deviations below what is expected. More
#: caution proposes more that is not frequent, less leaves more to the further passes.
SAMPLE, CAUTION = 4, 0.5
#: Bytes of text that a task numbers at a time, and the most bytes of the Bloom filter.
CHUNK, FILTER_BYTES = 8 << 20, 16 << 20
#: Rows of a batch that a task passes on.
ROWS = 1 << 16
#: Rows gathered into one group on the way to the first rows of a language.
FAN_IN = 16

# A-Z become a-z, the ends of pieces a line break, white space inside a piece a space.
_TABLE = bytes(10 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b in (9, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNTS = "lang string, words int, phrase string, n bigint"
_SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
_SALT = np.uint64(0xA24BAED4963EE407)
_STEP = np.uint64(0x9FB21C651E98DF25)


# ---- hashes and the filter

def lang_hashes(langs: list[str]) -> np.ndarray:
    """A number for each language's name."""
    words = " ".join("l" + name.encode("utf-8", "surrogatepass").hex() for name in langs)
    return wordhash.mix(wordhash.word_hashes([words])[0] + _SALT)


def joined_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of all its words but the last, and of the last."""
    return wordhash.mix(first * _STEP + last)


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The hashes of whole phrases, each with its language."""
    if not phrases:
        return np.zeros(0, np.uint64)
    words, sizes = wordhash.word_hashes(phrases)
    distinct = {name: i for i, name in enumerate(dict.fromkeys(langs))}
    tongue = np.repeat(lang_hashes(list(distinct))[[distinct[name] for name in langs]], sizes)
    words = wordhash.mix(words ^ tongue)
    start = np.cumsum(sizes) - sizes
    out = words[start]
    for k in range(1, int(sizes.max())):
        more = sizes > k
        out[more] = joined_hash(out[more], words[start[more] + k])
    return out


class Filter:
    """A Bloom filter of 64-bit hashes with two probes, over a power of two of bytes."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.mask = cells, np.uint64(len(cells) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            found &= (self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def filter_size(n: int) -> int:
    """Bytes for n hashes: a power of two, 16 to 32 bits each, within the bound."""
    return min(FILTER_BYTES, 1 << max(10, (2 * n).bit_length()))


def build_filter(hashes: DataFrame, size: int) -> np.ndarray:
    """The filter of the column ``hash``: Spark merges its 64-bit cells, of which there are at most an eighth of ``size``."""
    probes = F.array(F.col("hash").bitwiseAND(size * 8 - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(size * 8 - 1))
    cells = (hashes.select(F.explode(probes).alias("at")).groupBy(F.shiftright("at", 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow())
    out = np.zeros(size // 8, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy()
    return out.view(np.uint8)


# ---- counting in a task

def parts_of(data: bytes, most: int, ahead: int) -> Iterator[tuple[bytes, int]]:
    """A text, with piece ends as line breaks, in parts of about ``most`` bytes: each with the next ``ahead`` words,
    and the number of bytes that are its own."""
    start = 0
    while len(data) - start > most + most // 4:
        own = start + most
        while own < len(data) and data[own] not in b" \n":
            own += 1
        end = own
        for _ in range(ahead):
            while end < len(data) and data[end] in b" \n":
                end += 1
            while end < len(data) and data[end] not in b" \n":
                end += 1
        yield data[start:end], own - start
        start = own
    yield data[start:], len(data) - start


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the distinct values, in order of their first place, and those values."""
    coded = pc.dictionary_encode(values)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Chunk:
    """Parts of texts as one run of numbered words; the same word has another number in another language."""

    def __init__(self, parts: list[tuple[int, bytes, int]], langs: list[str]) -> None:
        data = np.frombuffer(b"\n".join(t for _, t, _ in parts) + b"\n", np.uint8)
        solid = (data != 32) & (data != 10)
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        edges = np.concatenate([[0], edges]) if solid[0] else edges
        begin, size = edges[0::2], edges[1::2] - edges[0::2]
        self.n = len(begin)
        if not self.n:
            return
        ends = np.cumsum([len(t) + 1 for _, t, _ in parts])
        of_part = np.diff(np.searchsorted(begin, ends), prepend=0)
        lang = np.repeat([k for k, _, _ in parts], of_part)
        self.own = begin < np.repeat(ends - [len(t) + 1 - own for _, t, own in parts], of_part)
        # whether a piece ends between a word and the next one
        upto = np.searchsorted(begin, np.flatnonzero(data == 10))
        self.last = np.zeros(self.n, bool)
        self.last[upto[upto > 0] - 1] = True
        offsets = np.concatenate([[0], np.cumsum(size)])
        plain, words = _codes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [
            None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[solid]))]))
        if len(langs) == 1:
            self.word, self.lang_of, of_word = plain, np.zeros(len(words), np.int64), slice(None)
        else:
            self.word, told = _codes(pa.array(lang * len(words) + plain))
            told = told.to_numpy(zero_copy_only=False)
            self.lang_of, of_word = told // len(words), told % len(words)
        hashes = wordhash.word_hashes([b" ".join(words.to_pylist()).decode("utf-8")])[0]
        self.hash = wordhash.mix(hashes[of_word] ^ lang_hashes(langs)[self.lang_of])
        # all words with one space after each, to take phrases from
        self.upto = np.concatenate([[0], np.cumsum(size + 1)])
        solid[begin + size] = True
        self.spaced = data[solid]
        self.spaced[self.upto[1:] - 1] = 32

    def texts(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that start at the given words."""
        out = []
        for a in range(0, len(at), 1 << 17):
            start = self.upto[at[a:a + (1 << 17)]]
            size = self.upto[at[a:a + (1 << 17)] + words] - 1 - start
            offsets = np.concatenate([[0], np.cumsum(size)])
            letters = self.spaced[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]))
        return pa.concat_arrays(out).cast(pa.large_string()).cast(pa.string())

    def counts(self, new: Filter | None, old: Filter | None, levels: range) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``words, first places, counts, languages`` of the candidates of each level.

        Candidates have both parts in ``new``. With ``old``, those that had both parts there have been counted before; and
        as whether a new candidate is frequent is not known yet, it may be a part as well."""
        ids, hashes, lang_of = self.word, self.hash, self.lang_of
        at = np.arange(self.n)    # the places where the phrases of the level start, and their numbers
        for words in range(1, levels.stop):
            if words == 1:
                fresh = np.full(len(hashes), old is None)
            else:
                ok, was = new.has(hashes), None
                if old is not None:    # counted before: both parts were in the old filter, and counted themselves
                    was = old.has(hashes) & ~fresh
                    ok |= fresh
                here, there = np.full(self.n, -1), np.full(self.n, -1)
                here[at] = ids
                there[:-1] = here[1:]
                there[self.last] = -1
                at = at[(here[at] >= 0) & (there[at] >= 0)]
                first, last = here[at], there[at]
                keep = ok[first] & ok[last]
                at, first, last = at[keep], first[keep], last[keep]
                if not len(at):
                    return
                before = was[first] & was[last] if was is not None else np.zeros(len(at), bool)
                ids, pairs = _codes(pa.array(first * len(self.hash) + self.word[at + words - 1]))
                pairs = pairs.to_numpy(zero_copy_only=False)
                hashes = joined_hash(hashes[pairs // len(self.hash)], self.hash[pairs % len(self.hash)])
                lang_of = lang_of[pairs // len(self.hash)]
                fresh = np.zeros(len(hashes), bool)
                fresh[ids] = ~before
            if words in levels:
                n = np.bincount(ids[self.own[at]], minlength=len(hashes))
                place = np.zeros(len(hashes), np.int64)
                place[ids[::-1]] = at[::-1]
                shown = np.flatnonzero(fresh & (n > 0))
                yield words, place[shown], n[shown], lang_of[shown]


def counter(new: Callable[[], np.ndarray] | None, old: Callable[[], np.ndarray] | None, levels: range,
            totals: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ``lang, text`` to counts per chunk; with ``totals`` also the number of words, as phrases of none."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Filter(f()) if f is not None else None for f in (new, old)]

        def count(parts: list[tuple[int, bytes, int]], langs: list[str]) -> Iterator[pa.RecordBatch]:
            chunk = Chunk(parts, langs)
            if not chunk.n:
                return
            names = pa.array(langs, pa.string())

            def rows(words: int, phrases: pa.Array, n: np.ndarray, lang: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([names.take(pa.array(lang)), pa.array(np.full(len(n), words, np.int32)), phrases,
                                                   pa.array(n.astype(np.int64))], schema=_SCHEMA)
            if totals:
                n = np.bincount(chunk.lang_of[chunk.word[chunk.own]], minlength=len(langs))
                yield rows(0, pa.array([""] * len(langs), pa.string()), n, np.arange(len(langs)))
            for words, place, n, lang in chunk.counts(*asked, levels):
                for a in range(0, len(place), ROWS):
                    b = a + ROWS
                    yield rows(words, chunk.texts(place[a:b], words), n[a:b], lang[a:b])

        held, size, langs = [], 0, {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data = text.as_buffer().to_pybytes().translate(_TABLE)
                for part, own in parts_of(data, CHUNK, LONGEST - 1):
                    held.append((langs.setdefault(lang, len(langs)), part, own))
                    size += len(part)
                    if size >= CHUNK:
                        yield from count(held, list(langs))
                        held, size, langs = [], 0, {}
        if held:
            yield from count(held, list(langs))
    return run


# ---- the search

def texts_by_lang(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") > 0)


def count_phrases(texts: DataFrame, least: int, new: np.ndarray | None, old: np.ndarray | None, levels: range, totals: bool = False) -> DataFrame:
    """``lang, words, phrase, n, hash, known`` of the candidates found at least so often; ``known``: in the filter ``new``.

    Tasks have added up their chunks, so rows go to the shuffle as they are; a phrase sends one for a chunk."""
    context = texts.sparkSession.sparkContext
    sent = [context.broadcast(f) if f is not None else None for f in (new, old)]
    ask = [(lambda b=b: b.value) if b is not None else None for b in sent]
    found = texts.select("lang", "text").mapInArrow(tidy(counter(*ask, levels, totals)), _COUNTS)
    width = shuffle_width(texts.sparkSession)
    found = found.repartition(width, "lang", "words", "phrase").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(ask[0]()) if ask[0] is not None else None
        for batch in batches:
            phrases = batch.column("phrase").to_pylist()
            h = phrase_hashes(batch.column("lang").to_pylist(), [p or "-" for p in phrases])
            flags = known.has(h) if known is not None else np.zeros(len(h), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64)), pa.array(flags)], names=[*batch.schema.names, "hash", "known"])
    return found.mapInArrow(tidy(hashed), _COUNTS + ", hash bigint, known boolean")


def propose(texts: DataFrame, least: int, sample: int = SAMPLE) -> np.ndarray:
    """The filter of the phrases of up to 3 words that are frequent in the sample."""
    chosen = settle(texts.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0).select("lang", "text"), "op11-sample")
    mean = least / sample
    enough = max(1, int(mean - CAUTION * mean ** 0.5))
    every, bits = None, None
    for words in range(1, LONGEST):
        level = settle(count_phrases(chosen, enough, bits, None, range(words, words + 1)), "op11-proposed")
        every = level if every is None else every.unionAll(level)
        bits = build_filter(every, filter_size(every.count()))
    return bits


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """``lang, words, phrase, n`` of all phrases of up to 4 words with ``n >= least``, and the number of words of each
    language as a phrase of none."""
    texts = texts_by_lang(docs, id_col, text_col, lang_col)
    proposed = propose(texts, least, sample)
    found = settle(count_phrases(texts, least, proposed, None, range(1, LONGEST + 1), totals=True), "op11-counted")
    missed = found.where(~F.col("known") & F.col("words").between(1, LONGEST - 1))
    if not missed.isEmpty():
        wider = proposed | build_filter(missed, len(proposed))
        found = found.unionAll(settle(count_phrases(texts, least, wider, proposed, range(2, LONGEST + 1)), "op11-expanded"))
    return found.select("lang", "words", "phrase", "n")


# ---- scores

def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """``lang, words, phrase, a, l, r, score`` of the phrases of 2 words or more: of all cuts in two, the one with the
    lowest score ``floor(2000000 a / (l + r))``, the earliest among equals. Sums and products are decimal."""
    counts = frequent.where(F.col("words") > 0).select("lang", "phrase", "n")
    parts = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = (frequent.where(F.col("words") > 1).select("lang", "words", "phrase", F.col("n").alias("a"), cut.alias("k"))
            .select("*", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"),
                    F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right")))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = cuts.select("*", score.alias("score")).groupBy("lang", "words", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    return best.select("lang", "words", "phrase", "best.a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates that no longer candidate holds inside it at least ``covered`` per cent as often."""
    parts = F.split("phrase", " ")
    places = F.explode(F.expr(f"""filter(flatten(transform(sequence(2, {LONGEST - 1}), m -> transform(sequence(1, {LONGEST - 1}),
        i -> named_struct('m', m, 'i', i)))), p -> p.m < words AND p.i + p.m - 1 <= words)"""))
    inside = (candidates.where(F.col("words") > 2).select("lang", "phrase", "words", "a", places.alias("p"))
              .select("lang", "a", F.array_join(F.slice(parts, F.col("p.i"), F.col("p.m")), " ").alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    hidden = F.coalesce(_exact(F.col("longer")) * 100 >= _exact("a") * covered, F.lit(False))
    return candidates.join(inside, ["lang", "phrase"], "left").where(~hidden).drop("longer")


def best_of_each(rows: DataFrame, key: str, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows of every key with their ``rank``: first in small groups dealt by hash, then among what is
    left of ``FAN_IN`` groups at a time, so that no task holds much more than ``FAN_IN * top`` rows of a key at the end."""
    groups = 1
    while groups < shuffle_width(rows.sparkSession):
        groups *= FAN_IN
    out = rows.withColumn("_group", F.pmod(F.xxhash64(*rows.columns), F.lit(groups)))
    while True:
        at = F.row_number().over(W.partitionBy(key, "_group").orderBy(*order))
        out = out.withColumn("rank", at).where(F.col("rank") <= top)
        if groups == 1:
            return out.drop("_group")
        groups //= FAN_IN
        out = out.drop("rank").withColumn("_group", F.pmod(F.col("_group"), F.lit(groups)))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, sample: int = SAMPLE,
                 id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of every language."""
    frequent = frequent_phrases(docs, least, sample, id_col, text_col, lang_col)
    left = uncovered(settle(scored(frequent), "op11-scored"), covered)
    ranked = best_of_each(left, "lang", top, F.desc("score"), F.desc("a"), F.asc("phrase"))
    totals = frequent.where(F.col("words") == 0).select("lang", "n")
    return (ranked.join(totals, "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


@query("op11_phrase_mining")
def op11_phrase_mining(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf}/documents.parquet"))
