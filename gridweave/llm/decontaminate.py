"""Benchmark decontamination with suffix arrays over shards of the training texts.

Every task cuts its documents into shards of ``SHARD_BYTES`` of text and builds a suffix array over the words of
each: suffixes are sorted by prefix doubling, down to the length of the longest benchmark item, which is all
that a search can tell apart. Every suffix of every benchmark item is then looked up by binary search, which
gives the range of its occurrences; each is extended to the longest verbatim match. Documents stay where they
are: the only data sent around are the benchmark's words, in blocks of at most ``BLOCK_BYTES``.

Only the pairs that begin a longest match are made, so words that repeat many times in an item and in a text cost no
more than the matches they have.

A word that no item holds ends every match, so only runs of benchmark words that are long enough for a match
enter the array.

Words are runs of digits, a-z after lower-casing A-Z, and characters beyond ASCII. A window is ``window``
consecutive words of an item; an item with fewer words, but not none, is one window.

Defined results: a NULL or empty text has no words and no matches; items without words match nothing; items with
a NULL id are searched but not listed; repeated rows stay repeated; an empty table gives an empty result, an
empty benchmark leaves every document clean; other columns are not looked at (:func:`decontaminate` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .batches import slices, texts_of, tidy
from .registry import query

#: Bytes of text in one suffix array, and of benchmark text in one block.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20
WINDOW = 10

# Letters and digits stay (A-Z lower-cased), bytes beyond ASCII stay, all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Benchmark:
    """The items of one block as word numbers from 1, all in one array, each followed by a 0."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.ids, sizes, flat = [], [], []
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                self.ids.append(item_id)
                sizes.append(len(words))
                flat += [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words] + [0]
        size = np.array(sizes, np.int64)
        self.words = np.array(flat, np.int64)
        self.longest = int(size.max()) if sizes else 0
        self.shortest = int(min(size.min(), window)) if sizes else 0
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if sizes else size
        # Windows: their place in ``words``, their length, the item, and the words up to the item's end.
        count = np.maximum(size - window, 0) + 1
        self.item = np.repeat(np.arange(len(size)), count)
        self.item_start = start
        self.at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.length = np.minimum(size, window)[self.item]
        self.left = start[self.item] + size[self.item] - self.at
        self.bits = max(1, int(len(self.numbers)).bit_length())

    def of_text(self, text: str) -> np.ndarray:
        words = words_of(text)
        get = self.numbers.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def packed(words: np.ndarray, at: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n words at each place in one number, zeros from the first 0 on; ``words`` ends in n zeros."""
    key, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for i in range(n):
        word = words[at + i]
        alive &= word > 0
        key = (key << bits) | np.where(alive, word, 0)
    return key


def common_length(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from the two places on are equal and known, up to ``most``."""
    n, live = np.zeros(len(at_a), np.int64), np.arange(len(at_a))
    while len(live):
        live = live[n[live] < most[live]]
        x, y = a[at_a[live] + n[live]], b[at_b[live] + n[live]]
        live = live[(x == y) & (x > 0)]
        n[live] += 1
    return n


class SuffixArray:
    """The suffixes of a shard in order, compared on their first ``depth`` words or up to the first 0."""

    def __init__(self, words: np.ndarray, at: np.ndarray, bits: int, depth: int) -> None:
        self.first = max(1, min(depth, 62 // bits))
        self.words = np.concatenate([words, np.zeros(max(depth, self.first) + 1, np.int64)])
        key = packed(self.words, at, bits, self.first)
        self.run_end = np.flatnonzero(self.words == 0)
        order = np.argsort(key, kind="stable")
        self.sorted, self.keys = at[order], key[order]
        rank = np.zeros(len(self.words) + depth, np.int64)  # 0: past the end of a run
        self._number(rank, self.keys)
        known = self.first
        while known < depth:
            group = rank[self.sorted]
            tied = np.flatnonzero(np.concatenate([group[1:] == group[:-1], [False]]) | np.concatenate([[False], group[1:] == group[:-1]]))
            if not len(tied):
                break
            places = self.sorted[tied]
            # Tied suffixes agree on ``known`` words; where those hold a 0 the rest has no rank and they stay equal.
            after = np.where(self._unbroken(places, known), rank[places + known], 0)
            by = np.lexsort((after, group[tied]))
            self.sorted[tied] = places[by]
            follow = np.zeros(len(self.sorted), np.int64)
            follow[tied] = after[by]
            self._number(rank, group, follow)
            known *= 2

    def _unbroken(self, places: np.ndarray, n: int) -> np.ndarray:
        return self.run_end[np.searchsorted(self.run_end, places)] - places >= n

    def _number(self, rank: np.ndarray, *keys: np.ndarray) -> None:
        if len(self.sorted):
            new = np.ones(len(self.sorted), np.int64)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            rank[self.sorted] = np.cumsum(new)

    def ranges(self, other: np.ndarray, at: np.ndarray, length: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``other``: the range of suffixes that begin with its first ``length`` words."""
        head = np.minimum(length, self.first)
        key = packed(other, at, bits, self.first)
        rest = (self.first - head) * bits
        low = np.searchsorted(self.keys, (key >> rest) << rest)
        high = np.searchsorted(self.keys, (((key >> rest) + 1) << rest) - 1, side="right")
        more = np.flatnonzero((high > low) & (length > self.first))
        for upper in (False, True):
            a, b = low[more].copy(), high[more].copy()
            while (a < b).any():
                middle = (a + b) // 2
                open_ = a < b
                place = self.sorted[np.minimum(middle, len(self.sorted) - 1)]
                same = common_length(self.words, place, other, at[more], length[more])
                full = same >= length[more]
                here = self.words[place + np.minimum(same, length[more] - 1)]
                there = other[at[more] + np.minimum(same, length[more] - 1)]
                # The suffix comes before the range (lower end) or not after it (upper end).
                before = np.where(full, upper, here < there)
                a = np.where(open_ & before, middle + 1, a)
                b = np.where(open_ & ~before, middle, b)
            (high if upper else low)[more] = a
        return low, high


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def maximal_pairs(suffixes: SuffixArray, benchmark: Benchmark, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows and places that match and whose words just before do not: those begin a longest match.

    Only these pairs are made. Places of equal windows are put in order of the word before them, so those before which
    a window's own word stands are one range that is left out; a window that opens its item keeps all places.
    """
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return hit, hit
    spans, of_hit = np.unique(np.stack([low[hit], high[hit]], axis=1), axis=0, return_inverse=True)
    of_hit = of_hit.reshape(-1)
    size = spans[:, 1] - spans[:, 0]
    place = suffixes.sorted[_ranges(spans[:, 0], size)]
    span = np.repeat(np.arange(len(spans)), size)
    before = np.where(place > 0, suffixes.words[place - 1], 0)
    order = np.lexsort((place, before, span))
    place, key = place[order], (span * (len(benchmark.numbers) + 1) + before)[order]
    start = np.cumsum(size) - size
    at = benchmark.at[hit]
    opens = at == benchmark.item_start[benchmark.item[hit]]
    own = of_hit * (len(benchmark.numbers) + 1) + benchmark.words[np.maximum(at - 1, 0)]
    begin, end = start[of_hit], start[of_hit] + size[of_hit]
    left, right = np.searchsorted(key, own), np.searchsorted(key, own, "right")
    left, right = np.where(opens, end, left), np.where(opens, end, right)
    window = np.concatenate([np.repeat(hit, left - begin), np.repeat(hit, end - right)])
    chosen = np.concatenate([_ranges(begin, left - begin), _ranges(right, end - right)])
    return window, place[chosen]


def find(benchmark: Benchmark, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word counts of the texts, and all longest matches by text, a row each: text, item, word in the item, word in the
    text, length."""
    parts = [benchmark.of_text(t) for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    none = np.zeros((0, 5), np.int64)
    if not len(benchmark.at) or not counts.sum():
        return counts, none
    gap = np.zeros(1, np.int64)
    words = np.concatenate([x for p in parts for x in (p, gap)])
    zeros = np.flatnonzero(words == 0)
    run = np.diff(np.concatenate([[-1], zeros])) - 1
    long_runs = run >= benchmark.shortest
    starts, sizes = (zeros - run)[long_runs], run[long_runs]
    if not len(starts):
        return counts, none
    suffixes = SuffixArray(words, _ranges(starts, sizes), benchmark.bits, benchmark.longest)
    other = np.concatenate([benchmark.words, np.zeros(suffixes.first + 1, np.int64)])
    low, high = suffixes.ranges(other, benchmark.at, benchmark.length, benchmark.bits)
    window, place = maximal_pairs(suffixes, benchmark, low, high)
    length = common_length(suffixes.words, place, other, benchmark.at[window], benchmark.left[window])
    text_start = np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
    text = np.searchsorted(text_start, place, side="right") - 1
    item = benchmark.item[window]
    found = np.stack([text, item, benchmark.at[window] - benchmark.item_start[item], place - text_start[text], length], axis=1)
    return counts, found[np.lexsort((found[:, 3], found[:, 0]))]


def benchmark_blocks(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str | None, str]]]:
    """The items in blocks of about BLOCK_BYTES each; a block is what a task holds, and what is sent to it."""
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-2 * total // BLOCK_BYTES) if total > BLOCK_BYTES else 1
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield [(r["id"], r["text"]) for r in part.collect()]


MATCHES = "array<struct<item_id: string, item_word: int, doc_word: int, length: int>>"
MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("length", pa.int32())])


def match_lists(benchmark: Benchmark, matches: np.ndarray, texts: int) -> pa.Array:
    """The matches of each text as a list column."""
    columns = [pa.array(benchmark.ids, pa.string()).take(pa.array(matches[:, 1])),
               *[pa.array(matches[:, i].astype(np.int32)) for i in (2, 3, 4)]]
    offsets = np.searchsorted(matches[:, 0], np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(MATCH)))


def _search(docs: DataFrame, block: list[tuple[str | None, str]], window: int) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(shipped.value, window)
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(texts, map(len, texts), SHARD_BYTES):
                counts, matches = find(benchmark, texts[a:b])
                given = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([given.column("doc_id"), given.column("text_hash"), pa.array(counts),
                                                  match_lists(benchmark, matches, b - a)], ["doc_id", "text_hash", "n_words", "matches"])

    return docs.mapInArrow(tidy(run), f"doc_id bigint, text_hash bigint, n_words bigint, matches {MATCHES}")


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, matches``; a match is a longest verbatim one of at
    least a window: item_id, its first word in the item and in the document, its words.

    A benchmark of several blocks takes one pass over the documents for each.
    """
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    out = None
    for block in benchmark_blocks(items, item_id_col, item_text_col):
        found = _search(narrow, block, window)
        if out is None:
            out = found
            continue
        more = (found.where(F.size("matches") > 0).dropDuplicates(["doc_id", "text_hash"])
                .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("matches").alias("more")))
        out = (out.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
               .select("doc_id", "text_hash", "n_words", F.concat("matches", F.coalesce("more", F.array().cast(MATCHES))).alias("matches")))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window of any item occurs."""
    out = docs
    for i, block in enumerate(benchmark_blocks(items, item_id_col, item_text_col)):
        if i:    # a worker for one block at a time
            out = settle(out, "decontaminated")
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            benchmark = Benchmark(shipped.value, window)
            for batch in batches:
                texts, clean = texts_of(batch, text_col), np.ones(batch.num_rows, bool)
                for a, b in slices(texts, map(len, texts), SHARD_BYTES):
                    clean[a + find(benchmark, texts[a:b])[1][:, 0]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(tidy(run), out.schema)
    return out


def hit_words(matches):
    """How many words of the document lie inside some match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["b"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")), lambda acc: acc["n"])


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (SELECT item_id, words[i + 1:i + 10] AS span FROM (
    SELECT item_id, words, unnest(range(greatest(len(words) - 10, 0) + 1)) AS i FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT len(span) AS n FROM windows),
spots AS (SELECT row, n, i, words[i + 1:i + n] AS span FROM (
    SELECT row, words, n, unnest(range(len(words) - n + 1)) AS i FROM docs, lengths WHERE len(words) >= n)),
hits AS (SELECT s.row, s.i, s.n, w.item_id FROM spots s JOIN windows w ON s.span = w.span),
hit_words AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY row),
hit_items AS (SELECT row, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
    FROM hits GROUP BY row)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.row = d.row LEFT JOIN hit_items i ON i.row = d.row
"""


@query("op1_decontamination", SQL)
def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = find_matches(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    n_hit = hit_words(F.col("matches"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
