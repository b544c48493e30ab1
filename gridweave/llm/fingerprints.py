"""Document fingerprints by one-permutation MinHash, in DataFrame expressions only.

Every run of five words is hashed once. The seven highest bits of the hash deal it to one of 128 bins, and each bin
keeps its smallest hash. An empty bin is filled by optimal densification: it asks the other bins in a random order of its own,
the same in all documents, and takes the value of the first that is not empty. Of each bin the eight lowest bits are stored, eight bins to a 64-bit integer: 128 bytes a
document. Two fingerprints agree in a bin with probability J + (1 - J) / 256, J being the Jaccard similarity of the
shingle sets; :func:`likeness` solves that for J. Its standard error is at most 0.045.

Nothing is grouped by content, so groups of copies of any size cost no more than other documents. A fingerprint is
one expression over one text.

Defined results: a NULL text is an empty one; a text of fewer than five words has one shingle, the whole sequence;
a text without words has the empty fingerprint ``''``, whose likeness is 1 to another empty one and 0 to all others;
equal texts, and so repeated rows, have equal fingerprints; a text of any length is taken whole; an empty table gives
an empty result; columns with clashing names are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequence import block_bounds, block_of
from .registry import query

SHINGLE = 5
BIN_BITS, LOW_BITS = 7, 8
BINS = 1 << BIN_BITS
PER_LONG = 64 // LOW_BITS
LONGS = BINS // PER_LONG
#: The orders in which empty bins ask the others come from this seed; so many are tried before all others are compared.
SEED, TRIES = 20130, 8
#: White space between words, as in `[^\x20\x09-\x0D]+`.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"

_REST = (1 << 64 - BIN_BITS) - 1
_LOW = (1 << LOW_BITS) - 1
_ONES = sum(1 << LOW_BITS * i for i in range(PER_LONG))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """The 64-bit hashes of all runs of ``k`` words, of the lower-cased text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")

    def runs(h: Column) -> Column:
        n = F.size(h)
        return (F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(h)))
                .otherwise(F.transform(F.sequence(F.lit(0), n - k),
                                       lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))))
    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _empty(smallest: Column) -> Column:
    return smallest.bitwiseAND(_long(_REST)) == _REST


def bin_minima(shingles: Column) -> Column:
    """The smallest hash of each bin, in a fixed order of the bins; an empty bin has its largest possible hash.

    That largest hash of every bin is added to the shingles, so that of the sorted hashes the first of each bin is
    its minimum, and there are as many as bins.
    """
    largest = F.array(*[_long(_signed(b << 64 - BIN_BITS | _REST)) for b in range(BINS)])

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - BIN_BITS)
    return let(F.sort_array(F.concat(shingles, largest)), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


@functools.cache
def _probes() -> tuple[str, str]:
    """For every empty bin the bins in the random order in which they are asked: the first ``TRIES`` of them, and for
    every bin its place in that order times the number of bins, plus itself. Both as SQL arrays."""
    orders = np.random.default_rng(SEED).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
    places = np.argsort(orders, axis=1) * BINS + np.arange(BINS)
    return tuple(f"cast(split('{','.join(map(str, t.ravel()))}', ',') as array<int>)" for t in (orders[:, :TRIES], places))


def densify(minima: Column) -> Column:
    """The low bits of every bin; at least one bin must hold a hash."""
    first, places = map(F.expr, _probes())

    def held(m: Column, i: Column) -> Column:
        return ~_empty(F.get(m, i))

    def fill(m: Column) -> Column:
        def asked(i: Column, t: int) -> Column:
            return let(F.get(first, i * TRIES + t), lambda j: F.when(held(m, j), j))

        def donor(i: Column) -> Column:
            every = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: held(m, j))
            last = F.array_min(F.transform(every, lambda j: F.get(places, i * BINS + j))).bitwiseAND(F.lit(BINS - 1))
            return F.coalesce(*[asked(i, t) for t in range(TRIES)], last)
        return F.transform(m, lambda x, i: F.when(_empty(x), F.get(m, donor(i))).otherwise(x).bitwiseAND(_long(_LOW)))
    return let(minima, fill)


def packed_fingerprint(text: Column, k: int = SHINGLE) -> Column:
    """The fingerprint as 16 64-bit integers; none for a text without words."""
    def pack(low: Column) -> Column:
        return F.array(*[reduce(lambda a, b: a.bitwiseOR(b), [
            F.shiftleft(F.get(low, PER_LONG * n + i), LOW_BITS * i) for i in range(PER_LONG)]) for n in range(LONGS)])
    return let(shingle_hashes(text, k), lambda s: F.when(F.size(s) == 0, F.array().cast("array<bigint>"))
               .otherwise(let(densify(bin_minima(s)), pack)))


def as_hex(packed: Column) -> Column:
    """A packed fingerprint as 256 hexadecimal digits."""
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.get(packed, n))), 16, "0") for n in range(LONGS)])
    return F.when(F.size(packed) == 0, "").otherwise(digits)


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two packed fingerprints speak for, 0 to 1, without the bias of chance agreement."""
    def differing(n: int) -> Column:
        x = F.get(a, n).bitwiseXOR(F.get(b, n))
        for shift in (4, 2, 1):    # the lowest bit of each byte becomes 1 if any bit of the byte is
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(_long(_ONES)))
    agree = 1 - reduce(lambda p, q: p + q, [differing(n) for n in range(LONGS)]) / BINS
    chance = 2.0 ** -LOW_BITS
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc_id, text, packed, next_text, next_packed``: every document with the one that follows it by id, the last
    with the first. Repeated ids stand in the order of a hash of their texts, a NULL id before all others.

    The ids are cut into blocks; the first row of a block (one of at most 8192) also goes to the end of the block
    before it. Texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = block_bounds(rows, "doc_id", keyed=False)
    rows = rows.select("*", F.xxhash64("text").alias("tie"), block_of(F.col("doc_id"), bounds).alias("block"))
    everything = W.partitionBy(F.lit(0))
    heads = rows.groupBy("block").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    heads = heads.select("block", "head", F.coalesce(F.lag("block").over(everything.orderBy("block")),
                                                     F.max("block").over(everything)).alias("ahead"))
    first = (rows.join(F.broadcast(heads), (rows["block"] == heads["block"]) & rows["doc_id"].eqNullSafe(heads["head.doc_id"])
                       & (rows["tie"] == heads["head.tie"]))
             .groupBy("ahead").agg(F.min("text").alias("text")))
    both = rows.select("block", F.lit(False).alias("guest"), "doc_id", "tie", "text").unionAll(
        first.select(F.col("ahead").alias("block"), F.lit(True).alias("guest"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"),
                     F.lit(None).cast("bigint").alias("tie"), "text"))
    order = W.partitionBy("block").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    after = F.lead(F.struct("text", "packed")).over(order)
    return (both.select("*", packed_fingerprint(F.col("text"), k).alias("packed")).withColumn("after", after).where(~F.col("guest"))
            .select("doc_id", "text", "packed", F.col("after.text").alias("next_text"), F.col("after.packed").alias("next_packed")))


def edited(text: Column, other: Column) -> Column:
    """The text, its last half of code points (rounded down) replaced by the first as many of another."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc_id, packed, fingerprint``: one row per row."""
    found = docs.select(F.col(id_col).alias("doc_id"), packed_fingerprint(F.col(text_col), k).alias("packed"))
    return found.select("doc_id", "packed", as_hex(F.col("packed")).alias("fingerprint"))


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    pairs = with_next(spark.read.parquet(f"{sf}/documents.parquet"))
    made = pairs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "packed", "next_packed",
                        edited(F.col("text"), F.col("next_text")).alias("edited"))
    told = made.select("doc_id", "n_chars", "packed", "next_packed", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       packed_fingerprint(F.col("edited")).alias("edited_packed"))
    return told.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("packed")).alias("fingerprint"),
                       as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
                       likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
                       likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
