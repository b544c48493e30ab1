"""Near copies by an exact n-gram Jaccard join: T-occurrence search after DivideSkip.

Documents with equal shingle sets form a class; everything below works on one member of each class, so copies
never multiply. Two classes link when their sets' Jaccard similarity reaches num/den, that is, when the smaller
document is found in at least T of the lists of the other's shingles.

1. Shingles are ordered by how common they are, the rarest first. Commonness is counted over all documents in
   ``CELLS`` counters (a shared counter only makes a shingle look more common; any order gives right results).
2. Of a query's lists, the T-1 longest - those of its most common shingles - are set aside. What is left, its
   n - T + 1 rarest shingles, are the short lists: only these are built, by one shuffle on the shingle. A document
   in none of them cannot reach T.
   Where a list holds two classes so late in their order that what follows cannot reach T any more, the pair is
   left to an earlier list, or cannot link.
3. Round one searches, for every class, the ``LEADERS`` classes it shares most short lists with among those that lead
   its lists: in every list and range of sizes, the class whose own lists are the longest. Round two searches
   every pair that shares a short list but is not in one component yet. A group of near copies is thus joined by a
   few searches for each member; all its pairs are never made.
4. A search takes a query and its candidates in blocks of ``CANDIDATES``: the query's short lists over the block
   are merged with a heap; candidates found often enough are probed in the long lists by binary search. A long
   list is probed from the candidate's side: whether it holds the candidate is whether the candidate's ordered
   shingles hold the list's.

Before a search, a bound on the overlap from ``HIST`` counts per document leaves out pairs that cannot link.

Components come from the links by pointer jumping. Intermediate tables are written to the shared folder.

Words are runs of characters other than white space, with A-Z lower-cased; shingles are k consecutive words, and
the whole text if it has fewer. Shingles are compared by hashes: a class key has 80 bits, a shingle 56.

Defined results: a text that is NULL or has no words has an empty set and links with nothing; repeated rows and
ties share a class; documents with a NULL doc_id take part, their component's smallest doc_id being that of
the others (NULL if there is none); an empty table gives an empty result; other columns are not looked at
(:func:`deduplicate` keeps them).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, shuffle_width
from .batches import Rows, rows_per_batch, slices, texts_of, tidy
from .registry import query
from .wordhash import SPACED_LOWER, mix, runs, word_hashes

#: Counters of commonness (1 byte each when broadcast), and how many of them travel in one row.
CELLS, SLICE = 1 << 21, 1 << 16
HIST = 64
#: Candidates searched at a time.
CANDIDATES = 256
#: Classes that a class is searched against in round one.
LEADERS = 3
#: Pairs, each with two token sets, that are handed to Python at a time.
PAIRS = 512
#: A table of at most so many rows of 16 bytes is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000
BATCH_CHARS = 2 << 20

_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_LOW = np.uint64((1 << 56) - 1)


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for a, b in slices(texts, map(len, texts), BATCH_CHARS):
        words, counts = word_hashes(texts[a:b], SPACED_LOWER)
        grams, start = runs(words, k), 0
        for n in counts.tolist():
            own = grams[start:start + n - k + 1] if n >= k else runs(words[start:start + n], n) if n else grams[:0]
            own = np.sort(own)
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own
            start += n


def class_key(shingles: np.ndarray) -> bytes:
    """The size and an 80-bit sum of the set: equal for equal sets, and ordered by size."""
    a, b = int(mix(shingles ^ _A).sum()), int(mix(shingles ^ _B).sum())
    return len(shingles).to_bytes(4, "big") + a.to_bytes(8, "big") + (b & 0xFFFF).to_bytes(2, "big")


def size_of(key: bytes) -> int:
    return int.from_bytes(key[:4], "big")


def ordered_tokens(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles as numbers that ascend from the rarest to the most common."""
    level = common[(shingles >> np.uint64(40)).astype(np.int64) % len(common)].astype(np.uint64)
    return np.unique((level << np.uint64(56)) | (shingles & _LOW))


def short_lists(n: int, num: int, den: int) -> int:
    """How many of n shingles two linked documents cannot all miss: n - T + 1."""
    return n - -(-num * n // den) + 1


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    return -(-num * (a + b) // (num + den))


def compatible(a: int, b: int, num: int, den: int) -> bool:
    return min(a, b) * den >= num * max(a, b)


MEASURED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("cls", pa.binary()), ("hist", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])


def measure(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (doc_id, text_hash, class, histogram) and rows of counter slices, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counters = Rows(MEASURED), np.zeros(CELLS, np.int32)
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            held: list[np.ndarray] = []
            size = 0
            for doc_id, text_hash, own in zip(ids, hashes, shingle_sets(texts_of(batch, "text"), k), strict=True):
                hist = np.bincount((own & np.uint64(HIST - 1)).astype(np.int64), minlength=HIST)
                rows.add((doc_id, text_hash, class_key(own), np.minimum(hist, 65535).astype("<u2").tobytes(), None, None), 200)
                held.append(own)
                size += len(own)
                if size >= 1 << 20:
                    np.add(counters, np.bincount((np.concatenate(held) >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), out=counters, casting="unsafe")
                    held, size = [], 0
                if rows.full():
                    yield rows.take()
            if held:
                np.add(counters, np.bincount((np.concatenate(held) >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), out=counters, casting="unsafe")
        for i in range(CELLS // SLICE):
            part = counters[i * SLICE:(i + 1) * SLICE]
            if part.any():
                rows.add((None, None, None, None, i, part.astype("<i4").tobytes()), 4 * SLICE)
                if rows.full():
                    yield rows.take()
        yield from rows.rest()

    return docs.mapInArrow(tidy(run), "doc_id bigint, text_hash bigint, cls binary, hist binary, slice int, counts binary")


def commonness(measured: DataFrame) -> np.ndarray:
    """A level of 0 to 255 for every counter: CELLS bytes come to the driver, whatever the data."""
    width = min(CELLS // SLICE, shuffle_width(measured.sparkSession))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total = totals.setdefault(at, np.zeros(SLICE, np.int64))
                total += np.frombuffer(counts, "<i4")
        for at, total in totals.items():
            level = np.minimum(255, np.floor(4 * np.log2(total + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["slice", "level"])

    found = (measured.where("slice is not null").select("slice", "counts").repartition(width, "slice")
             .mapInArrow(tidy(add), "slice int, level binary").collect())
    out = np.zeros(CELLS, np.uint8)
    for r in found:
        out[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["level"], np.uint8)
    return out


POSTING = pa.schema([("token", pa.int64()), ("entry", pa.binary())])
#: An entry of a list is a class key and, in two more bytes, the token's place in the class's order (65535 at most).
KEY_BYTES = 14


def lists(docs: DataFrame, common, k: int, num: int, den: int) -> DataFrame:
    """The short lists that hold two classes or more: ``token, cls, place``. ``common`` is the broadcast commonness."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # classes of this task: a copy in the same task adds nothing
        for batch in batches:
            tokens, keys = [], []
            for own in shingle_sets(texts_of(batch, "text"), k):
                key = class_key(own)
                if len(own) and key not in seen:
                    seen.add(key)
                    tokens.append(ordered_tokens(own, common.value)[:short_lists(len(own), num, den)])
                    keys.append(key)
            sizes = [len(t) for t in tokens]
            for a, b in slices(keys, sizes, 1 << 17):
                n = np.array(sizes[a:b])
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                entry = np.empty((n.sum(), KEY_BYTES + 2), np.uint8)
                entry[:, :KEY_BYTES] = np.repeat(np.frombuffer(b"".join(keys[a:b]), np.uint8).reshape(-1, KEY_BYTES), n, axis=0)
                entry[:, KEY_BYTES:] = np.minimum(place, 65535).astype(">u2").view(np.uint8).reshape(-1, 2)
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES + 2), len(entry), [None, pa.py_buffer(entry.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens[a:b]).view(np.int64)), whole.cast(pa.binary())], schema=POSTING)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(POSTING)
        now = last = None  # the token at hand, and its latest entry
        alone = False  # whether the list has one class so far, whose entry then waits
        for batch in batches:
            token = batch.column("token").to_numpy()
            # Most lists have one row; only rows with an equal neighbour, and those at the edges, are looked at.
            same = token[1:] == token[:-1]
            look = np.flatnonzero(np.concatenate([[True], same]) | np.concatenate([same, [True]])) if len(token) else []
            entries = batch.column("entry").take(pa.array(look, pa.int64())).to_pylist()
            for t, entry in zip(token[look].tolist(), entries, strict=True):
                if t != now:
                    now, last, alone = t, entry, True
                elif entry[:KEY_BYTES] != last[:KEY_BYTES]:
                    if alone:
                        rows.add((t, last), 40)
                        alone = False
                    rows.add((t, entry), 40)
                    last = entry
                    if rows.full():
                        yield rows.take()
        yield from rows.rest()

    found = (docs.select("text").mapInArrow(tidy(post), "token bigint, entry binary")
             .repartition(shuffle_width(docs.sparkSession), "token").sortWithinPartitions("token", "entry")
             .mapInArrow(tidy(group), "token bigint, entry binary"))
    return found.select("token", F.substring("entry", 1, KEY_BYTES).alias("cls"),
                        F.conv(F.hex(F.substring("entry", KEY_BYTES + 1, 2)), 16, 10).cast("int").alias("place"))


def search(q: np.ndarray, candidates: list[np.ndarray], num: int, den: int) -> list[int]:
    """The overlap of the query with each candidate that reaches its T, else 0. Tokens ascend from the rarest.

    DivideSkip: the query's short lists over the candidates are merged with a heap, the others are probed.
    """
    n_short = short_lists(len(q), num, den)
    short, long_ = q[:n_short], q[n_short:]
    entries: dict[int, list[int]] = {}
    for i, c in enumerate(candidates):
        at = np.searchsorted(c, short)
        for t in short[(at < len(c)) & (c[np.minimum(at, len(c) - 1)] == short)].tolist():
            entries.setdefault(t, []).append(i)
    out = [0] * len(candidates)
    for i, found in groupby(heapq.merge(*entries.values())):
        c = candidates[i]
        need, count = least_overlap(len(q), len(c), num, den), sum(1 for _ in found)
        if count + len(long_) < need:
            continue
        at = np.searchsorted(c, long_)
        count += int((c[np.minimum(at, len(c) - 1)] == long_).sum())
        if count >= need:
            out[i] = count
    return out


def _bounded(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (q, c) whose overlap can reach T by their histograms."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, HIST).astype(np.int64) for i in (2, 3))
            sizes = [(size_of(x), size_of(y)) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            need = np.array([least_overlap(x, y, num, den) for x, y in sizes])
            full = (a.max(axis=1) >= 65535) | (b.max(axis=1) >= 65535)  # a full counter bounds nothing
            yield batch.select([0, 1]).filter(pa.array(full | (np.minimum(a, b).sum(axis=1) >= need)))

    of_q = classes.select(F.col("cls").alias("q"), F.col("hist").alias("q_hist"))
    of_c = classes.select(F.col("cls").alias("c"), F.col("hist").alias("c_hist"))
    return pairs.join(of_q, "q").join(of_c, "c").select("q", "c", "q_hist", "c_hist").mapInArrow(tidy(keep), "q binary, c binary")


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, common, k: int, num: int, den: int, name: str) -> DataFrame:
    """The pairs (q, c) that link, settled. Shingles are made again, for the members of the pairs' classes only."""
    pairs = settle(_bounded(pairs, classes, num, den), f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array("q", "c")).alias("cls")).distinct()
    wanted = settle(classes.join(wanted, "cls", "left_semi").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")), f"{name}-members")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(pa.schema([("cls", pa.binary()), ("tokens", pa.binary())]))
        for batch in batches:
            for own in shingle_sets(texts_of(batch, "text"), k):
                data = ordered_tokens(own, common.value).tobytes()
                rows.add((class_key(own), data), len(data))
                if rows.full():
                    yield rows.take()
        yield from rows.rest()

    members = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi").select("text")
    made = members.mapInArrow(tidy(sets), "cls binary, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens"))
    made = settle(made, f"{name}-sets")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(pa.schema([("q", pa.binary()), ("c", pa.binary())]))
        for batch in batches:
            keys, sets = batch.column("q").to_pylist(), [batch.column(n) for n in ("q_tokens", "c_tokens")]
            tokens = [lambda i, c=c: np.frombuffer(c[i].as_buffer(), np.uint64) for c in sets]
            start = 0
            for q, block in groupby(keys):
                end = start + sum(1 for _ in block)
                for a in range(start, end, CANDIDATES):
                    part = range(a, min(end, a + CANDIDATES))
                    for i, n in zip(part, search(tokens[0](start), [tokens[1](i) for i in part], num, den), strict=True):
                        if n:
                            rows.add((q, batch.column("c")[i].as_py()))
                start = end
            if rows.full():
                yield rows.take()
        yield from rows.rest()

    found = (pairs.join(made.select(F.col("cls").alias("c"), F.col("tokens").alias("c_tokens")), "c")
             .join(made.select(F.col("cls").alias("q"), F.col("tokens").alias("q_tokens")), "q")
             .select("q", "c", "q_tokens", "c_tokens").mapInArrow(tidy(look), "q binary, c binary"))
    with rows_per_batch(docs.sparkSession, PAIRS):    # a row holds two token sets
        return settle(found, f"{name}-links")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for all nodes of the edges (a, b): the smallest node of each connected component.

    Every round gives a node the smallest root among its neighbours', then that root's own root; the number of
    rounds grows with the logarithm of a component's diameter, and each writes its result.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    roots = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{name}-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        # The smallest root seen by any member goes to the root itself, so that whole trees are hooked on.
        step = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("best"))
        hooked = step.groupBy(F.col("root").alias("node")).agg(F.min("best").alias("hook"))
        after = (step.join(hooked.select(F.col("node").alias("root"), "hook"), "root")
                 .select("node", "root", F.least("best", "hook").alias("best")))
        jumped = after.join(roots.select(F.col("node").alias("best"), F.col("root").alias("further")), "best")
        after = settle(jumped.select("node", F.least("best", "further").alias("root"), (F.least("best", "further") < F.col("root")).alias("moved")), f"{name}-roots")
        roots = after.select("node", "root")
        if after.where("moved").isEmpty():
            return roots


def size_column(cls: str) -> Column:
    """:func:`size_of` as a column."""
    return F.conv(F.hex(F.substring(cls, 1, 4)), 16, 10).cast("bigint")


def can_reach(a: str, b: str, num: int, den: int) -> Column:
    """Whether the classes of two entries of a list could still link if this is the first token that they share:
    their sizes fit, and enough shingles follow in both. Entries have the columns n_ and at_ with the given names."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    fits = F.least(na, nb) * den >= F.greatest(na, nb) * num
    return fits & (F.least(na - F.col(f"at_{a}"), nb - F.col(f"at_{b}")) * (num + den) >= num * (na + nb))


def leading_pairs(listed: DataFrame, num: int, den: int) -> DataFrame:
    """Every class with the LEADERS leading classes it shares most lists with (q, c).

    Sizes are put in ranges such that linked ones lie in the same or the next; every list has a leader per range.
    """
    weight = listed.join(listed.groupBy("token").agg(F.count("*").alias("size")), "token").groupBy("cls").agg(F.sum("size").alias("weight"))
    entries = listed.join(weight, "cls").withColumn("n", size_column("cls"))
    entries = entries.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("int") if num < den else F.lit(0))
    lead = (entries.groupBy("token", "range").agg(F.max_by(F.struct("cls", "place", "n", "weight"), F.struct("weight", "cls")).alias("l"))
            .select("token", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)).alias("range"),
                    F.col("l.cls").alias("lead"), F.col("l.place").alias("at_l"), F.col("l.n").alias("n_l"), F.col("l.weight").alias("weight_l")))
    both = entries.select("token", "range", "cls", F.col("place").alias("at_e"), F.col("n").alias("n_e")).join(lead, ["token", "range"])
    shared = both.where((F.col("cls") != F.col("lead")) & can_reach("e", "l", num, den)).groupBy("cls", "lead").agg(
        F.count("*").alias("n"), F.first("weight_l").alias("weight"))
    # A class has at most three leaders for each of its short lists.
    best = shared.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "weight", "lead")), asc=False).alias("best"))
    pairs = best.select("cls", F.explode(F.slice("best", 1, LEADERS)).alias("b")).select("cls", "b.lead")
    return pairs.select(F.least("cls", "lead").alias("q"), F.greatest("cls", "lead").alias("c")).distinct()


def open_pairs(listed: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (q, c) of classes that share a list but are in two components.

    Lists within one component are done; in the others, the entries of the largest component are only paired with
    the rest.
    """
    placed = listed.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "token", "cls", "place", size_column("cls").alias("n"), F.coalesce("root", "cls").alias("root"))
    placed = settle(placed, "near-placed")
    sizes = placed.groupBy("token", "root").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("token").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("main"))
    rest = (placed.join(mixed.where("roots > 1").select("token", "main"), "token").where("root <> main")
            .select("token", F.col("cls").alias("x"), F.col("root").alias("root_x"), F.col("place").alias("at_x"), F.col("n").alias("n_x"), "main"))
    other = placed.select("token", F.col("cls").alias("y"), F.col("root").alias("root_y"), F.col("place").alias("at_y"), F.col("n").alias("n_y"))
    apart = (rest.token == other.token) & (F.col("root_x") != F.col("root_y")) & can_reach("x", "y", num, den) & (
        (F.col("root_y") == F.col("main")) | (F.col("x") < F.col("y")))
    return rest.join(other, apart).select(F.least("x", "y").alias("q"), F.greatest("x", "y").alias("c")).distinct()


def near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_shingles, cls, root, component_id``.

    ``root`` names the component, ``component_id`` is its smallest doc_id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    measured = settle(measure(docs, k), "near-measured")
    common = spark.sparkContext.broadcast(commonness(measured))
    rows = measured.where("cls is not null").select("doc_id", "text_hash", "cls", "hist")
    # One member per class; the histogram belongs to the class.
    classes = settle(rows.groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("least_id"), F.first("hist").alias("hist"))
                     .select("cls", "one.*", "least_id", "hist"), "near-classes")
    listed = settle(lists(docs, common, k, num, den), "near-lists")
    one = links(leading_pairs(listed, num, den), classes, docs, common, k, num, den, "near-one")
    roots = components(one.select(F.col("q").alias("a"), F.col("c").alias("b")), "near-one")
    two = links(open_pairs(listed, roots, num, den), classes, docs, common, k, num, den, "near-two")
    if not two.isEmpty():
        edges = one.unionByName(two).select(F.col("q").alias("a"), F.col("c").alias("b"))
        roots = components(edges, "near-two")
    named = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "least_id", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least, "root").select("cls", "root", "component_id")
    n = size_column("cls")
    return rows.join(of_class, "cls").select(
        "doc_id", "text_hash", n.alias("n_shingles"), "cls", "root",
        F.when(n == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest doc_id, with all its columns.

    Documents without words are no copies of each other and all stay.
    """
    found = near_copies(docs, k, num, den, id_col, text_col)
    empty, full = found.where("n_shingles = 0"), found.where("n_shingles > 0")
    # NULL ids come last, so a component is named by a real one where it has any.
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = full.groupBy("root").agg(F.min(place).alias("one"), F.count("*").alias("n")).select("one.doc_id", "one.text_hash", "root")
    copies = full.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    same = [kept.doc_id.eqNullSafe(copies.doc_id), kept.text_hash == copies.text_hash]
    kept = settle(kept.join(copies, same).select(kept.doc_id.alias("_near_id"), kept.text_hash.alias("_near_hash"), "rows"), "near-kept")
    hashed = F.xxhash64(docs[text_col])
    on = lambda k: docs[id_col].cast("bigint").eqNullSafe(k["_near_id"]) & (hashed == k["_near_hash"])
    once, repeated = kept.where("rows = 1"), kept.where("rows > 1")
    out = docs.join(once, on(once), "left_semi")
    blank = settle(empty.select(F.col("doc_id").alias("_near_id"), F.col("text_hash").alias("_near_hash")).distinct(), "near-blank")
    out = out.unionByName(docs.join(blank, on(blank), "left_semi"))
    # Rows that repeat both doc_id and text: any one of them.
    if not repeated.isEmpty():
        again = docs.join(repeated, on(repeated), "left_semi").withColumn("_near_hash", hashed)
        out = out.unionByName(again.dropDuplicates([id_col, "_near_hash"]).drop("_near_hash"))
    return out


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf}/documents.parquet"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")
