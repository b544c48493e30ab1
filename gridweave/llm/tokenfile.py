"""Token files in bit or byte planes.

Documents are encoded, dealt to shards of neighbouring doc_ids and written in ascending order. A shard is cut
into blocks of ``BLOCK_IDS`` ids, whatever the documents; a block of n ids of w bytes is turned into w byte
planes (or 8 w bit planes), so that equal high bits lie together, and each plane is compressed with zstandard.

On disk a token file is a folder with ``chunks`` (one Parquet row per block: its planes, and the ids and lengths
of the documents that begin in it) and ``index`` (the same without planes: shard, chunk, first position,
counts, compressed bytes). Spark writes and reads both, so any storage that Spark reaches will do.

Shards are found from quantiles of doc_id; a doc_id that many rows share is spread over several shards.

Defined results: NULL and empty texts have the end id alone; rows with the same doc_id follow each other in any
order; NULL doc_ids come first; other columns are not looked at; an empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequence import block_of
from ..session import shared_dir, shuffle_width
from .batches import Rows, texts_of, tidy
from .bpe import encoder, tokenizer_text
from .registry import query

#: Ids per block.
BLOCK_IDS = 1 << 16
#: Documents per shard at which further shards are taken; at least two per shuffle partition, MOST_SHARDS at most.
SHARD_ROWS, MOST_SHARDS = 50_000, 8192
LEVEL = 3


def to_planes(ids: np.ndarray, width: int, bits: bool = False) -> list[bytes]:
    """The ids' byte planes (lowest first) or bit planes (lowest bit of the lowest byte first), compressed."""
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if bits:
        spread = np.unpackbits(by_byte, axis=1, bitorder="little").T
        planes = np.packbits(spread, axis=1, bitorder="little")
    else:
        planes = by_byte.T
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool = False) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(unpack(p), np.uint8) for p in planes]
    out = np.zeros((n, 4), np.uint8)
    if bits:
        spread = np.unpackbits(np.stack(raw), axis=1, count=n, bitorder="little").T
        out[:, :width] = np.packbits(spread, axis=1, bitorder="little")
    else:
        out[:, :width] = np.stack(raw, axis=1)
    return out.view("<u4").reshape(-1)


def shard_of(docs: DataFrame, order: str, shards: int, tie: Column) -> Column:
    """A shard number that ascends with ``order``; a value that fills several quantiles gets several shards."""
    probs = [i / shards for i in range(1, shards)]
    found = docs.agg(F.percentile_approx(order, probs, max(1000, 10 * shards)).alias("q")).first()["q"] or []
    times = Counter(found)
    cuts = sorted(times)
    first, at = [], 0  # the first shard of the values above the cuts so far
    for c in cuts:
        first.append(at)
        at += 1 + (times[c] if times[c] > 1 else 0)
    first.append(at)
    place = F.coalesce(block_of(F.col(order), cuts), F.lit(0))
    shard = F.get(F.array(*[F.lit(n) for n in first]), place)
    hot = {c: n for c, n in times.items() if n > 1}
    if not hot:
        return shard
    spread = F.get(F.array(*[F.lit(times[c] if times[c] > 1 else 0) for c in cuts], F.lit(0)), place)
    on_cut = F.coalesce(F.col(order).isin(list(hot)), F.lit(False))
    return F.when(on_cut, shard + 1 + F.pmod(F.xxhash64(tie), spread).cast("int")).otherwise(shard)


CHUNK_FIELDS = ("shard int, chunk int, first bigint, n_ids int, width int, bits boolean, planes array<binary>, "
                "doc_ids array<bigint>, doc_lengths array<bigint>")
CHUNK = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()),
                   ("bits", pa.bool_()), ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())),
                   ("doc_lengths", pa.list_(pa.int64()))])


class _Shard:
    """One shard as its documents come in: full blocks leave as chunk rows."""

    def __init__(self, shard: int, width: int, bits: bool) -> None:
        self.shard, self.width, self.bits = shard, width, bits
        self.parts: list[np.ndarray] = []
        self.held = self.first = self.chunk = self.placed = 0
        self.starts: list[tuple[int, int | None, int]] = []  # position, doc_id, length of documents not yet written

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.starts.append((self.placed, doc_id, len(ids)))
        self.placed += len(ids)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            whole = np.concatenate(self.parts)
            while len(whole) >= BLOCK_IDS:
                yield self._row(whole[:BLOCK_IDS])
                whole = whole[BLOCK_IDS:]
            self.parts, self.held = [whole], len(whole)

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield self._row(np.concatenate(self.parts))

    def _row(self, block: np.ndarray) -> tuple:
        end = self.first + len(block)
        n = next((i for i, s in enumerate(self.starts) if s[0] >= end), len(self.starts))
        here, self.starts = self.starts[:n], self.starts[n:]
        row = (self.shard, self.chunk, self.first, len(block), self.width, self.bits, to_planes(block, self.width, self.bits),
               [s[1] for s in here], [s[2] for s in here])
        self.first, self.chunk = end, self.chunk + 1
        return row


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, width: int = 2, bits: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, add ``end_id``, and write chunks and index below ``path``.

    ``width`` is the bytes of an id: 2 for vocabularies up to 65,536.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    end = end_id.to_bytes(width, "little")
    shards = max(2 * shuffle_width(spark), docs.count() // SHARD_ROWS)
    shard = shard_of(docs.select(F.col(id_col).alias("doc_id")), "doc_id", min(shards, MOST_SHARDS), F.col("tie"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(shipped.value, width).encode
        rows = Rows(pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("shard", pa.int32()), ("ids", pa.binary())]))
        for batch in batches:
            for doc_id, tie, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), texts_of(batch, "text"), strict=True):
                ids = ids_of(text) + end
                rows.add((doc_id, tie, at, ids), len(ids))
                if rows.full():
                    yield rows.take()
        yield from rows.rest()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = Rows(CHUNK), None
        for batch in batches:
            for doc_id, at, ids in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                done: list[tuple] = []
                if now is None or now.shard != at:
                    done += now.close() if now else []
                    now = _Shard(at, width, bits)
                done += now.add(doc_id, np.frombuffer(ids, f"<u{width}"))
                for row in done:
                    rows.add(row, sum(map(len, row[6])))
                if rows.full():
                    yield rows.take()
        for row in now.close() if now else ():
            rows.add(row)
        yield from rows.rest()

    encoded = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("tie"),
                           F.col(text_col).alias("text"))
               .select("doc_id", "tie", shard.cast("int").alias("shard"), "text")
               .mapInArrow(tidy(encode), "doc_id bigint, tie bigint, shard int, ids binary"))
    chunks = (encoded.repartition(max(2, shuffle_width(spark)), "shard").sortWithinPartitions("shard", "doc_id", "tie")
              .mapInArrow(tidy(pack), CHUNK_FIELDS))
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    size = F.aggregate("planes", F.lit(0), lambda total, p: total + F.octet_length(p))
    (read_chunks(spark, path).select("shard", "chunk", "first", "n_ids", F.size("doc_ids").alias("n_docs"), size.alias("bytes"))
     .write.parquet(f"{path}/index"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_FIELDS).parquet(f"{path}/chunks")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``shard, before``: how many ids lie before each shard, from the index (one row per shard)."""
    index = spark.read.schema("shard int, chunk int, first bigint, n_ids int, n_docs int, bytes int").parquet(f"{path}/index")
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)),
                                             F.lit(0)).alias("before"))


DOCUMENT = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("ids", pa.binary())])


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a token file: ``doc_id, start, ids`` (ids as little-endian unsigned 32-bit integers)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(DOCUMENT)
        shard, waiting, parts, held, at = None, [], [], 0, 0  # documents begun, their ids so far
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, waiting, parts, held, at = row["shard"], [], [], 0, 0
                waiting += zip(row["doc_ids"], row["doc_lengths"], strict=True)
                parts.append(from_planes(row["planes"], row["n_ids"], row["width"], row["bits"]))
                held += row["n_ids"]
                if waiting and held >= waiting[0][1]:
                    whole, used, done = np.concatenate(parts), 0, 0
                    for doc_id, n in waiting:
                        if used + n > held:
                            break
                        rows.add((doc_id, shard, at, whole[used:used + n].tobytes()), 4 * n)
                        used, at, done = used + n, at + n, done + 1
                        if rows.full():
                            yield rows.take()
                    waiting, parts, held = waiting[done:], [whole[used:]], held - used
        yield from rows.rest()

    width = max(2, shuffle_width(spark))
    found = (read_chunks(spark, path).repartition(width, "shard").sortWithinPartitions("shard", "chunk")
             .mapInArrow(tidy(unpack), "doc_id bigint, shard int, at bigint, ids binary"))
    # One row per shard: with the further shards of hot doc_ids at most 2 * MOST_SHARDS rows of 12 bytes.
    return found.join(F.broadcast(shard_starts(spark, path)), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "ids")


@query("op3_token_file")
def op3_token_file(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    path = shared_dir(spark, "op3-tokens")
    write_token_file(spark.read.parquet(f"{sf}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_file(spark, path).select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    """The checksum the query reports for a list of ids."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
