"""Records of CSV text whose quoted cells may span lines, read by many tasks.

A file is split between lines as any text. Whether a split begins inside a quoted cell is not known there, so the first
pass runs over every split for both cases at once: it tells, for either, whether the split ends inside a cell and how
many records begin in it, and the header where a file begins. On the driver the cases are chained from split to split,
which gives each its true beginning and the number of its first record. The second pass cuts the records; one that
goes on in the next split gets the lines that stand there, which a third, small pass over such splits has fetched.

Both passes see the text as Arrow batches of lines. Lines without a quote cost nothing but a search for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is known of a split is sent to all tasks, some 100 bytes each; raise the size of splits for more than so many.
MOST_SPLITS = 1_000_000

_CELL = rb'"[^"]*+(?:""[^"]*+)*+'    # a quoted cell up to its closing quote, or to the end of the line
_OPENED = re.compile(rb'(?:(?:' + _CELL + rb'"[^,]*+|[^",][^,]*+)?,)*+' + _CELL)
_QUOTED = re.compile(rb'[^"]*+(?:""[^"]*+)*+')

Key = tuple[int, int]
HEADER = -10


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open after the line. A quote opens a cell only as its first character; after the closing
    one everything up to the next comma belongs to the cell."""
    if inside:
        end = _QUOTED.match(line).end()
        if end == len(line):
            return True
        comma = line.find(b",", end)
        return comma >= 0 and _OPENED.fullmatch(line, comma + 1) is not None
    return _OPENED.fullmatch(line) is not None


@dataclass
class Split:
    """Where a split of a file begins: inside a cell or not, and the number of the first record that begins in it, which
    may be a header. ``tail``: the lines after it that end its last record."""

    inside: bool
    before: int
    header: bool = False
    tail: bytes = b""


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, line``: a number for the file, the place of the split in it, and the bytes of the line."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[Key, pa.Array]]:
    """The lines of each split in a batch: a task may read several."""
    file, start = (batch.column(n).to_numpy() for n in ("file", "start"))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)], strict=True):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.column("line").slice(a, b - a)


def _clean(lines: pa.Array, key: Key, first: bool) -> pa.Array:
    """Lines without a byte order mark."""
    if first and key[1] == 0 and len(lines) and lines[0].as_py().startswith(b"\xef\xbb\xbf"):
        return pa.concat_arrays([pa.array([lines[0].as_py()[3:]], lines.type), lines.slice(1)])
    return lines


def _events(lines: pa.Array, quoted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which lines hold a quote, and which are blank."""
    blank = np.isin(pc.binary_length(lines).to_numpy(zero_copy_only=False), [0, 1]) if len(lines) else np.zeros(0, bool)
    for i in np.flatnonzero(blank):
        blank[i] = lines[int(i)].as_py() in (b"", b"\r")
    quotes = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False) if quoted else np.zeros(len(lines), bool)
    return np.flatnonzero(quotes), blank


def _states(lines: pa.Array, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside a cell, and whether the next one does."""
    flips, state = [], inside
    for i in quotes.tolist():
        after = ends_inside(lines[i].as_py(), state)
        if after != state:
            flips.append(i + 1)
            state = after
    turns = np.zeros(len(lines) + 1, np.int64)
    turns[flips] = 1
    return (np.cumsum(turns)[:-1] + inside) % 2 == 1, state


def _summary(quoted: bool):
    names = ["file", "start", "open0", "open1", "n0", "n1", "header"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Key, list] = {}
        for batch in batches:
            for key, lines in _pieces(batch):
                first = key not in found
                lines = _clean(lines, key, first)
                row = found.setdefault(key, [False, True, 0, 0, None])
                quotes, blank = _events(lines, quoted)
                if key[1] == 0 and not row[2] or row[4] is not None and row[4][1]:    # the header may take several lines
                    row[4] = _header(lines, row[4], quoted)
                for case in (0, 1):
                    begins, row[case] = _states(lines, quotes, row[case])
                    row[2 + case] += int((~begins & ~blank).sum())
        if found:
            columns = zip(*[(*key, row[0], row[1], row[2], row[3], row[4][0] if row[4] else None) for key, row in found.items()], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [
                pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=names)
    return run


def _header(lines: pa.Array, known: tuple[bytes, bool] | None, quoted: bool) -> tuple[bytes, bool] | None:
    """The first record of a file, and whether it goes on."""
    for line in lines:
        raw = line.as_py()
        if known is None:
            if raw not in (b"", b"\r"):
                known = (raw, quoted and ends_inside(raw, False))
        elif known[1]:
            known = (known[0] + b"\n" + raw, ends_inside(raw, True))
        if known and not known[1]:
            break
    return known


def _heads(wanted: set[Key]):
    """The lines with which splits begin that belong to a record before them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Key, list[bytes]] = {}
        done: set[Key] = set()
        for batch in batches:
            for key, lines in _pieces(batch):
                if key not in wanted or key in done:
                    continue
                for line in lines:
                    raw = line.as_py()
                    held.setdefault(key, []).append(raw)
                    if not ends_inside(raw, True):
                        done.add(key)
                        break
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held]),
                                              pa.array([b"\n".join(v) for v in held.values()], pa.binary()), pa.array([k in done for k in held])],
                                             names=["file", "start", "head", "closed"])
    return run


def _records(splits, quoted: bool):
    """Batches of lines to ``rid, record``, numbers from 0; a header has the number ``HEADER``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(rids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
            if split.header:
                rids = np.where(rids == split.before, HEADER, rids)
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), texts], names=["rid", "record"])

        now, split, next_rid, state, open_ = None, None, 0, False, []

        def close() -> Iterator[pa.RecordBatch]:
            if open_:
                text = b"\n".join(open_) + (b"\n" + split.tail if split.tail else b"")
                yield rows(np.array([next_rid]), pa.array([text], pa.binary()))

        for batch in batches:
            for key, lines in _pieces(batch):
                lines = _clean(lines, key, key != now)
                if key != now:
                    yield from close()
                    if key not in splits.value:
                        raise RuntimeError("files or the size of splits have changed since the dataset was read; read it again")
                    now, split, open_ = key, splits.value[key], []
                    next_rid, state = split.before, split.inside
                quotes, blank = _events(lines, quoted)
                begins, after = _states(lines, quotes, state)
                starts = np.flatnonzero(~begins & ~blank)
                goes_on = np.append(begins[1:], after)
                # what goes on before the first record of these lines belongs to the open one, if that is here
                lead = int(starts[0]) if len(starts) else len(lines)
                if open_:
                    open_ += [lines[i].as_py() for i in range(lead) if begins[i]]
                    if len(starts) or (lead and not after):
                        text = b"\n".join(open_)
                        yield rows(np.array([next_rid]), pa.array([text], pa.binary()))
                        next_rid, open_ = next_rid + 1, []
                state = after
                if not len(starts):
                    continue
                single = starts[~goes_on[starts]]
                many = starts[goes_on[starts]]
                rid_of = dict(zip(many.tolist(), (next_rid + np.searchsorted(starts, many)).tolist(), strict=True))
                if len(single):
                    yield rows(next_rid + np.searchsorted(starts, single), lines.take(pa.array(single)))
                next_rid += len(starts)
                texts, rids = [], []
                for i, rid in rid_of.items():
                    end = i + 1
                    while end < len(lines) and begins[end]:
                        end += 1
                    text = [lines[k].as_py() for k in range(i, end)]
                    if end == len(lines) and after:
                        open_, next_rid = text, next_rid - 1
                    else:
                        texts.append(b"\n".join(text))
                        rids.append(rid)
                if texts:
                    yield rows(np.array(rids), pa.array(texts, pa.binary()))
        yield from close()
    return run


def read_records(spark: SparkSession, path: str, quoted: bool = True) -> tuple[list[bytes], DataFrame]:
    """The headers of the files by name, and ``rid, record`` of all other records: numbers from 1 in the order of file
    names and lines. Without ``quoted`` every line is a record. Blank lines outside of cells are left out."""
    lines = lines_of(spark, path)
    found = lines.mapInArrow(_summary(quoted), "file bigint, start bigint, open0 boolean, open1 boolean, n0 bigint, n1 bigint, header binary").collect()
    if len(found) > MOST_SPLITS:
        raise ValueError(f"{len(found)} splits: raise spark.sql.files.maxPartitionBytes")
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("name"), F.xxhash64("_metadata.file_path").alias("file"))
    order = {r["file"]: r["name"] for r in names.collect()}
    splits: dict[Key, Split] = {}
    headers: list[bytes] = []
    before, file, inside, chain = 0, None, False, []
    for r in sorted(found, key=lambda r: (order[r["file"]], r["start"])):
        if r["file"] != file:
            file, inside = r["file"], False
        chain.append((r["file"], r["start"]))
        splits[chain[-1]] = Split(inside, before)
        n = r["n1"] if inside else r["n0"]
        if r["header"] is not None and n:
            headers.append(r["header"])
            n -= 1
            # the header takes the place before the first row
            splits[chain[-1]].before, splits[chain[-1]].header = before - 1, True
        before += n
        inside = r["open1"] if inside else r["open0"]
    begun = [k for k in chain if splits[k].inside]
    if begun:
        some = lines.where(F.col("start").isin(sorted({k[1] for k in begun}))) if len(begun) < 1000 else lines
        got = some.mapInArrow(_heads(set(begun)), "file bigint, start bigint, head binary, closed boolean").collect()
        heads = {(r["file"], r["start"]): r for r in got}
        for at in range(len(chain) - 1, 0, -1):    # a record may go on over several splits
            here = chain[at]
            if splits[here].inside:
                tail = heads[here]["head"] if here in heads else b""
                goes_on = here in heads and not heads[here]["closed"] and splits[here].tail
                splits[chain[at - 1]].tail = tail + (b"\n" + splits[here].tail if goes_on else b"")
    sent = spark.sparkContext.broadcast(splits)
    rows = lines.mapInArrow(_records(sent, quoted), "rid bigint, record binary")
    return headers, rows.where("rid >= 0").select((F.col("rid") + 1).alias("rid"), F.col("record").cast("string").alias("record"))
