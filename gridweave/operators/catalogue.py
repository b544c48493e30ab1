"""The content-addressed file catalogue.

A catalogue is a DataFrame with ``id, sha256, ext, name, mime, size, created_at, source, tags`` and
optionally ``meta``. Ids appear in the file and file list cells of datasets.
"""

from __future__ import annotations

import json
import mimetypes
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, text
from ..session import settle
from ..model import RID, display_of, logical_of, user_fields
from .rows import contains_text
from .sequence import number_rows, running

UNKNOWN_MIME = "application/octet-stream"

# First bytes in hex, media type and extension, in the order they are tried.
SIGNATURES = [
    ("89504E470D0A1A0A", "image/png", "png"),
    ("FFD8FF", "image/jpeg", "jpg"),
    ("474946383761", "image/gif", "gif"),
    ("474946383961", "image/gif", "gif"),
    ("424D", "image/bmp", "bmp"),
    ("255044462D", "application/pdf", "pdf"),
    ("504B0304", "application/zip", "zip"),
    ("1F8B08", "application/gzip", "gz"),
    ("00000018667479706D7034", "video/mp4", "mp4"),
    ("000000206674797069736F6D", "video/mp4", "mp4"),
    ("00000014667479707174", "video/quicktime", "mov"),
    ("494433", "audio/mpeg", "mp3"),
    ("4F676753", "audio/ogg", "ogg"),
    ("664C6143", "audio/flac", "flac"),
    ("FFFB", "audio/mpeg", "mp3"),
    ("FFF3", "audio/mpeg", "mp3"),
    ("FFF2", "audio/mpeg", "mp3"),
    ("3C737667", "image/svg+xml", "svg"),
    ("3C3F786D6C", "application/xml", "xml"),
    ("7B", "application/json", "json"),
    ("5B", "application/json", "json"),
]

# How HTML files begin, in lower case.
HTML_STARTS = ["<!doctype html", "<html"]

# Media type of a file name extension, for content that no signature tells apart: the standard library's registry (its
# own table, not the machine's), and fixed values that it lacks or that are written otherwise here.
EXTENSION_MIME = {ext.lstrip(".").lower(): mime for ext, mime in mimetypes.MimeTypes(filenames=()).types_map[True].items()} | {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp",
    "bmp": "image/bmp", "svg": "image/svg+xml", "pdf": "application/pdf", "zip": "application/zip",
    "gz": "application/gzip", "mp4": "video/mp4", "mov": "video/quicktime", "mp3": "audio/mpeg",
    "wav": "audio/x-wav", "ogg": "audio/ogg", "flac": "audio/flac", "xml": "application/xml",
    "json": "application/json", "html": "text/html", "htm": "text/html", "txt": "text/plain", "csv": "text/csv",
    "md": "text/markdown", "eml": "message/rfc822",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}

# Containers whose name tells more than their first bytes.
REFINED_BY_NAME = {"application/zip": ["docx", "xlsx", "pptx"]}


def hash_content(content: Column) -> Column:
    return F.sha2(content, 256)


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def sniff(content: Column, name: Column) -> Column:
    """A struct of media type and extension from the first bytes, then the name, then unknown."""
    head = F.substring(content, 1, 64)
    hexed = F.hex(head)
    ext = file_extension(name)
    by_name = _lookup(EXTENSION_MIME, ext)

    def kind(mime: Column, e: Column) -> Column:
        return F.struct(mime.alias("mime"), e.alias("ext"))

    webp = hexed.startswith("52494646") & (F.substring(hexed, 17, 8) == "57454250")
    # the text test allows a character cut at the 64th byte: what is left over must begin one
    whole = F.try_validate_utf8(F.substring(content, 1, 64)).isNotNull()
    begun = {63: "^(C[2-9A-F]|[D-E].|F[0-4])$", 62: "^(E.|F[0-4])[89AB].$", 61: "^F[0-4][89AB].[89AB].$"}
    cut = [F.try_validate_utf8(F.substring(content, 1, n)).isNotNull() & F.hex(F.substring(content, n + 1, 64 - n)).rlike(p)
           for n, p in begun.items()]
    is_text = whole | ((F.octet_length(content) > 64) & (cut[0] | cut[1] | cut[2]))
    lowered = F.lower(F.decode(F.substring(content, 1, 32), "ISO-8859-1"))
    html = reduce(lambda a, b: a | b, [lowered.startswith(p) for p in HTML_STARTS])
    out = F.when(webp, kind(F.lit("image/webp"), F.lit("webp")))
    for signature, mime, e in SIGNATURES:
        hit = hexed.startswith(signature)
        if mime in REFINED_BY_NAME:
            out = out.when(hit & ext.isin(REFINED_BY_NAME[mime]), kind(by_name, ext))
        out = out.when(hit, kind(F.lit(mime), F.lit(e)))
    out = out.when(html, kind(F.lit("text/html"), F.lit("html")))
    out = out.when(is_text, kind(F.lit("text/plain"), F.lit("txt")))
    out = out.when(by_name.isNotNull(), kind(by_name, ext))
    return out.otherwise(kind(F.lit(UNKNOWN_MIME), F.lit("bin")))


def free_ids(rows: DataFrame, order: str, catalogue: DataFrame | None = None) -> DataFrame:
    """Give rows ids of 8 or more hex digits that are unique and unused: the n-th row takes the n-th free number.

    The n-th free number is n plus the count of used numbers before it. A used number with ``free``
    unused ones below it counts for every n above ``free``, so one running count over both lists
    answers all rows at once.
    """
    numbered = number_rows(rows, order, "_n", ties=["path"] if "path" in rows.columns else [])
    if catalogue is None:
        slots = numbered.withColumn("_slot", F.col("_n"))
    else:
        used = catalogue.where(text.looks_like_id(F.col("id"))).select(F.conv("id", 16, 10).cast("bigint").alias("_used")).distinct()
        ranked = number_rows(used.where("_used > 0"), "_used", "_k")
        marks = ranked.select((F.col("_used") - F.col("_k") + 1).alias("_n"), F.lit(0).alias("_new"), F.col("_k").alias("_tie"))
        asks = numbered.select("_n", F.lit(1).alias("_new"), F.lit(0).cast("bigint").alias("_tie"))
        counted = running(asks.unionByName(marks), [], "_n", {"_before": 1 - F.col("_new")}, ties=["_new", "_tie"])
        slots = numbered.join(counted.where("_new = 1").select("_n", "_before"), "_n").withColumn(
            "_slot", F.col("_n") + F.col("_before"))
    hexed = F.lower(F.hex("_slot"))    # beyond 2^32 files ids grow longer, they are never cut
    return slots.withColumn("id", F.lpad(hexed, F.greatest(F.length(hexed), F.lit(8)), "0")).drop("_n", "_slot", "_before")


def register(files: DataFrame, order: str = "seq", catalogue: DataFrame | None = None) -> DataFrame:
    """Catalogue records for file contents.

    ``files`` has ``content, name`` and the order column, optionally ``mime, source, tags, meta`` and
    ``created_at``. A given media type wins over the sniffed one unless it only says "unknown". Ids avoid
    those of an existing catalogue.
    """
    have = set(files.columns)
    opt = {"mime": "string", "source": "string", "tags": "array<string>", "meta": "string"}
    if catalogue is not None:
        catalogue = settle(catalogue.select("id"), "used-ids")
    base = files.withColumns({c: F.lit(None).cast(t) for c, t in opt.items() if c not in have})
    given = F.when((F.lower(F.trim("mime")) != UNKNOWN_MIME) & (F.trim("mime") != ""), F.col("mime"))
    known = {m: e for e, m in reversed(EXTENSION_MIME.items())}
    passed = [c for c in ("path",) if c in have]
    facts = base.select(
        order, *passed, "name", "source", "meta", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        (F.col("created_at") if "created_at" in have else F.current_timestamp()).alias("created_at"),
        hash_content(F.col("content")).alias("sha256"), F.octet_length("content").cast("bigint").alias("size"),
        given.alias("_given"), sniff(F.col("content"), F.col("name")).alias("_kind"))
    named = F.when(file_extension(F.col("name")) != "", file_extension(F.col("name"))).otherwise("bin")
    ext = F.when(F.col("_given").isNotNull(), F.coalesce(_lookup(known, F.col("_given")), named)).otherwise(F.col("_kind.ext"))
    out = facts.withColumns({"mime": F.coalesce("_given", "_kind.mime"), "ext": ext}).drop("_given", "_kind")
    if catalogue is not None:
        out = settle(out, "facts")    # hashed and sniffed once, numbered from there
    return free_ids(out, order, catalogue).select("id", "sha256", "ext", "name", "mime", "size", "created_at",
                                                  "source", "tags", "meta", *passed)


def dedup_blobs(catalogue: DataFrame) -> DataFrame:
    """One row per stored blob: its first registration and how many there are."""
    return catalogue.groupBy("sha256", "ext").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("id"), F.count("*").alias("registrations"),
        F.first("size").alias("size"))


def registrations_by_sha(catalogue: DataFrame) -> DataFrame:
    """Every registration of content that was registered more than once, oldest first when sorted.

    Kept as rows, not lists: one content may have any number of copies.
    """
    often = catalogue.groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1")
    return catalogue.join(often, "sha256").select("sha256", "id", "name", "created_at", "copies")


def list_condition(mime: str | None = None, source: str | None = None, tag: str | None = None,
                   name: str | None = None) -> Column:
    cond = F.lit(True)
    if mime:
        cond = cond & (F.col("mime").startswith(mime[:-1]) if mime.endswith("/*") else F.col("mime") == mime)
    if source:
        cond = cond & F.col("source").startswith(source)
    if tag:
        cond = cond & F.array_contains("tags", tag)
    if name:
        cond = cond & contains_text(F.col("name"), name)
    return cond


def list_files(catalogue: DataFrame, limit: int = 200, offset: int = 0, **filters) -> DataFrame:
    """A page of matching files, newest first, each with the number of matches in all."""
    hits = catalogue.where(list_condition(**filters))
    total = hits.select(F.count("*").alias("n")).scalar()
    return (hits.orderBy(F.col("created_at").desc(), "id").offset(max(0, offset))
            .limit(max(1, limit)).withColumn("total", total))


def search_files(catalogue: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Files whose name or any tag contains the text, newest first."""
    q = needle.strip().lower()
    if not q:
        return catalogue.where(F.lit(False))
    hits = catalogue.where(contains_text(F.col("name"), q) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q))))
    return hits if limit is None else hits.orderBy(F.col("created_at").desc(), "id").limit(limit)


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(cells.clean_ids(tags))


def apply_file_edits(catalogue: DataFrame, edits: DataFrame) -> DataFrame:
    """Renames and tag changes in bulk: ``edits`` has ``id, seq, name, tags``; the last of each wins.

    A blank name is ignored, NULL tags leave the tags alone.
    """
    name = cells.squeeze(F.col("name"))
    last = edits.groupBy("id").agg(
        F.max_by(name, F.when(name != "", F.col("seq"))).alias("_name"),
        F.max_by("tags", F.when(F.col("tags").isNotNull(), F.col("seq"))).alias("_tags"))
    return catalogue.join(last, "id", "left").select(
        *[F.coalesce("_name", "name").alias("name") if c == "name"
          else F.when(F.col("_tags").isNotNull(), clean_tags(F.col("_tags"))).otherwise(F.col("tags")).alias("tags")
          if c == "tags" else F.col(c) for c in catalogue.columns])


def references(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Where each file id is used: one row per (file id, dataset, column, row)."""
    parts = []
    for name, df in datasets.items():
        for f in user_fields(df):
            kind = logical_of(f)
            if kind not in ("file", "file_list"):
                continue
            c = F.col(f"`{f.name}`")
            ids = F.array_distinct(c) if kind == "file_list" else F.array(c)
            parts.append(df.where(c.isNotNull()).select(
                F.explode(ids).alias("file_id"), F.lit(name).alias("dataset"),
                F.lit(display_of(f)).alias("column"), F.col(RID)))
    return reduce(DataFrame.unionByName, parts).where("file_id is not null")


def expand_files(df: DataFrame, catalogue: DataFrame, column: str, row_id: str = RID) -> DataFrame:
    """Replace the ids of a file list column by catalogue records in place; unknown ids become NULL.

    The list is taken apart, joined on the id and put together again per row; a row's list is bounded by
    the row itself. Spark picks broadcast or shuffle for the catalogue by its size.
    """
    rec = F.struct("id", "name", "mime", "size", "sha256", "ext").alias("_rec")
    files = catalogue.select(F.col("id").alias("_fid"), rec)
    parts = df.select(row_id, F.posexplode(column).alias("_pos", "_id"))
    found = parts.join(files, parts["_id"] == files["_fid"], "left")
    lists = found.groupBy(row_id).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", F.col("_rec")))), lambda x: x["_rec"]).alias("_files"))
    none = F.array().cast("array<struct<id:string,name:string,mime:string,size:bigint,sha256:string,ext:string>>")
    cell = F.when(F.col(column).isNotNull(), F.coalesce("_files", none)).alias(column, metadata=df.schema[column].metadata)
    return df.join(lists, row_id, "left").select(*[cell if c == column else F.col(f"`{c}`") for c in df.columns])


def expand_file(df: DataFrame, catalogue: DataFrame, column: str) -> DataFrame:
    """Replace a file cell by its record; text that is no known id stays available as ``<column>_raw``."""
    files = catalogue.select(F.col("id").alias("_fid"),
                             F.struct("id", "name", "mime", "size", "sha256", "ext").alias("_rec"))
    out = df.join(files, cells.squeeze(F.col(column)) == F.col("_fid"), "left")
    cell = F.col("_rec").alias(column, metadata=df.schema[column].metadata)
    return out.select(*[cell if c == column else F.col(f"`{c}`") for c in df.columns],
                      F.when(F.col("_rec").isNull(), F.col(column)).alias(f"{column}_raw"))


class Absorbed:
    """Result of :func:`absorb_output_files`: the rewritten rows and the catalogue records to add."""

    def __init__(self, rows: DataFrame, registered: DataFrame):
        self.rows, self.registered = rows, registered


def absorb_output_files(df: DataFrame, catalogue: DataFrame, listing: DataFrame, column: str, source: str,
                        row_id: str = RID) -> Absorbed:
    """Bring the cells of a result's file column to file ids.

    A known id stays; a record (JSON) becomes its id, or where that is unknown its path is looked up; a path in the listing
    (``path, content``) is registered and becomes the new id; anything else stays as it is. A JSON array
    is treated element by element and stays an array.
    """
    raw = cells.squeeze(F.col(column).cast("string"))
    is_list = F.coalesce(raw.startswith("[") & F.from_json(raw, "array<string>").isNotNull(), F.lit(False))
    items = F.when(is_list, F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    parts = df.where(F.col(column).isNotNull() & (raw != "")).select(
        row_id, is_list.alias("_many"), F.posexplode(items).alias("_pos", "_raw"))
    obj = F.from_json(F.when(F.col("_raw").startswith("{"), F.col("_raw")), "id string, path string")
    # Only what may be an id or a path takes part in the joins, so a text that many cells share is no join key.
    parts = parts.withColumns({
        "_item": F.coalesce(obj["id"], F.when(F.col("_raw").rlike("^[0-9a-f]{8,16}$"), F.col("_raw"))),
        "_place": F.coalesce(obj["path"], F.when(F.contains("_raw", F.lit("/")) & obj.isNull(), F.col("_raw")))})
    known = catalogue.select(F.col("id").alias("_known"))
    paths = listing.select(F.regexp_replace("path", "^file:/*", "/").alias("_path"), "content")
    looked = parts.join(known, parts["_item"] == known["_known"], "left")
    looked = looked.withColumn("_place", F.when(F.col("_known").isNull(), F.col("_place")))
    wanted = looked.where(F.col("_place").isNotNull()).select(F.col("_place").alias("_path")).distinct()
    fresh = wanted.join(paths, "_path").select(
        F.col("_path").alias("path"), "content", F.element_at(F.split("_path", "/"), -1).alias("name"),
        F.lit(source).alias("source"), F.xxhash64("_path").alias("seq"))
    registered = settle(register(fresh, "seq", catalogue), "registered")    # ids must not change between uses
    new_ids = registered.select(F.col("path").alias("_path"), F.col("id").alias("_new"))
    done = looked.join(new_ids, looked["_place"] == new_ids["_path"], "left").withColumn(
        "_out", F.coalesce("_known", "_new", "_raw"))
    back = done.groupBy(row_id).agg(
        F.first("_many").alias("_many"),
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_out"))), lambda x: x["_out"]).alias("_outs"))
    cell = F.when(F.col("_outs").isNull(), F.col(column)).when(F.col("_many"), F.to_json("_outs")).otherwise(F.col("_outs")[0])
    rows = df.join(back, row_id, "left").withColumn(column, cell).drop("_many", "_outs")
    return Absorbed(rows, registered)


def delete_files(catalogue: DataFrame, wanted: DataFrame, used: DataFrame) -> dict[str, DataFrame]:
    """Delete registrations by id, unless a dataset cell still uses them and ``force`` is not set.

    ``wanted`` has ``id, force``. Returns survivors, the refused ids with their number of uses, and the
    blobs that no surviving registration needs any more.
    """
    ask = wanted.groupBy("id").agg(F.bool_or("force").alias("force"))
    uses = used.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("uses"))
    judged = ask.join(catalogue.select("id"), "id", "left_semi").join(uses, "id", "left")
    refused = judged.where(F.col("uses").isNotNull() & ~F.col("force"))
    going = judged.where(F.col("uses").isNull() | F.col("force")).select("id")
    left = catalogue.join(going, "id", "left_anti")
    orphans = (catalogue.join(going, "id", "left_semi").select("sha256", "ext").distinct()
               .join(left.select("sha256").distinct(), "sha256", "left_anti"))
    return {"catalogue": left, "refused": refused.select("id", "uses"), "orphans": orphans}


def view_text(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Text of textual files (``content, mime``), NULL for others; a marker follows when it was cut."""
    content = F.col("content")
    if max_bytes is None:
        shown = F.decode(content, "UTF-8")
    else:
        cut = F.decode(F.substring(content, 1, max_bytes), "UTF-8")
        shown = F.when(F.octet_length(content) > max_bytes, F.concat(cut, F.lit("\n… [truncated]"))).otherwise(cut)
    return df.withColumn("view", F.when(text.is_textual(F.col("mime")), shown))


def file_inventory(catalogue: DataFrame) -> DataFrame:
    """Number of files, distinct contents and bytes per kind of file."""
    by_blob = catalogue.groupBy(text.mime_family(F.col("mime")).alias("family"), "sha256").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return by_blob.groupBy("family").agg(F.sum("n").alias("files"), F.count("*").alias("contents"),
                                         F.sum("bytes").alias("bytes"))
