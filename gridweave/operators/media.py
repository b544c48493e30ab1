"""Width and height of images from their headers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JPEG markers of frames that carry the size, and markers without a length.
JPEG_FRAMES = frozenset([0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF])
JPEG_BARE = frozenset([0x01, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9])


def _byte(c: Column, at: int) -> Column:
    """The byte at a zero-based position as a number."""
    return F.conv(F.hex(F.substring(c, at + 1, 1)), 16, 10).cast("int")


def _big(c: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(c, at + 1, n)), 16, 10).cast("bigint")


def _little(c: Column, at: int, n: int) -> Column:
    out = _byte(c, at)
    for i in range(1, n):
        out = out + F.shiftleft(_byte(c, at + i), 8 * i)
    return out.cast("bigint")


def jpeg_size(head: bytes | None) -> tuple[int, int] | None:
    """Walk the segments up to the first frame header."""
    if not head or head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(head):
        if head[at] != 0xFF or head[at + 1] == 0xFF:
            at += 1
            continue
        marker = head[at + 1]
        if marker in JPEG_FRAMES:
            return int.from_bytes(head[at + 7:at + 9], "big"), int.from_bytes(head[at + 5:at + 7], "big")
        at += 2
        if marker not in JPEG_BARE:
            at += int.from_bytes(head[at:at + 2], "big")
    return None


def _jpeg_sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for heads in batches:
        sizes = [jpeg_size(bytes(h)) if h is not None else None for h in heads]
        yield pd.DataFrame({"width": [s[0] if s else -1 for s in sizes], "height": [s[1] if s else -1 for s in sizes]})


def image_size(content: Column, mime: Column) -> tuple[Column, Column]:
    """Native expressions for the formats with fixed offsets: PNG, GIF and WebP."""
    hexed = F.hex(F.substring(content, 1, 30))
    png = (mime == "image/png") & hexed.startswith("89504E470D0A1A0A") & (F.substring(hexed, 25, 8) == "49484452")
    gif = (mime == "image/gif") & hexed.startswith("474946")
    webp = (mime == "image/webp") & hexed.startswith("52494646") & (F.substring(hexed, 17, 8) == "57454250")
    form = F.substring(hexed, 25, 8)
    lossy, lossless, extended = form == "56503820", (form == "5650384C") & (_byte(content, 20) == 0x2F), form == "56503858"
    size = F.octet_length(content)
    png, gif, webp = png & (size >= 24), gif & (size >= 10), webp & (size >= 30)
    packed = _little(content, 21, 2) + F.shiftleft(_little(content, 23, 2), 16)
    width = (F.when(png, _big(content, 16, 4)).when(gif, _little(content, 6, 2))
             .when(webp & lossy, _little(content, 26, 2).bitwiseAND(0x3FFF))
             .when(webp & lossless, packed.bitwiseAND(0x3FFF) + 1)
             .when(webp & extended, _little(content, 24, 3) + 1))
    height = (F.when(png, _big(content, 20, 4)).when(gif, _little(content, 8, 2))
              .when(webp & lossy, _little(content, 28, 2).bitwiseAND(0x3FFF))
              .when(webp & lossless, F.shiftright(packed, 14).bitwiseAND(0x3FFF) + 1)
              .when(webp & extended, _little(content, 27, 3) + 1))
    return width, height


def media_metadata(files: DataFrame, head_bytes: int | None = None) -> DataFrame:
    """Per file (``content, mime`` and any other columns): width, height, status and detail.

    Only JPEG needs a walk through the bytes, done on Arrow batches; its size may stand behind any number of long
    segments. ``head_bytes``: look no further than so many bytes; off by default.
    """
    head = F.col("content") if head_bytes is None else F.substring("content", 1, head_bytes)
    walk = F.pandas_udf(_jpeg_sizes, "width int, height int")
    is_jpeg = F.col("mime").isin("image/jpeg", "image/jpg")
    width, height = image_size(head, F.col("mime"))
    walked = files.withColumn("_jpeg", walk(F.when(is_jpeg, head)))
    sized = walked.withColumns({
        "width": F.when(is_jpeg, F.when(F.col("_jpeg.width") > 0, F.col("_jpeg.width"))).otherwise(width).cast("bigint"),
        "height": F.when(is_jpeg, F.when(F.col("_jpeg.height") > 0, F.col("_jpeg.height"))).otherwise(height).cast("bigint"),
    }).drop("_jpeg")
    known = (F.col("width") > 0) & (F.col("height") > 0)
    status = (F.when(F.col("content").isNull(), "no_file").when(known, "ok")
              .when(F.coalesce(F.col("mime"), F.lit("")) != "", "ok_no_dim").otherwise("unreadable"))
    detail = (F.when(F.col("status") == "no_file", "row has no file").when(F.col("status") == "ok_no_dim", "dimensions unknown")
              .when(F.col("status") == "unreadable", "header not readable").otherwise(""))
    return sized.withColumn("status", status).withColumn("detail", detail)
