"""Small text expressions used by many operators. All are native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import squeeze

# Zero-width characters and the byte order mark.
INVISIBLE = "[\u200b-\u200d\u2060\ufeff]"

# Media types that can be shown as text.
TEXTUAL_MIME = r"^(?i)(text/|application/(json|xml|x-yaml|toml|x-sh|x-python|javascript|sql))"

FILE_ID = "^[0-9a-f]{8}$"


def clip(c: Column, n: int) -> Column:
    """Over ``n`` characters: cut, and say how many were left out."""
    size = F.char_length(c)
    return F.when(size > n, F.concat(F.substring(c, 1, n), F.lit("… (+"), (size - n).cast("string"),
                                     F.lit(" chars)"))).otherwise(c)


def one_line(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"\s+", " "))


def clip_line(c: Column, n: int) -> Column:
    """One line of at most ``n`` characters, with an ellipsis when cut."""
    s = one_line(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def clean_invisible(c: Column) -> Column:
    return one_line(F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, ""))


def slug(c: Column, default: str) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def split_list(c: Column, sep: str = ",") -> Column:
    """A separated list to an array of trimmed, non-blank parts."""
    parts = F.split(F.coalesce(c, F.lit("")), "\\Q" + sep + "\\E")
    return F.filter(F.transform(parts, squeeze), lambda x: x != "")


def first_non_blank(*cols: Column) -> Column:
    """The first column that holds more than white space, trimmed."""
    return F.coalesce(*[F.when(squeeze(c) != "", squeeze(c)) for c in cols])


def _whole(c: Column) -> Column:
    return F.floor(c).cast("bigint").cast("string")


def duration_text(start: Column, end: Column) -> Column:
    s = F.floor(end - start).cast("bigint")
    return (F.when(start.isNull() | (start == 0), "—")
            .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .otherwise(F.concat(_whole(s / 60), F.lit("m "), (s % 60).cast("string"), F.lit("s"))))


def _steps(s: Column) -> Column:
    return (F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .when(s < 3600, F.concat(_whole(s / 60), F.lit("m")))
            .when(s < 86400, F.concat(_whole(s / 3600), F.lit("h")))
            .otherwise(F.concat(_whole(s / 86400), F.lit("d"))))


def relative_time(ts: Column, now: Column) -> Column:
    s = F.floor(now - ts).cast("bigint")
    return F.when(ts.isNull() | (ts == 0), "—").otherwise(F.concat(_steps(s), F.lit(" ago")))


def until_time(ts: Column, now: Column) -> Column:
    s = F.floor(ts - now).cast("bigint")
    return (F.when(ts.isNull() | (ts == 0), "—").when(s <= 0, "now")
            .otherwise(F.concat(F.lit("in "), _steps(s))))


def format_bytes(n: Column) -> Column:
    """Sizes in B, KB, MB and GB; below ten of a bigger unit one decimal is shown."""
    out = F.when(n.isNull() | (n == 0), "empty").when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    units = ["KB", "MB", "GB"]
    for power, unit in enumerate(units, 1):
        v = n / float(1024 ** power)
        shown = F.when(v < 10, F.format_string("%.1f", v)).otherwise(
            F.floor(v + 0.5).cast("bigint").cast("string"))
        here = F.concat(shown, F.lit(" " + unit))
        out = out.otherwise(here) if unit == units[-1] else out.when(v < 1024, here)
    return out


def _accent_pairs() -> tuple[str, str]:
    """Accented Latin letters and the plain letters they decompose to, derived from Unicode itself."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if plain != ch and len(plain) == 1:
            src.append(ch)
            dst.append(plain)
    marks = [chr(code) for code in range(0x300, 0x370) if unicodedata.category(chr(code)) == "Mn"]
    return "".join(src + marks), "".join(dst)


def fold_accents(c: Column) -> Column:
    """Drop accents from Latin text; combining marks have no counterpart and disappear."""
    src, dst = _accent_pairs()
    return F.translate(c, src, dst)


def is_textual(mime: Column) -> Column:
    return F.coalesce(mime.rlike(TEXTUAL_MIME), F.lit(False))


def mime_family(mime: Column) -> Column:
    """The kind of file a media type stands for."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    return (F.when(m.startswith("image/"), "image").when(m.startswith("video/"), "film")
            .when(m.startswith("audio/"), "music").when(m == "application/pdf", "file")
            .when(m.startswith("text/") | m.isin("application/json", "application/xml"), "code")
            .otherwise("file"))


def looks_like_id(c: Column) -> Column:
    return F.coalesce(c.rlike(FILE_ID), F.lit(False))
