"""Planning and accounting of message campaigns: whom, which message, which media, and where it stops.

Nothing here sends anything; outcomes of attempts are input data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import squeeze
from ..functions.regexes import re_extract
from ..functions.text import first_non_blank, one_line
from .sequence import running

# Input columns that may hold an address or a message, by priority.
PROFILE_COLUMNS = ["profile_url", "url", "linkedin_url", "linkedinUrl", "link", "profileUrl"]
COMMUNITY_COLUMNS = ["community", "subreddit", "r", "name", "url", "link", "communityUrl", "subredditUrl"]
MESSAGE_COLUMNS = ["message", "messaggio", "msg"]
POST_COLUMNS = ["message", "messaggio", "msg", "body", "post"]

PROFILE_SITE = "https://www.linkedin.com"
PROFILE_PATH = r"(?i)/in/([^/?#]+)"
COMMUNITY_PATH = r"(?i)(?:^|/)r/([A-Za-z0-9][A-Za-z0-9_]{2,20})(?=/|$|\?|#)"
BARE_COMMUNITY = r"^[A-Za-z0-9][A-Za-z0-9_]{2,20}$"


def _present(df: DataFrame, names: Sequence[str]) -> Column:
    # exact spelling only, as names that differ in case are different aliases
    cols = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return first_non_blank(*cols) if cols else F.lit(None).cast("string")


def profile_url(raw: Column) -> Column:
    """A profile address in one spelling; blank for anything that is no profile."""
    key = re_extract(raw, PROFILE_PATH, 1)
    bare = F.regexp_replace(raw, "^/+|/+$", "")
    return F.coalesce(F.when(key.isNotNull(), F.concat(F.lit(PROFILE_SITE + "/in/"), key, F.lit("/")))
                      .when(~raw.rlike("^https?://"), F.concat(F.lit(PROFILE_SITE + "/in/"), bare, F.lit("/"))), F.lit(""))


def canonical_profile_url(df: DataFrame, name: str = "canonical_url") -> DataFrame:
    return df.withColumn(name, profile_url(_present(df, PROFILE_COLUMNS)))


def community_name(raw: Column) -> Column:
    """The bare community name from a path, address or name; blank for user pages and anything else."""
    bare = F.regexp_replace(raw, "^/+|/+$", "")
    named = re_extract(raw, COMMUNITY_PATH, 1)
    user = F.lower(bare).rlike("^(u|user)/")
    return F.coalesce(named, F.when(~user & bare.rlike(BARE_COMMUNITY), bare), F.lit(""))


def canonical_community(df: DataFrame, name: str = "canonical_community") -> DataFrame:
    return df.withColumn(name, community_name(_present(df, COMMUNITY_COLUMNS)))


def parse_variants(c: Column, collapse: bool = False) -> Column:
    """Message variants: a JSON array, else parts between double pipes; trimmed, blanks dropped."""
    s = squeeze(F.coalesce(c, F.lit("")))
    listed = F.when(s.startswith("["), F.from_json(s, "array<string>"))
    listed = F.when(F.size(listed) > 0, listed)
    parts = F.coalesce(listed, F.split(s, r"\|\|"))
    return F.filter(F.transform(parts, one_line if collapse else squeeze), lambda x: F.coalesce(x, F.lit("")) != "")


def row_message(df: DataFrame, names: Sequence[str] = MESSAGE_COLUMNS, collapse: bool = False) -> Column:
    c = _present(df, names)
    return one_line(c) if collapse else c


def plan_campaigns(attempts: DataFrame, variants: Mapping[str, Sequence[str]] | Sequence[str] | Column, cap: int = 0,
                   stop_on: Sequence[str] = ("rate_limited", "limit_reached"), success: str = "sent",
                   campaign: str = "campaign", order: str = "seq", blocks: int | None = None) -> DataFrame:
    """Status and message of every attempt of every campaign, in order.

    ``attempts`` has campaign, order, ``outcome`` (what the attempt returned), ``row_message`` and
    optionally the booleans ``valid`` and ``media_ok``. ``variants`` is a list or an array column of
    fallback messages. Invalid rows stay invalid; after the cap-th success or a stopping outcome every
    valid row is skipped; a row without a message or with bad media is not attempted. The fallback
    message is the n-th variant, n being the earlier successful fallback sends.

    One pass of block-wise running sums decides all of it, also for a single campaign of any size.
    """
    have = set(attempts.columns)
    own = F.coalesce(squeeze(F.col("row_message")), F.lit(""))
    options = variants if isinstance(variants, Column) else F.array(*[F.lit(v) for v in variants]).cast("array<string>")
    n = F.size(options)
    base = attempts.withColumns({
        "_valid": F.coalesce(F.col("valid"), F.lit(False)) if "valid" in have else F.lit(True),
        "_media": F.coalesce(F.col("media_ok"), F.lit(True)) if "media_ok" in have else F.lit(True),
        "_own": own, "_options": options})
    tried = F.col("_valid") & F.col("_media") & ((F.col("_own") != "") | (F.size("_options") > 0))
    good = tried & (F.col("outcome") == success)
    flags = {"_sent": good, "_fallback": good & (F.col("_own") == ""), "_stops": tried & F.col("outcome").isin(list(stop_on))}
    one = {k: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0).cast("bigint") for k, c in flags.items()}
    run = running(base.withColumns({f"_is{k}": c for k, c in one.items()}), [campaign], order,
                  {k: F.col(f"_is{k}") for k in one}, blocks=blocks)
    before = {k: F.col(k) - F.col(f"_is{k}") for k in one}
    stopped = before["_stops"] > 0
    if cap:
        stopped = stopped | (before["_sent"] >= cap)
    fallback = F.get(F.col("_options"), (before["_fallback"] % F.greatest(F.size("_options"), F.lit(1))).cast("int"))
    status = (F.when(~F.col("_valid"), "invalid_input").when(stopped, "skipped")
              .when((F.col("_own") == "") & (F.size("_options") == 0), "no_message")
              .when(~F.col("_media"), "media_invalid").otherwise(F.coalesce("outcome", F.lit("error"))))
    out = run.withColumn("status", status)
    message = F.when(~F.col("status").isin("invalid_input", "skipped", "no_message"),
                     F.when(F.col("_own") != "", F.col("_own")).otherwise(fallback))
    out = out.withColumns({"message": message, "personal": F.col("_own") != ""})
    return out.drop("_valid", "_media", "_own", "_options", *one, *[f"_is{k}" for k in one])


def resolve_message(attempts: DataFrame, variants, **options) -> DataFrame:
    """Only the message choice: no cap and no stopping."""
    return plan_campaigns(attempts, variants, cap=0, stop_on=[], **options)


def apply_cap(attempts: DataFrame, variants, cap: int, **options) -> DataFrame:
    return plan_campaigns(attempts, variants, cap=cap, **options)


def no_message_short_circuit(attempts: DataFrame, has_variants: Column, campaign: str = "campaign") -> DataFrame:
    """Campaigns without any message: every row is an error. Others keep a NULL status."""
    own = F.coalesce(squeeze(F.col("row_message")), F.lit("")) != ""
    any_own = attempts.groupBy(F.col(campaign).alias("_c")).agg(F.bool_or(own | has_variants).alias("_any"))
    joined = attempts.join(any_own, F.col(campaign) == F.col("_c"), "left")
    return joined.withColumns({
        "status": F.when(~F.col("_any"), "error"),
        "detail": F.when(~F.col("_any"), "no message configured").otherwise("")}).drop("_c", "_any")


def campaign_summary(plan: DataFrame, campaign: str = "campaign") -> DataFrame:
    """Rows per campaign and status, split into personal and fallback messages."""
    used = F.col("message").isNotNull()
    return plan.groupBy(campaign, "status").agg(
        F.count("*").alias("rows"), F.count_if(used & F.col("personal")).alias("personal"),
        F.count_if(used & ~F.col("personal")).alias("fallback"))


TITLE_LIMIT = 300
SHORT_POST = 280


def title_body(c: Column) -> Column:
    """A message as a struct of title and body: a blank line divides them, a short line is all title,
    otherwise the first sentence is the title and the whole message the body."""
    msg = squeeze(F.coalesce(c, F.lit("")))
    split_at = F.locate("\n\n", msg)
    head, tail = F.substring(msg, F.lit(1), split_at - 1), squeeze(F.substring(msg, split_at + 2, F.length(msg)))
    sentence = F.split(msg, r"(?<=[.!?…])\s+", 2)[0]

    def fit(t: Column) -> Column:
        t = one_line(t)
        cut = F.concat(F.regexp_replace(F.substring(t, 1, TITLE_LIMIT - 2), r"\s+$", ""), F.lit("…"))
        t = F.when(F.length(t) > TITLE_LIMIT - 1, cut).otherwise(t)
        return F.when(t == "", "Hello").otherwise(t)

    def both(title: Column, body: Column) -> Column:
        return F.struct(title.alias("title"), body.alias("body"))

    return (F.when(msg == "", both(F.lit("Hello"), F.lit("")))
            .when(split_at > 0, both(fit(head), tail))
            .when((F.instr(msg, "\n") == 0) & (F.length(msg) <= SHORT_POST), both(msg, F.lit("")))
            .otherwise(both(fit(sentence), msg)))


# What may be attached.
GALLERY_IMAGES = ["image/jpeg", "image/jpg", "image/png", "image/webp", "image/gif"]
GALLERY_VIDEOS = ["video/mp4", "video/quicktime"]
MESSAGE_MIMES = ["image/jpeg", "image/jpg", "image/png", "image/gif", "image/webp", "video/mp4", "video/quicktime",
                 "application/pdf", "application/msword",
                 "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
                 "application/vnd.ms-powerpoint",
                 "application/vnd.openxmlformats-officedocument.presentationml.presentation",
                 "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
                 "text/plain", "message/rfc822"]
GALLERY_MAX_IMAGES, GALLERY_MAX_VIDEOS, MESSAGE_MAX_FILES = 20, 1, 10


def validate_media(files: Column, policy: str) -> Column:
    """A struct of kind and detail for a row's file records (``name, mime, size``; NULL size = not there).

    ``gallery``: listed images up to twenty or one video, never both. ``message``: up to ten listed
    files. The first rule broken gives the detail; an empty detail means the media is fine.
    """
    fs = F.filter(files, lambda f: f.isNotNull())
    total = F.when(files.isNull(), 0).otherwise(F.size(fs))

    def count(test) -> Column:
        return F.size(F.filter(fs, lambda f: F.coalesce(test(f), F.lit(False))))

    mime = lambda f: F.lower(F.coalesce(f["mime"], F.lit("")))
    gone = lambda f: f["size"].isNull()
    empty = lambda f: f["size"] == 0

    def verdict(kind: str | Column, detail: str | Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                        (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))

    if policy == "gallery":
        images, videos = count(lambda f: mime(f).isin(GALLERY_IMAGES)), count(lambda f: mime(f).isin(GALLERY_VIDEOS))
        return (F.when(total == 0, verdict("", "")).when(images + videos < total, verdict("", "unsupported type"))
                .when((images > 0) & (videos > 0), verdict("", "images and video mixed"))
                .when(videos > GALLERY_MAX_VIDEOS, verdict("", "too many videos"))
                .when(videos > 0, verdict("video", ""))
                .when(images > GALLERY_MAX_IMAGES, verdict("", "too many images"))
                .when(count(gone) > 0, verdict("", "missing file")).when(count(empty) > 0, verdict("", "empty file"))
                .otherwise(verdict("images", "")))
    return (F.when(total == 0, verdict("", "")).when(total > MESSAGE_MAX_FILES, verdict("", "too many files"))
            .when(count(lambda f: ~mime(f).isin(MESSAGE_MIMES)) > 0, verdict("", "unsupported type"))
            .when(count(gone) > 0, verdict("", "missing file")).when(count(empty) > 0, verdict("", "empty file"))
            .otherwise(verdict("files", "")))
