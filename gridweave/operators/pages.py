"""Jobs over stored pages and search results."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import squeeze
from ..functions.regexes import java_pattern, re_extract
from ..functions.text import first_non_blank, one_line
from .sequence import number_rows

# A host is labels joined by dots; hosts of the search engine itself are left out.
HOST_PATTERN = r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+$"
ENGINE_HOST = r"(?i)(^|\.)google\.[a-z.]+$"
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"

# Named references and, as browsers read them, the numbers 128 to 159: both from the standard library's tables.
REFERENCES = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
CONTROLS = {f"#{n}": html.unescape(f"&#{n};") for n in range(128, 160)}
# The references that nearly all pages make do with; a map is searched from its front.
COMMON = {name: REFERENCES[name] for name in ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "mdash", "ndash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo")}
REFERENCE = r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def unescape_html(c: Column) -> Column:
    """Resolve character references, named and numeric, once; what is none stays as it is."""
    def known(table: dict[str, str], name: Column) -> Column:
        return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), name)

    def resolve(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        digits = F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+)$", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        number = F.when((number < 1) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), 0xFFFD).otherwise(number)
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        value = F.when(name.startswith("#"), F.coalesce(known(CONTROLS, name), letter)).otherwise(
            F.coalesce(known(COMMON, name), F.when(name != "", known(REFERENCES, name))))
        return F.when(value.isNotNull(), F.concat(value, F.substring(piece, F.length(name) + 3, F.length(piece)))).otherwise(piece)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "(?=&)"), resolve), "")).otherwise(c)


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def title_of(source: Column) -> Column:
    return one_line(unescape_html(re_extract(source, TITLE_PATTERN, 1)))


def page_titles(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Title of each wanted page: ``rows`` has any of ``url, target_url, profile_url``.

    Rows without an address vanish; pages that are not stored give ok = no and never fail the job.
    """
    names = [c for c in ("url", "target_url", "profile_url") if c in rows.columns]
    wanted = rows.select(first_non_blank(*[F.col(c) for c in names]).alias("url")).where("url is not null")
    wanted = wanted.withColumn("url", with_scheme(F.col("url")))
    titles = pages.groupBy(F.col("url").alias("_url")).agg(F.min(title_of(F.col("html"))).alias("_title"))
    out = wanted.join(titles, wanted["url"] == titles["_url"], "left")
    return out.select("url", F.coalesce("_title", F.lit("")).alias("title"),
                      F.when(F.col("_url").isNotNull(), "yes").otherwise("no").alias("ok"))


def result_host(url: Column) -> Column:
    """Host of a result; NULL when it is no dotted name or belongs to the search engine."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(host.rlike(HOST_PATTERN) & ~host.rlike(ENGINE_HOST), host)


def rank_results(results: DataFrame, n: int | None = None, query: str = "query",
                 order: Sequence[str] = ("page", "position")) -> DataFrame:
    """Per query: first occurrence of each address in page order, ranked; at most ``n`` are kept.

    Repeats are removed by partial aggregation before ranking. With ``n`` Spark limits each group on the
    map side; without it the ranks are made block by block.
    """
    rest = [c for c in results.columns if c not in (query, "url")]
    firsts = (results.where(F.coalesce(F.col("url"), F.lit("")) != "").groupBy(query, "url")
              .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(query, "url", "_r.*"))
    if n is None:
        return number_rows(firsts, order[0], "rank", keys=[query], ties=[*order[1:], "url"])
    w = W.partitionBy(query).orderBy(*order, "url")
    return firsts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def breadcrumb_to_url(cite: Column) -> Column:
    """A shown breadcrumb as a struct of url, host and whether parts were elided; NULL when it is none."""
    line = squeeze(F.split(squeeze(cite), "\n")[0])
    elided = line.rlike(r"…|\.\.\.")
    path = F.regexp_replace(line, r"\s*[›>]\s*", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"…|\.\.\.", ""), "/+$", "")
    url = F.when(path.rlike(r"^(?i)https?://"), path).otherwise(F.concat(F.lit("https://"), path))
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:]*)", 1))
    good = (line != "") & host.rlike(HOST_PATTERN) & ~host.rlike(ENGINE_HOST)
    full = F.when(url.rlike(r"^(?i)https?://[^/?#]+$"), F.concat(url, F.lit("/"))).otherwise(url)
    return F.when(good, F.struct(full.alias("url"), host.alias("host"), elided.alias("elided")))


def join_url(base: Column, location: Column) -> Column:
    """A location header against the address it came from: absolute, scheme-relative, rooted or relative."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^[^/]+://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return (F.when(location.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), location)
            .when(location.startswith("//"), F.concat(scheme, location))
            .when(location.startswith("/"), F.concat(root, location))
            .when(location.startswith("?"), F.concat(bare, location))
            .otherwise(F.concat(folder, location)))


def resolve_redirects(urls: DataFrame, redirects: DataFrame, hops: int = 5, column: str = "url") -> DataFrame:
    """Follow redirect edges (``url, location``) for at most ``hops`` steps.

    Each hop is one join on the address; only addresses still moving take part, and each distinct one
    is followed once, so a popular link costs one row.
    """
    edges = redirects.where(F.coalesce("location", F.lit("")) != "").groupBy("url").agg(F.min("location").alias("location"))
    edges = edges.select(F.col("url").alias("_from"), join_url(F.col("url"), F.col("location")).alias("_to"))
    state = urls.select(F.col(column).alias("_start")).distinct().select("_start", F.col("_start").alias("_now"), F.lit(0).alias("_hops"))
    for hop in range(1, hops + 1):
        state = state.join(edges, state["_now"] == edges["_from"], "left").select(
            "_start", F.coalesce("_to", "_now").alias("_now"),
            F.when(F.col("_to").isNotNull(), hop).otherwise(F.col("_hops")).alias("_hops"))
    found = state.select(F.col("_start").alias(column), F.col("_now").alias("final_url"), F.col("_hops").alias("hops"))
    return urls.join(found, column, "left")


def resolve_results(results: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """Best address of each result (``redirect, cite_url``): the resolved target when it is a real host,
    else the shown one, else the tracking link itself."""
    out = resolve_redirects(results, redirects, hops, "redirect")
    host = result_host(F.col("final_url"))
    best = F.when(host.isNotNull(), F.col("final_url")).otherwise(
        F.coalesce(F.when(F.col("cite_url") != "", F.col("cite_url")), F.col("redirect")))
    return out.withColumn("url", best)


def classify_text(c: Column, rules: Sequence[tuple[str, str]], default: str = "ok") -> Column:
    """Status of a text by the first rule (status, pattern) that matches, ignoring case."""
    out = F.when(F.lit(False), "")
    for status, pattern in rules:
        out = out.when(c.rlike("(?i)" + java_pattern(pattern)), status)
    return out.otherwise(default)


# Texts that tell why a post was refused, by priority.
REFUSAL_RULES = [
    ("rate_limited", r"you'?re? doing that too much|rate ?limit|try again in \d+ (second|minute|hour)|slow down"
                     r"|too many requests"),
    ("needs_flair", r"please (select|add|choose) (a )?(post )?flair|flair (is )?required"
                    r"|posts must (have|include) (a )?flair"),
    ("not_postable", r"you don'?t have permission to post|posting is restricted|cannot post|can'?t post"
                     r"|requires? (a )?minimum (karma|account|age)|account is too new|not enough karma"
                     r"|you are banned from|posting privileges (have been )?suspended|community requires"
                     r"|please verify your email"),
    ("community_not_found", r"community doesn'?t exist|community (could not be|not) found"
                            r"|there aren'?t any communities on reddit with that name|page not found"
                            r"|sorry,? nobody on reddit goes by that name"),
    ("community_restricted", r"private community|restricted community|quarantined"
                             r"|community has been (banned|removed|made private)"
                             r"|you need to be (an? approved (member|user)|invited)|join this community to post"),
]

# Addresses of published posts.
POST_URL = r"(?i)https?://(?:www\.|old\.)?reddit\.com(/(?:r|user)/[^/]+/comments/[^/]+/[^/?#]+)"
POST_PATH = r"(?i)^/(?:r|user)/[^/]+/comments/[^/]+/[^/?#]+/?"
POST_SITE = "https://www.reddit.com"


def canonical_post_url(current: Column, by_title: Column, first: Column) -> Column:
    """Address of a new post: the current page, else the link with its title, else the first link."""
    def tidy(href: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(href, "/+$", ""), r"[?#].*$", "")
        return F.when(href.rlike(POST_PATH), F.concat(F.lit(POST_SITE), path, F.lit("/")))
    here = re_extract(current, POST_URL, 1)
    return F.coalesce(F.when(here.isNotNull(), F.concat(F.lit(POST_SITE), here, F.lit("/"))),
                      tidy(by_title), tidy(first), F.lit(""))


def canonical_posts(candidates: DataFrame) -> DataFrame:
    """Table form: ``post, kind (url, title, first), href`` candidates to one address per post."""
    pick = {k: F.min_by("href", F.when(F.col("kind") == k, F.col("seq"))).alias(f"_{k}") for k in ("url", "title", "first")}
    one = candidates.groupBy("post").agg(*pick.values())
    return one.select("post", canonical_post_url(F.col("_url"), F.col("_title"), F.col("_first")).alias("post_url"))
