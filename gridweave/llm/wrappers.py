"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over a host's token streams (start tags, end tags, texts), kept
nested as the tags are. It is inferred by aligning one page after the other with what is there so far:

* tags that meet are merged, and the streams inside them aligned in turn;
* texts that meet and differ become a text slot;
* neighbours of the same tag become a repeated group;
* what only one side has becomes an optional group;
* a stream in which the same tags keep coming back in changing order becomes a repeated group of optional ones.

Its size thus follows the number of different tags of a template, not that of pages. Every task aligns the pages
it reads and gives one partial wrapper per host; these are aligned with each other in rounds, ``FAN_IN`` partials
after another in one stream, so a host with a third of all pages is spread like any other.

A tag counts with its role, its class words without digits, and an id that names a side part; ids and numbered classes are a
page's own, and would let the wrapper grow with the pages. Parts of the wrapper are then named: menus, headers, footers, side
bars, notices, adverts, forms, comments and the like by their tag or role, or by a class or id that is, begins or ends
with such a word; the main part is the article or main element. Class words do not make a side part of a main
element, or of what stands around the only ones if the text outside of side parts is no longer; and not, adverts
and comments apart, of a part that the host's wrapper shows to hold long varying text with few links. On hosts
without a main part, it is the whole body less groups that are mostly links. A page's tokens are aligned with the
wrapper, which tells which of its lines to keep, in the main part as well: what stands around the slots and groups that
vary, and is the same on all pages, is template.

A line is fixed if it stands at the same part of the wrapper on all different pages of its host, of which there must be
two. Pages are different if the lines of their main parts are; copies count as one, and so do repeats within a page. The
count is exact: a second pass aligns the pages with the wrappers and gives a hash for each line, which are counted by
Spark. Fixed lines before the first and after the last line that is a page's own are template; those between, such as
the headings of a recipe, belong to the article. A page of which less than ``OWN_SHARE`` would be left is a copy with
small changes, and keeps all.

Wrappers are a few KB per host. They are broadcast up to ``BROADCAST_BYTES`` in total, and joined to the pages by host
beyond that.

Defined results: a NULL or empty html has an empty text; a NULL url, or one without a host, belongs to the
nameless host; ``<br>`` and block tags end a block; repeated rows stay repeated; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, shuffle_width
from .batches import Rows, texts_of
from .registry import query

BROADCAST_BYTES = 32 << 20
FAN_IN = 64
#: A stream with more elements, or with an element more often, is taken for a repeated group of optional ones.
MOST_ELEMENTS, MOST_RETURNS = 24, 2
#: Tags nested deeper than this are passed over, as in browsers; their texts belong to the tag around them.
MOST_DEPTH = 256
#: A page with a smaller share of lines of its own, by characters, is taken for a copy of others.
OWN_SHARE = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
SELF_CLOSING = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
SELF_CLOSING = {k: frozenset(v.split()) for k, v in SELF_CLOSING.items()}
CLOSED_BY = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
             "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"]), "p": frozenset()}
SIDE_TAGS = frozenset("head title nav header footer aside form menu button select dialog fieldset".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer sidebar aside widget related recommended notice cookie cookies consent gdpr popup modal overlay alert subscribe "
    "newsletter signup login share sharing social comment comments disqus reply replies respond pagination pager toolbar form search "
    "disclaimer copyright".split())
#: Of these, what stays a side part however long its text is.
FIRM_WORDS = frozenset("ad ads advert adverts advertisement adbox sponsor sponsored promo comment comments disqus reply replies respond".split())
#: Words that tell of a state, not of what a part is: has-sidebar, layout-right-sidebar, long-form, ad-free, comments-open.
STATE_FIRST = frozenset("has have with no non not without hide hides show shows is layout long full free".split())
STATE_LAST = frozenset("free less open opened closed off on enabled disabled active inactive visible hidden none work works".split())
#: Text of a part, in characters each time, that is long.
LONG_TEXT = 200
MAIN_TAGS, MAIN_ROLES = frozenset(["article", "main"]), frozenset(["main", "article"])

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What stands in a tag up to its end, a ">" in quotes passed over.
INSIDE = re.compile("(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Tag:
    """An element of a page: its key (name and marks), and its content: tags and texts."""

    __slots__ = ("key", "name", "content")

    def __init__(self, key: str, name: str) -> None:
        self.key, self.name = key, name
        self.content: list[Tag | str] = []


def key_of(name: str, attributes: str) -> str:
    """Tag name, then class words without digits and those words of class and id that name a side part, then role."""
    if not attributes or "=" not in attributes:
        return name
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    words = sorted({w for k in ("class", "id") for raw in found.get(k, "").lower().split() for w in [re.sub(r"\d+", "0", raw)]
                    if side_word(f"{name} {w}") or (k == "class" and w == raw)})
    role = found.get("role", "").strip().lower()
    return name + "".join(f" {w}" for w in words) + (f" @{role}" if role else "")


def tags_of(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``start, end, slash, name, attributes`` of every tag, and of comments and declarations with an empty name, as long
    as the caller goes on from their end; :meth:`send` goes on from another place. Takes time in proportion to the source
    also where tags or quotes never close: such a quote is found once, and tags up to it end at the next ">"."""
    at, unclosed = 0, 0
    last = source.rfind(">")
    while True:
        start = source.find("<", at)
        if start < 0:
            return
        slash = name = attributes = ""
        m = NAME.match(source, start + 1)
        if source.startswith("<!--", start):
            found = source.find("-->", start + 4)
            end = found + 3 if found >= 0 else len(source)
        elif start > last:
            return
        elif m:
            stop = INSIDE.match(source, m.end()).end() if start >= unclosed else -1
            if stop < 0 or source[stop:stop + 1] != ">":
                unclosed = max(unclosed, stop)
                stop = source.find(">", start)
            end, slash, name, attributes = stop + 1, m[1], m[2].lower(), source[m.end():stop]
        elif source[start + 1:start + 2] in ("!", "?"):
            end = source.find(">", start) + 1
        else:
            at = start + 1
            continue
        at = (yield start, end, slash, name, attributes) or end


def parse(source: str) -> Tag:
    """The page as nested tags. Tags left open are closed as far as the next ones require it."""
    root = Tag("", "")
    open_ = [root]
    passed: dict[str, int] = {}
    at = further = 0
    tags = tags_of(source)
    while True:
        try:
            start, end, slash, name, attributes = tags.send(further or None)
        except StopIteration:
            if at < len(source):
                open_[-1].content.append(source[at:])
            break
        if start > at:
            open_[-1].content.append(source[at:start])
        at, further = end, 0
        if not name:
            continue
        if slash:
            if passed.get(name):
                passed[name] -= 1
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    del open_[i:]
                    break
                if name in INLINE and open_[i].name not in INLINE:
                    break
            continue
        if name not in INLINE:
            while open_[-1].name in INLINE or (open_[-1].name == "p" and name not in VOID):
                open_.pop()
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name in SELF_CLOSING.get(name, ()):
                    del open_[i:]
                    break
                if open_[i].name in CLOSED_BY.get(name, ()):
                    break
                if open_[i].name not in INLINE and open_[i].name not in SELF_CLOSING:
                    break
        if len(open_) > MOST_DEPTH and name not in RAW and name not in VOID:
            passed[name] = passed.get(name, 0) + (not attributes.endswith("/"))
            continue
        tag = Tag(key_of(name, attributes), name)
        open_[-1].content.append(tag)
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
                at = further = source.find(">", close.end()) + 1 or len(source) if close else len(source)
        elif name not in VOID and not attributes.endswith("/"):
            open_.append(tag)
    return root


class Part:
    """A part of a wrapper: a tag (or "#" for a text) with its content, whether it may be missing or come again.

    ``bag``: the content is a repeated group of optional parts. ``text``: the checksum of a text that has been the
    same so far, None for a slot. ``pages``, ``chars``, ``linked``: how often it was seen, characters of text, and those
    in links.
    """

    __slots__ = ("key", "optional", "repeated", "bag", "text", "pages", "chars", "linked", "content")

    def __init__(self, key: str, optional=False, repeated=False, bag=False, text=None, pages=1, chars=0, linked=0, content=None) -> None:
        self.key, self.optional, self.repeated, self.bag, self.text = key, bool(optional), bool(repeated), bool(bag), text
        self.pages, self.chars, self.linked = pages, chars, linked
        self.content: list[Part] = content if content is not None else []

    def dump(self) -> list:
        return [self.key, int(self.optional), int(self.repeated), int(self.bag), self.text, self.pages, self.chars, self.linked,
                [p.dump() for p in self.content]]

    @staticmethod
    def load(data: list) -> Part:
        return Part(*data[:8], content=[Part.load(d) for d in data[8]])

    def pattern(self) -> str:
        """The wrapper as a regular expression to read."""
        if self.key == "#":
            out = "TEXT" if self.text is None else "text"
        else:
            inner = " ".join(p.pattern() for p in self.content)
            out = f"<{self.key}>" + (f"({inner})*" if self.bag else inner) + "</>"
        return f"({out})" + "+" * self.repeated + "?" * self.optional if self.repeated or self.optional else out


def _absorb(into: Part, other: Part) -> Part:
    """Two parts of the same key made one."""
    into.optional |= other.optional
    into.repeated |= other.repeated
    if into.key == "#" and into.text != other.text:
        into.text = None
    into.content, into.bag = align(into.content, into.bag, other.content, other.bag)
    into.pages += other.pages
    into.chars += other.chars
    into.linked += other.linked
    return into


def _bag(*streams: list[Part]) -> list[Part]:
    by_key: dict[str, Part] = {}
    for part in (p for s in streams for p in s):
        part.optional = True
        by_key[part.key] = _absorb(by_key[part.key], part) if part.key in by_key else part
    return sorted(by_key.values(), key=lambda p: p.key)


def _tidy(stream: list[Part]) -> tuple[list[Part], bool]:
    """Neighbours of one key as a repeated part; a stream without order as a bag."""
    out: list[Part] = []
    for part in stream:
        if out and out[-1].key == part.key:
            optional = out[-1].optional and part.optional
            _absorb(out[-1], part)
            out[-1].optional, out[-1].repeated = optional, part.key != "#"
        else:
            out.append(part)
    keys = [p.key for p in out if p.key != "#"]
    if len(out) > MOST_ELEMENTS or any(keys.count(k) > MOST_RETURNS for k in set(keys)):
        return _bag(out), True
    return out, False


def align(a: list[Part], a_bag: bool, b: list[Part], b_bag: bool) -> tuple[list[Part], bool]:
    """One stream for both: what meets is merged, what only one has is optional."""
    if a_bag or b_bag:
        return _bag(a, b), True
    if [p.key for p in a] == [p.key for p in b]:
        return [_absorb(x, y) for x, y in zip(a, b, strict=True)], False
    out: list[Part] = []
    for _, a1, a2, b1, b2 in SequenceMatcher(None, [p.key for p in a], [p.key for p in b], autojunk=False).get_opcodes():
        if a2 - a1 == b2 - b1 and all(x.key == y.key for x, y in zip(a[a1:a2], b[b1:b2], strict=True)):
            out += [_absorb(x, y) for x, y in zip(a[a1:a2], b[b1:b2], strict=True)]
            continue
        for part in (*a[a1:a2], *b[b1:b2]):
            part.optional = True
            out.append(part)
    return _tidy(out)


def part_of(tag: Tag, linked: bool = False) -> Part:
    """The wrapper of one page alone."""
    linked |= tag.name == "a"
    stream = []
    for item in tag.content:
        if isinstance(item, str):
            words = " ".join(item.split())
            if words:
                stream.append(Part("#", text=crc32(words.encode("utf-8", "surrogatepass")), chars=len(words), linked=len(words) * linked))
        else:
            stream.append(part_of(item, linked))
    stream, bag = _tidy(stream)
    return Part(tag.key, bag=bag, content=stream, chars=sum(p.chars for p in stream), linked=sum(p.linked for p in stream))


def join_wrappers(a: Part, b: Part) -> Part:
    return _absorb(a, b)


@lru_cache(1 << 16)
def is_hard_side(key: str) -> bool:
    """A side part by its tag or role."""
    name, *marks = key.split(" ")
    return name in SIDE_TAGS or name in RAW or any(m[1:] in SIDE_ROLES for m in marks if m.startswith("@"))


@lru_cache(1 << 16)
def side_word(key: str) -> str:
    """How classes and id call this a side part: "firm" (adverts, comments), "whole", "compound", or not at all ("")."""
    name, *marks = key.split(" ")
    found = ""
    if name in ("html", "body"):
        return found
    for mark in (m for m in marks if not m.startswith("@")):
        words = [w for w in re.split(r"[-_0]+", mark) if w]
        if mark not in SIDE_WORDS and len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
            continue
        heads = {mark, words[0], words[-1]} & SIDE_WORDS if words else set()
        if heads & FIRM_WORDS:
            return "firm"
        if heads:
            found = "whole" if found == "whole" or len(words) == 1 else "compound"
    return found


def is_side(key: str) -> bool:
    return is_hard_side(key) or bool(side_word(key))


@lru_cache(1 << 16)
def is_main(key: str) -> bool:
    name, *marks = key.split(" ")
    return name in MAIN_TAGS or any(m[1:] in MAIN_ROLES for m in marks if m.startswith("@"))


def is_passed(key: str) -> bool:
    """Side parts in the search for main elements, which only count as such as adverts and comments beside others."""
    return is_hard_side(key) or (side_word(key) == "firm" if is_main(key) else bool(side_word(key)))


def has_main(content: list) -> bool:
    """Whether an article or main element with text stands in these parts (or tags), outside of side parts."""
    for item in content:
        if isinstance(item, str) or item.key == "#" or is_passed(item.key):
            continue
        if is_main(item.key) and _has_text(item):
            return True
        if has_main(item.content):
            return True
    return False


def _has_text(item) -> bool:
    return any(x.strip() if isinstance(x, str) else x.key == "#" or (not is_passed(x.key) and _has_text(x)) for x in item.content)


def _chars(tag: Tag, passed=is_hard_side) -> int:
    """Characters of text that is no link, outside of side parts."""
    return sum(len("".join(x.split())) if isinstance(x, str) else 0 if passed(x.key) or x.name == "a" else _chars(x, passed) for x in tag.content)


def mains_in_side_parts(page: Tag) -> set[int]:
    """Ids of the main elements of a page and of what stands around them, where only class words hide them.

    None if they hold less text than stands on the page outside of side parts.
    """
    found: set[int] = set()
    chars = 0

    def look(tag: Tag) -> bool:
        nonlocal chars
        any_ = False
        for item in tag.content:
            if isinstance(item, str) or is_hard_side(item.key):
                continue
            inner = look(item) if not is_main(item.key) else False
            if is_main(item.key) and (own := _chars(item)):
                chars += own
                spare(item)
                inner = True
            if inner:
                found.add(id(item))
                any_ = True
        return any_

    def spare(main: Tag) -> None:
        """Main elements in a main element, and what is around these, are not passed over either."""
        for item in main.content:
            if not isinstance(item, str) and not is_hard_side(item.key) and is_main(item.key):
                found.add(id(item))
                spare(item)

    look(page)
    return found if chars >= _chars(page, is_side) else set()


def hash_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _part_chars(part: Part) -> int:
    """Characters of text outside of side tags and roles."""
    return part.chars if part.key == "#" else sum(_part_chars(p) for p in part.content if not is_hard_side(p.key))


def _varies(part: Part) -> bool:
    return part.text is None if part.key == "#" else any(_varies(p) for p in part.content)


class Extractor:
    """The texts of pages of one host by its wrapper. ``template``: places and hashes of the lines to leave out."""

    def __init__(self, wrapper: Part, template: Iterable[tuple[int, int]] = ()) -> None:
        self.wrapper, self.template = wrapper, frozenset(template)
        self.plain: dict[int, bool] = {}
        self.places: dict[int, int] = {id(wrapper): 0}
        self._number([wrapper])

    def _number(self, pooled: list[Part]) -> None:
        """A number for every part that is a tag; those of one key in one stream share it."""
        by_key: dict[str, list[Part]] = {}
        for part in (p for above in pooled for p in above.content if p.key != "#"):
            by_key.setdefault(part.key, []).append(part)
        number = len(set(self.places.values()))
        for i, parts in enumerate(by_key.values()):
            self.places.update((id(p), number + i) for p in parts)
        for parts in by_key.values():
            self._number(parts)

    def lines(self, source: str) -> list[tuple[int, str]]:
        """The lines of the main part, each with the number of the wrapper's part it stands in (-1: in none)."""
        page = parse(source)
        self.blocks: list[tuple[int, str]] = []
        self.line: list[str] = []
        self.place = -1
        # A page of another make than its host's others is read by what it has itself.
        self.only_main, self.spared = has_main(page.content), frozenset()
        if not self.only_main:
            self.spared = mains_in_side_parts(page)
            self.only_main = bool(self.spared)
        self._walk(page, self.wrapper, not self.only_main, 0)
        self._end_block()
        return self.blocks

    def text(self, source: str) -> str:
        lines = self.lines(source)
        if self.template:
            own = [i for i, (place, line) in enumerate(lines) if (place, hash_of(line)) not in self.template]
            left = lines[own[0]:own[-1] + 1] if own else []
            if sum(len(line) for _, line in left) >= OWN_SHARE * sum(len(line) for _, line in lines):
                lines = left
        return "\n".join(line for _, line in lines)

    def _end_block(self) -> None:
        words = " ".join(html.unescape("".join(self.line)).split())
        if words:
            self.blocks.append((self.place, words))
        self.line = []

    def _walk(self, tag: Tag, part: Part | None, inside: bool, place: int) -> None:
        """``place``: the number of the wrapper's part that the block around it meets."""
        for item, met in self._met(tag, part):
            if isinstance(item, str):
                if inside:
                    if not self.line:
                        self.place = place
                    self.line.append(item)
                continue
            block = item.name not in INLINE
            if block:
                self._end_block()
            links = not self.only_main and met is not None and met.key.split(" ")[0] in ("ul", "ol", "table", "div") and (
                2 * met.linked > met.chars)
            if not self._is_side(item, met) and not links:
                here = place if not block or item.name in VOID else self.places[id(met)] if met is not None else -1
                self._walk(item, met, inside or is_main(item.key), here)
            if block:
                self._end_block()

    def _is_side(self, item: Tag, met: Part | None) -> bool:
        if is_hard_side(item.key):
            return True
        word = side_word(item.key)
        if not word or id(item) in self.spared:
            return False
        if word == "firm" or is_main(item.key):
            return word == "firm"
        return not self._is_plain(met, word)

    def _is_plain(self, part: Part | None, word: str) -> bool:
        """Whether the wrapper has long varying text with few links here; for a whole word also most text of the host."""
        if part is None:
            return False
        if id(part) not in self.plain:
            self.plain[id(part)] = (
                part.chars >= LONG_TEXT * part.pages and 4 * part.linked <= part.chars and (self.wrapper.pages == 1 or _varies(part))
                and (word == "compound" or 2 * part.chars > _part_chars(self.wrapper)))
        return self.plain[id(part)]

    def _met(self, tag: Tag, part: Part | None) -> Iterator[tuple[Tag | str, Part | None]]:
        """The content of a tag, each with the part of the wrapper that it meets."""
        if part is None or part.bag or not part.content:
            by_key = {p.key: p for p in part.content} if part else {}
            for item in tag.content:
                yield item, by_key.get("#" if isinstance(item, str) else item.key)
            return
        # Parts come in order; one that repeats stays until another is met.
        parts, at = part.content, 0
        for item in tag.content:
            key = "#" if isinstance(item, str) else item.key
            found = next((i for i in range(at, len(parts)) if parts[i].key == key), None)
            if found is None:
                yield item, next((p for p in parts if p.key == key), None)
            else:
                at = found if parts[found].repeated or key == "#" else found + 1
                yield item, parts[found]


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


PARTIAL = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, n_pages, wrapper`` (nested JSON) for every host."""
    spark = pages.sparkSession

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[str, Part] = {}
        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), texts_of(batch, "html"), strict=True):
                one = part_of(parse(source))
                partial[host] = join_wrappers(partial[host], one) if host in partial else one
        rows = Rows(PARTIAL)
        for host, part in partial.items():
            data = json.dumps(part.dump(), separators=(",", ":"))
            rows.add((host, crc32(data.encode()) & 0x7FFFFFFF, data), len(data))
            if rows.full():
                yield rows.take()
        yield from rows.rest()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, part = Rows(PARTIAL), None, None
        for batch in batches:
            for host, salt, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                more = Part.load(json.loads(data))
                if (host, salt) == now:
                    part = join_wrappers(part, more)
                    continue
                if part is not None:
                    rows.add((*now, json.dumps(part.dump(), separators=(",", ":"))))
                    if rows.full():
                        yield rows.take()
                now, part = (host, salt), more
        if part is not None:
            rows.add((*now, json.dumps(part.dump(), separators=(",", ":"))))
        yield from rows.rest()

    fields = "host string, salt int, wrapper string"
    partial = settle(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(start, fields), "wrappers")
    most = partial.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        groups = max(1, -(-most // FAN_IN))
        salted = partial.withColumn("salt", F.pmod("salt", F.lit(groups)).cast("int"))
        merged = (salted.repartition(shuffle_width(spark), "host", "salt").sortWithinPartitions("host", "salt", "wrapper")
                  .mapInArrow(merge, fields))
        if groups == 1:
            n_pages = F.get_json_object("wrapper", "$[5]").cast("bigint")
            return merged.select("host", n_pages.alias("n_pages"), "wrapper")
        partial, most = settle(merged.withColumn("salt", F.pmod(F.hash("wrapper"), F.lit(1 << 30))), "wrappers"), groups


LINE = pa.schema([("host", pa.string()), ("place", pa.int32()), ("line", pa.int64()), ("page", pa.int64())])
TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
#: The place under which a page itself is counted.
PAGE = -2


class Sent:
    """What is known of the hosts, for the pages: broadcast up to a size, else joined to the pages by host."""

    def __init__(self, pages: DataFrame, known: DataFrame, broadcast_bytes: int) -> None:
        size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + F.octet_length("template"))).first()[0] or 0
        self.shipped, self.pages = None, pages
        if size <= broadcast_bytes:
            rows = known.select("host", "wrapper", "template").collect()
            self.shipped = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["wrapper"], r["template"]) for r in rows})
        else:
            self.pages = pages.join(known.select("host", "wrapper", "template"), "host", "left")


def extractors(batch: pa.RecordBatch, shipped, known: dict[str, Extractor]) -> Iterator[tuple[str, str, Extractor]]:
    """Host, html and extractor of every row; ``known`` keeps the extractors of up to 1000 hosts."""
    given = list(zip(batch.column("wrapper").to_pylist(), batch.column("template").to_pylist(), strict=True)) if shipped is None else None
    for i, (host, source) in enumerate(zip(batch.column("host").to_pylist(), texts_of(batch, "html"), strict=True)):
        if host not in known:
            if len(known) >= 1000:
                known.clear()
            wrapper, template = given[i] if given else shipped.value[host]
            known[host] = Extractor(Part.load(json.loads(wrapper)), map(tuple, json.loads(template)))
        yield host, source, known[host]


def template_lines(pages: DataFrame, wrappers: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``wrappers`` with ``template``: place and hash (nested JSON) of the lines that all different pages of a host share.

    ``pages`` has ``host`` and ``html``. A host with a single page has none.
    """
    sent = Sent(pages.select("host", "html"), wrappers.withColumn("template", F.lit("[]")), broadcast_bytes)
    shipped = sent.shipped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(LINE)
        known: dict[str, Extractor] = {}
        for batch in batches:
            for host, source, extractor in extractors(batch, shipped, known):
                if extractor.wrapper.pages < 2:
                    continue
                lines = extractor.lines(source)
                page = hash_of("\n".join(line for _, line in lines))
                rows.add((host, PAGE, 0, page))
                for place, line in {(place, hash_of(line)) for place, line in lines}:
                    rows.add((host, place, line, page))
                if rows.full():
                    yield rows.take()
        yield from rows.rest()

    seen = sent.pages.mapInArrow(run, "host string, place int, line bigint, page bigint").distinct()
    often = settle(seen.groupBy("host", "place", "line").agg(F.count("*").alias("n")).where(F.col("n") > 1), "wrappers")
    all_pages = often.where(F.col("place") == PAGE).select("host", F.col("n").alias("all"))
    # No more lines can stand on all pages than one page has.
    found = (often.where(F.col("place") != PAGE).join(all_pages, "host").where(F.col("n") == F.col("all"))
             .groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array(F.col("place").cast("bigint"), "line")))).alias("template")))
    return wrappers.join(found, "host", "left").withColumn("template", F.coalesce("template", F.lit("[]")))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: ``page_id, url, text``."""
    wrappers = settle(infer_wrappers(pages, url_col, html_col), "wrappers")
    narrow = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                          host_of(F.col(url_col)).alias("host"))
    sent = Sent(narrow, settle(template_lines(narrow, wrappers, broadcast_bytes), "wrappers"), broadcast_bytes)
    shipped = sent.shipped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(TEXT)
        known: dict[str, Extractor] = {}
        for batch in batches:
            for page_id, url, (_, source, extractor) in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(),
                                                            extractors(batch, shipped, known), strict=True):
                text = extractor.text(source)
                rows.add((page_id, url, text), len(text))
                if rows.full():
                    yield rows.take()
        yield from rows.rest()

    return sent.pages.mapInArrow(run, "page_id bigint, url string, text string")


@query("op4_main_text")
def op4_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf}/pages.parquet")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
