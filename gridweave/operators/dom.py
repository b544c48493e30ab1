"""Stored HTML as a table of nodes, and the operators that read it.

Tokenising is the only per-row Python; it runs on Arrow batches of pages spread by Spark. Selecting,
grouping and rendering are relational on the node table. A page's nodes carry ``seq`` (document order),
``last`` (the last seq of the subtree) and ``up`` (the seqs of all enclosing elements), so containment
needs no comparison of pairs: a node reports to the elements around it and one grouping brings both
together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regexes import re_extract
from ..functions.text import one_line
from ..session import settle
from . import selectors
from .selectors import attr

NODE_SCHEMA = ("page_id bigint, seq int, last int, depth int, parent int, child int, kind string, tag string, "
               "cls string, attrs map<string,string>, own string, text string, role string, up array<int>")

# Elements whose content is never shown, elements without content, and controls.
SKIPPED = frozenset(["script", "style", "noscript", "template", "head", "meta", "link", "svg", "path"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
CONTROLS = ["a", "button", "input", "select", "textarea", "option", "summary"]
CONTROL_ROLES = ["button", "link", "checkbox", "radio", "option", "switch", "tab", "menuitem", "menuitemcheckbox",
                 "menuitemradio", "treeitem", "slider", "spinbutton", "textbox", "searchbox", "combobox"]
INNER_CONTROLS = ["a", "button", "input", "select", "textarea"]
INNER_ROLES = ["button", "link", "checkbox", "radio", "menuitem", "tab", "option", "switch"]
LABELLED = ["button", "input", "meter", "output", "progress", "select", "textarea"]
INLINE = frozenset(["b", "i", "em", "strong", "span", "font", "u", "small", "big", "code", "tt", "s", "sub", "sup"])
# An open element that the start of one of these ends.
CLOSED_BY = {"p": frozenset(["p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6",
                             "footer", "header", "nav", "form", "pre", "blockquote", "main", "aside"]),
             "li": frozenset(["li"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]),
             "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}


class _Nodes(HTMLParser):
    """Collects elements in document order with the text they directly hold and the text below them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.hidden: list[str] = []
        self.pieces: list[str] = []     # all text in order; an element's text is a slice of it

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            if tag not in VOID and tag == self.hidden[0]:
                self.hidden.append(tag)
            return
        if tag in SKIPPED:
            if tag not in VOID:
                self.hidden.append(tag)
            return
        self._close_before(tag)
        above = self.open[-1] if self.open else None
        values = {k: (v if v is not None else "") for k, v in attrs}
        if above:
            above["children"] += 1
        node = {"seq": len(self.rows), "depth": len(self.open), "parent": above["seq"] if above else -1, "tag": tag,
                "child": above["children"] if above else 1, "cls": (values.get("class") or "").strip(),
                "attrs": values, "own": [], "from": len(self.pieces), "to": len(self.pieces), "last": len(self.rows), "children": 0,
                "up": [n["seq"] for n in self.open]}
        self.rows.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.hidden and self.open and self.open[-1]["tag"] == tag:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if any(n["tag"] == tag for n in self.open):
            while self._close()["tag"] != tag:
                pass

    def _close_before(self, tag: str) -> None:
        """End the open element this start tag ends, also when only inline elements are open inside it."""
        for depth in range(len(self.open) - 1, -1, -1):
            above = self.open[depth]["tag"]
            if tag in CLOSED_BY.get(above, ()):
                while len(self.open) > depth:
                    self._close()
                return self._close_before(tag)
            if above not in INLINE:
                return None
        return None

    def _close(self) -> dict:
        node = self.open.pop()
        node["last"], node["to"] = len(self.rows) - 1, len(self.pieces)
        return node

    def handle_data(self, data: str) -> None:
        if self.hidden or not self.open:
            return
        self.open[-1]["own"].append(data)
        self.pieces.append(data)

    def finish(self) -> Iterator[dict]:
        """The elements one by one, each with the text below it, which is not kept: it is long for outer elements."""
        self.close()
        while self.open:
            self._close()
        for node in self.rows:
            yield {**node, "text": " ".join("".join(self.pieces[node["from"]:node["to"]]).split())}


def read_nodes(html: str | None) -> Iterator[dict]:
    parser = _Nodes()
    parser.feed(html or "")
    return parser.finish()


def parse_nodes(html: str | None) -> list[dict]:
    return list(read_nodes(html))


# Node rows, and characters in their texts, per Arrow batch handed back to Spark; a longer row stands alone.
FLUSH_ROWS, FLUSH_CHARS = 4096, 4 << 20
NODE_TYPES = pa.schema([("page_id", pa.int64()), *[(c, pa.int32()) for c in ("seq", "last", "depth", "parent", "child")],
                        *[(c, pa.string()) for c in ("kind", "tag", "cls")], ("attrs", pa.map_(pa.string(), pa.string())),
                        *[(c, pa.string()) for c in ("own", "text", "role")], ("up", pa.list_(pa.int32()))])


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pages are taken out of a batch one at a time: as Python objects a batch of pages is several times as large."""
    for batch in batches:
        for page_id, html in zip(batch.column("page_id"), batch.column("html")):
            for n in read_nodes(html.as_py()):
                yield (page_id.as_py(), n["seq"], n["last"], n["depth"], n["parent"], n["child"], "element", n["tag"],
                       n["cls"], list(n["attrs"].items()), " ".join("".join(n["own"]).split()), n["text"], n["attrs"].get("role") or "", n["up"])


def _explode_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), NODE_TYPES)], schema=NODE_TYPES)

    for row in _node_rows(batches):
        size = len(row[10]) + len(row[11]) + sum(len(k) + len(v) for k, v in row[9])
        if rows and (len(rows) >= FLUSH_ROWS or chars + size > FLUSH_CHARS):
            yield batch()
            rows, chars = [], 0
        rows.append(row)
        chars += size
    if rows:
        yield batch()


def dom_nodes(pages: DataFrame) -> DataFrame:
    """One row per element of each page (``page_id, html``), scripts and styles left out."""
    return pages.select("page_id", "html").mapInArrow(_explode_pages, NODE_SCHEMA)


def is_control() -> Column:
    """Controls by tag, role or editable text: leaves, whose content is only their label."""
    editable = F.lower(attr("contenteditable")).isin("", "true", "plaintext-only")
    return F.col("tag").isin(CONTROLS) | F.col("role").isin(CONTROL_ROLES) | F.coalesce(editable, F.lit(False))


def is_clickable() -> Column:
    """Elements that a script makes clickable or that can be tabbed to; a control unless another one lies inside."""
    return attr("onclick").isNotNull() | F.coalesce(attr("tabindex") != "-1", F.lit(False))


def is_inner_control() -> Column:
    """What makes a clickable element around it a mere container."""
    return (F.col("tag").isin(INNER_CONTROLS) | F.col("role").isin(INNER_ROLES)
            | F.coalesce(attr("contenteditable") == "true", F.lit(False)))


def _words(name: str) -> Column:
    return F.filter(F.split(F.coalesce(attr(name), F.lit("")), r"\s+"), lambda w: w != "")


def referenced_names(nodes: DataFrame) -> DataFrame:
    """``page_id, seq, labelled, label``: the texts of the elements that ``aria-labelledby`` lists, and the text of the first
    label of an element that can have one - by its ``for``, or around it as its first such element.

    Ids stand for the first element that has them. Everything is joined by page and id, or by page and the number of
    an enclosing element; ``nodes`` is read several times: settle it before.
    """
    able = F.col("tag").isin(LABELLED) & ~((F.col("tag") == "input") & (F.lower(F.coalesce(attr("type"), F.lit(""))) == "hidden"))
    ids = nodes.where(attr("id") != "").groupBy("page_id", attr("id").alias("id")).agg(
        F.min_by(F.struct("seq", "text", able.alias("able")), "seq").alias("of"))
    lists = nodes.where(F.size(_words("aria-labelledby")) > 0).select("page_id", "seq", F.posexplode(_words("aria-labelledby")).alias("at", "id"))
    labelled = (lists.join(ids, ["page_id", "id"], "left").groupBy("page_id", "seq")
                .agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("of.text", F.lit("")).alias("text")))).alias("parts"))
                .select("page_id", "seq", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("labelled")))
    labels = nodes.where(F.col("tag") == "label").select("page_id", F.col("seq").alias("by"), "text", attr("for").alias("id"))
    named = labels.join(ids, ["page_id", "id"]).where("of.able").select("page_id", "of.seq", "by", "text")
    around = (nodes.where(able).select("page_id", "seq", F.explode("up").alias("by")).join(labels.where("id is null"), ["page_id", "by"])
              .groupBy("page_id", "by").agg(F.min("seq").alias("seq"), F.first("text").alias("text")).select("page_id", "seq", "by", "text"))
    label = named.unionAll(around).groupBy("page_id", "seq").agg(F.min_by("text", "by").alias("label"))
    return labelled.join(label, ["page_id", "seq"], "full")


def accessible_name(labelled: Column | None = None, label: Column | None = None) -> Column:
    """What a reader calls an element: its label, hint, alternative text or title, else its text."""
    def filled(c: Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else F.when(c != "", c)
    kind = F.lower(F.coalesce(attr("type"), F.lit("text")))
    hint = F.when(F.col("tag") == "input", F.coalesce(F.when(kind.isin("submit", "button"), filled(attr("value"))),
                                                      filled(attr("placeholder")), filled(label), filled(attr("name")))
                  ).when(F.col("tag") == "textarea", F.coalesce(filled(attr("placeholder")), filled(attr("name")))
                         ).when(F.col("tag") == "img", filled(attr("alt")))
    return one_line(F.coalesce(filled(attr("aria-label")), filled(labelled), hint, filled(attr("title")), F.col("text"), F.lit("")))


def snapshot(nodes: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """The nodes a reader meets: controls (numbered per page) and the direct text of everything else.

    Controls are those of :func:`is_control`, and clickable elements without one inside. What lies inside a control is
    only its label and is left out. Containment is found per page in document order: a node is inside a control when an
    earlier control's subtree reaches it, and holds one when the next one is not beyond its subtree. Nodes are settled
    first, as names may be told by other elements of the page.
    """
    nodes = settle(nodes, "nodes")
    w = W.partitionBy("page_id").orderBy("seq")
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    inner = F.min(F.when(is_inner_control(), F.col("seq"))).over(after)
    marked = nodes.withColumn("_inner", inner).withColumn(
        "control", is_control() | (is_clickable() & F.coalesce(F.col("_inner") > F.col("last"), F.lit(True))))
    marked = marked.withColumn("_reach", F.max(F.when(F.col("control"), F.col("last"))).over(before))
    outer = marked.where(F.col("_reach").isNull() | (F.col("_reach") < F.col("seq"))).where(F.col("control") | (F.length("own") > 1))
    shown = outer.withColumn("index", F.when(F.col("control"), F.count(F.when(F.col("control"), 1)).over(w) - 1).cast("int"))
    shown = shown.join(referenced_names(nodes), ["page_id", "seq"], "left").withColumns({
        "name": F.when(F.col("control"), accessible_name(F.col("labelled"), F.col("label"))).otherwise(one_line(F.col("own"))),
        "href": F.when(F.col("tag") == "a", one_line(attr("href")))})
    out = shown.select("page_id", "seq", "depth", "tag", "control", "index", "name", "href", "attrs")
    return out if max_nodes is None else out.where(F.col("index").isNull() | (F.col("index") < max_nodes))


def find_elements(nodes: DataFrame, match: str = "", tag: str = "") -> DataFrame:
    """Controls whose name contains the text (any case) and whose tag is the given one."""
    out = nodes.where("control")
    if match:
        out = out.where(F.contains(F.lower("name"), F.lit(match.lower())))
    return out.where(F.col("tag") == tag.lower()) if tag else out


def find_first(nodes: DataFrame, match: str, tag: str = "") -> DataFrame:
    return find_elements(nodes, match, tag).groupBy("page_id").agg(F.min("index").alias("index"))


# Attributes shown in an outline, in this order.
SHOWN_ATTRS = ["type", "role", "href", "value", "placeholder", "aria-expanded", "aria-selected", "aria-checked"]
SHOWN_FLAGS = ["checked", "disabled"]


def page_outline(nodes: DataFrame, dedup: bool = False, max_chars: int | None = None,
                 attr_chars: int | None = None) -> DataFrame:
    """One text per page from its snapshot; runs of look-alike controls can be collapsed into one line.

    Cuts are made only when asked for. What a password field holds is left out.
    """
    def value(a: str) -> Column:
        shown = one_line(attr(a))
        if attr_chars is not None:
            shown = F.when(F.length(shown) > attr_chars, F.concat(F.substring(shown, 1, attr_chars), F.lit("…"))).otherwise(shown)
        return F.when(F.lower(F.coalesce(attr("type"), F.lit(""))) != "password", shown) if a == "value" else shown

    shown = [F.when(value(a).isNotNull() & (attr(a) != ""), F.concat(F.lit(f' {a.removeprefix("aria-")}="'), value(a), F.lit('"')))
             for a in SHOWN_ATTRS]
    shown += [F.when(attr(a).isNotNull(), F.lit(f" {a}")) for a in SHOWN_FLAGS]
    body = F.when(F.col("name") != "", F.concat(F.lit(" "), F.col("name"))).otherwise("")
    line = F.when(F.col("control"), F.concat(F.lit("["), F.col("index").cast("string"), F.lit("]<"), F.col("tag"),
                                             F.concat_ws("", *shown), F.lit(">"), body)).otherwise(F.col("name"))
    rows = nodes.withColumn("line", line)
    if dedup:
        w = W.partitionBy("page_id").orderBy("seq")
        look = F.struct("tag", F.trim("name"), "href")
        same = F.col("control") & F.lag("control").over(w) & look.eqNullSafe(F.lag(look).over(w))
        rows = (rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
                .withColumn("_run", F.sum("_new").over(w)).groupBy("page_id", "_run")
                .agg(F.min("seq").alias("seq"), F.min_by("line", "seq").alias("line"), F.count("*").alias("_n"),
                     F.min("index").alias("_first")))
        listed = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(5)).cast("int") - 1),
                                          lambda i: (F.col("_first") + i).cast("string")), ", ")
        rows = rows.withColumn("line", F.when(F.col("_n") > 1, F.concat(
            "line", F.lit("  (×"), F.col("_n").cast("string"), F.lit(" similar — idx "), listed,
            F.when(F.col("_n") > 5, "…").otherwise(""), F.lit(")"))).otherwise(F.col("line")))
    texts = rows.where(F.col("line") != "").groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("outline"))
    if max_chars is None:
        return texts
    return texts.withColumn("outline", F.when(F.length("outline") > max_chars, F.concat(
        F.substring("outline", 1, max_chars), F.lit("\n… [snapshot truncated]"))).otherwise(F.col("outline")))


def _cut(c: Column, n: int | None) -> Column:
    return c if n is None else F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def _is_selector(spec: str) -> bool:
    return spec not in ("", "text") and not spec.startswith(("regex:", "@"))


def extract_records(nodes: DataFrame, container: str, fields: Mapping[str, str] | None = None,
                    limit: int | None = None, max_chars: int | None = None) -> DataFrame:
    """One row per container element, one column per field.

    A field is ``text`` (the container's own text), a selector (text of its first match inside),
    ``selector@attr`` or ``@attr``, or ``regex:PATTERN`` (first group, else the match) over the text. Selectors are
    those of :mod:`.selectors`; in a field, what stands before the last compound may lie outside the container, unless
    the chain begins with ``:scope``, which is the container. Without chains, nodes are shuffled once for any number of
    fields; with them, nodes are settled first and every step of a chain is one more join.
    """
    fields = dict(fields or {"text": "text", "href": "a@href"})
    nested = [css for css in [container, *(f.rpartition("@")[0] if "@" in f else f for f in fields.values() if _is_selector(f))]
              if not selectors.is_simple(css)]
    if selectors.is_scoped(container):
        raise ValueError("a container stands in the page, not in a container")
    if nested:
        nodes = settle(nodes, "nodes")

    def marked(css: str, flag: str) -> Column:
        """Whether a node matches; for a chain, by a column joined to the nodes."""
        nonlocal nodes
        if selectors.is_simple(css):
            return selectors.condition(css)
        hits = selectors.match(nodes_before, css).where("anchor is null").select("page_id", "seq").withColumn(flag, F.lit(True))
        nodes = nodes.join(hits, ["page_id", "seq"], "left")
        return F.coalesce(F.col(flag), F.lit(False))

    nodes_before = nodes
    is_box = marked(container, "_box_flag")
    own = {"text": F.col("text"), "attrs": F.col("attrs")}
    cols, inside, scoped = {}, {}, []
    for i, (name, spec) in enumerate(fields.items()):
        if spec in ("", "text"):
            cols[name] = _cut(F.col("_box.text"), max_chars)
        elif spec.startswith("regex:"):
            pattern = spec[6:]
            whole = re_extract(F.col("_box.text"), pattern)
            # the whole match where the group took no part in it
            first = re_extract(F.col("_box.text"), pattern, 1)
            cols[name] = F.coalesce(F.when(first != "", first), whole) if re.compile(pattern).groups else whole
        elif spec.startswith("@"):
            cols[name] = _cut(F.try_element_at("_box.attrs", F.lit(spec[1:])), max_chars)
        else:
            css, wanted = spec.rpartition("@")[::2] if "@" in spec else (spec, "")
            value = F.struct((attr(wanted) if wanted else F.col("text")).alias("v"))
            inside[name] = (marked(css, f"_flag_{i}"), value)
            if selectors.is_scoped(css):
                scoped.append((name, css, value))
            cols[name] = _cut(F.col(f"_f_{name}.v"), max_chars)
    any_hit = reduce(lambda a, b: a | b, [hit for hit, _ in inside.values()], F.lit(False))
    none = F.array().cast("array<int>")
    # a box reports to itself, a field hit to every element around it
    reports = nodes.where(is_box | any_hit).select(
        "page_id", "seq", F.when(is_box, F.struct(*[c.alias(n) for n, c in own.items()])).alias("_own"),
        *[F.when(hit, value).alias(f"_v_{n}") for n, (hit, value) in inside.items()],
        F.explode(F.concat(F.when(is_box, F.array("seq")).otherwise(none), F.when(any_hit, F.col("up")).otherwise(none))).alias("box"))
    for name, css, value in scoped:    # and one that is told from the box, to that box
        hits = selectors.match(nodes_before, css).where("anchor is not null")
        told = nodes_before.join(hits, ["page_id", "seq"]).select("page_id", "seq", value.alias(f"_v_{name}"), F.col("anchor").alias("box"))
        reports = reports.unionByName(told, allowMissingColumns=True)
    itself = F.col("box") == F.col("seq")
    found = reports.groupBy("page_id", "box").agg(
        F.first(F.when(itself, F.col("_own")), ignorenulls=True).alias("_box"),
        *[F.min_by(F.col(f"_v_{n}"), F.when(~itself & F.col(f"_v_{n}").isNotNull(), F.col("seq"))).alias(f"_f_{n}") for n in inside])
    out = found.where(F.col("_box").isNotNull()).select("page_id", "box", *[c.alias(n) for n, c in cols.items()])
    if limit is not None:
        w = W.partitionBy("page_id").orderBy("box")
        out = out.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= limit).drop("_at")
    return out


# A repeated block whose items are all this long is the page itself, not a list.
BROAD_ITEM = 4000


def detect_repeated_block(nodes: DataFrame, least: int = 3, min_text: int = 30) -> DataFrame:
    """Per page, the parent whose children most often repeat the same tag and first class.

    Only children with a link below them and some text count. ``too_broad`` warns when nearly all of
    them are very long.
    """
    link = (F.col("tag") == "a") & (F.coalesce(attr("href"), F.lit("")) != "")
    able = (F.length("text") >= min_text) & (F.col("parent") >= 0)
    signature = F.concat("tag", F.when(F.col("cls") != "", F.concat(F.lit("."), F.split("cls", r"\s+")[0])).otherwise(""))
    none = F.array().cast("array<int>")
    # a candidate reports to itself, a link to every element around it
    reports = nodes.where(able | link).select(
        "page_id", "seq", "parent", F.length("text").alias("size"), signature.alias("signature"), able.alias("able"),
        F.explode(F.concat(F.when(able, F.array("seq")).otherwise(none), F.when(link, F.col("up")).otherwise(none))).alias("at"))
    itself = F.col("at") == F.col("seq")
    items = reports.groupBy("page_id", "at").agg(
        *[F.max(F.when(itself & F.col("able"), F.col(c))).alias(c) for c in ("parent", "size", "signature")],
        F.bool_or(~itself).alias("linked")).where(F.col("linked") & F.col("parent").isNotNull())
    blocks = items.groupBy("page_id", "parent", "signature").agg(
        F.count("*").alias("items"), F.count_if(F.col("size") > BROAD_ITEM).alias("huge")).where(F.col("items") >= least)
    best = blocks.groupBy("page_id").agg(F.max_by(F.struct("parent", "signature", "items", "huge"),
                                                  F.struct("items", -F.col("parent"), "signature")).alias("b"))
    return best.select("page_id", "b.parent", "b.signature", "b.items",
                       (F.col("b.huge") >= F.greatest(F.lit(1), F.col("b.items") - 1)).alias("too_broad"))
