"""Stored pages, results and profiles on small fixtures."""

import os
import random
import re

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gridweave.operators import dom, pages, people, selectors


@pytest.fixture(scope="module")
def nodes(spark):
    html = open(os.path.join(DATA, "page.html"), encoding="utf-8").read()
    return dom.dom_nodes(spark.createDataFrame([(1, html), (2, "<p>one<p>two <b>bold<p>three"), (3, "")], "page_id bigint, html string"))


def test_tree(nodes):
    rows = {r["seq"]: r for r in nodes.where("page_id = 2").collect()}
    assert [rows[i]["tag"] for i in range(4)] == ["p", "p", "b", "p"]
    assert [rows[i]["text"] for i in range(4)] == ["one", "two bold", "bold", "three"]
    assert rows[2]["up"] == [1] and rows[3]["up"] == []
    tags = {r["tag"] for r in nodes.where("page_id = 1").collect()}
    assert not tags & {"script", "style", "head", "meta", "svg", "title"}


def test_node_batches_are_bounded_by_their_texts():
    """Long texts, which every enclosing element repeats, close a batch long before its rows do; none is lost or cut."""
    text, depth = "x" * 300_000, 12
    html = "<div>" * depth + text + "</div>" * depth
    given = pa.RecordBatch.from_pydict({"page_id": [1, None, 3], "html": [html, html, None]}, pa.schema([("page_id", pa.int64()), ("html", pa.string())]))
    found = list(dom._explode_pages(iter([given, given])))
    assert len(found) > 3 and max(b.nbytes for b in found) < dom.FLUSH_CHARS + 2 * len(text)
    rows = [r for b in found for r in b.to_pylist()]
    assert [(r["page_id"], r["seq"]) for r in rows] == [(i, n) for i in (1, None, 1, None) for n in range(depth)]
    assert {r["text"] for r in rows} == {text} and [r["up"] for r in rows[:3]] == [[], [0], [0, 1]]
    many = pa.RecordBatch.from_pydict({"page_id": [1], "html": ["<br>" * 10_000]})
    assert [b.num_rows for b in dom._explode_pages(iter([many]))] == [4096, 4096, 1808]


def test_snapshot_and_find(nodes):
    snap = dom.snapshot(nodes).where("page_id = 1").orderBy("seq")
    controls = [(r["index"], r["tag"], r["name"]) for r in snap.where("control").collect()]
    assert controls == [(0, "a", "Home"), (1, "input", "Search here"), (2, "button", "Send now"), (3, "a", "Alpha card with a long enough text"),
                        (4, "a", "Photo"), (5, "a", "Photo"), (6, "a", "Beta card with a long enough text"), (7, "a", "Gamma card with a long enough text"), (8, "div", "Menu entry")]
    assert [r["index"] for r in dom.find_elements(snap, "PHOTO", "a").collect()] == [4, 5]
    assert dom.find_first(snap, "card").first()["index"] == 3


def test_outline_collapses_repeats(nodes):
    text = dom.page_outline(dom.snapshot(nodes), dedup=True).where("page_id = 1").first()["outline"].split("\n")
    assert '[1]<input type="search" placeholder="Search here"> Search here' in text
    assert '[4]<a href="/photo"> Photo  (×2 similar — idx 4, 5)' in text
    assert dom.page_outline(dom.snapshot(nodes), max_chars=20).where("page_id = 1").first()["outline"].endswith("… [snapshot truncated]")


def test_records_and_repeated_block(nodes):
    out = dom.extract_records(nodes, "div.card", {"all": "text", "link": "a@href", "id": "@data-id", "price": r"regex:(\d+) EUR", "none": "em"})
    rows = out.orderBy("box").collect()
    assert [(r["link"], r["id"], r["price"], r["none"]) for r in rows] == [("/a", "1", "10", None), ("/b", "2", None, None), ("/c", "3", "30", None)]
    assert rows[0]["all"].startswith("Alpha card")
    assert dom.extract_records(nodes, "div.card", limit=2).count() == 2
    block = dom.detect_repeated_block(nodes).collect()
    assert [(r["page_id"], r["signature"], r["items"], r["too_broad"]) for r in block] == [(1, "div.card", 3, False)]
    for css in ("", "a:hover", "> a", "a >", "a,,b", "a::before", ":scope", "a :scope b"):
        with pytest.raises(ValueError):
            selectors.parse(css)


class Tree:
    """A plain matcher that walks the elements of a page."""

    def __init__(self, html):
        self.rows = dom.parse_nodes(html)

    def one(self, n, part):
        attrs, value = n["attrs"], None
        if part[0] == ".":
            return part[1:] in n["cls"].split()
        if part[0] == "#":
            return attrs.get("id") == part[1:]
        if part[0] == "[":
            m = re.fullmatch(r"""\[([\w-]+)(?:(.?=)["']?([^"'\]]*)["']?)?\]""", part)
            value, (op, want) = attrs.get(m[1]), (m[2], m[3])
            if value is None or op is None:
                return value is not None
            return {"=": value == want, "^=": value.startswith(want), "$=": value.endswith(want), "*=": want in value,
                    "~=": want in value.split(), "|=": value == want or value.startswith(want + "-")}[op]
        if part == ":first-child":
            return n["child"] == 1
        if part.startswith(":nth-child"):
            return n["child"] == int(part[11:-1])
        if part.startswith(":not"):
            return not self.one(n, part[5:-1])
        return part in ("*", n["tag"])

    def ends(self, n, steps, scope):
        """Whether the chain can end at the element, told from ``scope``."""
        *before, last = steps
        if last.compound == (":scope",):
            return n["seq"] == scope
        if not all(self.one(n, p) for p in last.compound):
            return False
        if not before:
            return True
        brothers = [m for m in self.rows if m["parent"] == n["parent"] and m["child"] < n["child"]]
        near = {" ": [self.rows[i] for i in n["up"]], ">": [self.rows[n["parent"]]] if n["parent"] >= 0 else [],
                "+": [m for m in brothers if m["child"] == n["child"] - 1], "~": brothers}[last.relation]
        return any(self.ends(m, before, scope) for m in near)

    def match(self, css, scope=None):
        return [n for n in self.rows if any(self.ends(n, chain, scope) for chain in selectors.parse(css))]

    def first_in(self, box, css):
        inside = [n for n in self.match(css, box["seq"]) if box["seq"] < n["seq"] <= box["last"]]
        return inside[0] if inside else None


def random_page(rnd, size):
    def tree(depth, room):
        out = []
        while room[0] > 0 and rnd.random() < (0.85 if depth < 6 else 0.2):
            room[0] -= 1
            tag = rnd.choice(["div", "span", "ul", "section", "a", "b"])
            marks = "".join([rnd.choice(["", " class=card", " class='x card y'", " class=x"]), rnd.choice(["", "", " id=one", " href='/p-q r'", " data-k=v"])])
            out.append(f"<{tag}{marks}>t{room[0]} {tree(depth + 1, room)}</{tag}>")
        return "".join(out)
    return "<body>" + tree(0, [size]) + "</body>"


CHAINS = [".card > a", "div, span.x", "ul a", "div > .x .card", "section + div", "a ~ b", "div.x > a + span", ".card .card .card", "[href^='/p'] b, #one",
          "*:not(.x) > a:first-child", "a[href~=r], b:nth-child(2)", "body > div ~ section .x, ul", "div[data-k=v] *"]


def test_selector_chains_equal_a_walk(spark):
    rnd = random.Random(12)
    pages_ = [(i, random_page(rnd, 60)) for i in range(12)]
    found = dom.dom_nodes(spark.createDataFrame(pages_, "page_id bigint, html string")).cache()
    for css in CHAINS:
        got = sorted((r.page_id, r.seq) for r in selectors.match(found, css).collect())
        assert got == sorted((i, n["seq"]) for i, html in pages_ for n in Tree(html).match(css)), css


def test_records_by_chains(spark):
    rnd = random.Random(13)
    pages_ = [(i, random_page(rnd, 50)) for i in range(8)]
    found = dom.dom_nodes(spark.createDataFrame(pages_, "page_id bigint, html string"))
    fields = {"child": ":scope > a", "deep": "div > b", "either": ":scope > b, span .x", "far": "body .card a@href", "scoped": ":scope .x > a@class", "plain": "a, b", "own": "text"}
    for container in (".card", "div > .card, ul", "section .x"):
        got = sorted(tuple(r[c] for c in ("page_id", "box", *fields)) for r in dom.extract_records(found, container, fields).collect())
        want = []
        for i, html in pages_:
            tree = Tree(html)
            for box in tree.match(container):
                row = [i, box["seq"]]
                for spec in fields.values():
                    css, _, name = spec.partition("@")
                    hit = box if spec == "text" else tree.first_in(box, css)
                    row.append(None if hit is None else hit["attrs"].get(name) if name else hit["text"])
                want.append(tuple(row))
        assert got == sorted(want), container


def test_clickable_elements_and_labels(spark):
    html = """<span onclick='go()'>Open</span><div onclick=x>around <button>Inner</button></div><div tabindex=0>Tab</div><div tabindex=-1>No</div>
      <label for=mail>E-mail <b>address</b></label><input id=mail name=m><label>Age <input name=age> years</label><label for=nobody>x <input name=z></label>
      <input aria-labelledby='t1 gone t2' name=q><h2 id=t1>First</h2><p id=t2>Second</p><p id=t1>Not this</p><input type=hidden id=hid><label for=hid>H</label>
      <div contenteditable>Editor <a href=1>no</a></div><label>Two <input name=i1><input name=i2></label><input placeholder=Hint id=ph><label for=ph>Label</label>
      <label for=mail>Later</label><div onclick=y><div contenteditable=true>z</div></div><li onclick=a>outer <i onclick=b>inner</i></li>"""
    got = dom.snapshot(dom.dom_nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string"))).orderBy("seq").collect()
    assert [(r.tag, r.name) for r in got if r.control] == [
        ("span", "Open"), ("button", "Inner"), ("div", "Tab"), ("input", "E-mail address"), ("input", "Age years"), ("input", "z"),
        ("input", "First Second"), ("input", ""), ("div", "Editor no"), ("input", "Two"), ("input", "i2"), ("input", "Hint"),
        ("div", "z"), ("li", "outer inner")]
    assert [r["index"] for r in got if r["control"]] == list(range(14))
    texts = [r.name for r in got if not r.control]
    assert "around" in texts and "No" in texts and "E-mail" in texts and "Open" not in texts


def test_breadcrumbs(spark):
    cites = ["https://example.com › docs › guide", "example.com > a ... ", "r/codex · 185,2k+ followers", "www.google.com › x", "http://Example.com", None, ""]
    df = spark.createDataFrame(list(enumerate(cites)), "i int, c string")
    got = [r["b"] for r in df.select("i", pages.breadcrumb_to_url(F.col("c")).alias("b")).orderBy("i").collect()]
    assert [(b["url"].rstrip(), b["host"], b["elided"]) if b else None for b in got] == [
        ("https://example.com/docs/guide", "example.com", False), ("https://example.com/a", "example.com", True), None, None,
        ("http://Example.com/", "example.com", False), None, None]


def test_redirect_locations(spark):
    cases = [("http://a.b/x/y?q=1", "/z", "http://a.b/z"), ("http://a.b/x/y", "z", "http://a.b/x/z"), ("http://a.b", "z", "http://a.b/z"),
             ("https://a.b/x", "//c.d/e", "https://c.d/e"), ("http://a.b/x", "https://q/", "https://q/"), ("http://a.b/x?y=1", "?k=2", "http://a.b/x?k=2")]
    df = spark.createDataFrame(cases, "base string, loc string, want string")
    for r in df.select(pages.join_url(F.col("base"), F.col("loc")).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_results_prefer_resolved_hosts(spark):
    results = spark.createDataFrame([("t1", "https://cite.example/x"), ("t2", ""), ("t3", "https://c.example/")], "redirect string, cite_url string")
    edges = spark.createDataFrame([("t1", "https://real.example/p"), ("t3", "https://www.google.com/sorry")], "url string, location string")
    got = {r["redirect"]: r["url"] for r in pages.resolve_results(results, edges).collect()}
    assert got == {"t1": "https://real.example/p", "t2": "t2", "t3": "https://c.example/"}


def test_cards(spark):
    text = "Anna Rossi • 2nd\nHead of data\nMilan, Italy\nConnect\nProvides services - Advice\nHead of Data\n3 mutual connections\nMore"
    df = spark.createDataFrame([(1, text, "Anna Rossi • 2nd", "https://x/in/anna%20r?a=1"), (2, "Bob\nMessaggio", "Bob", "/in/bob/"), (3, "", "", "/jobs")],
                               "id int, text string, name_text string, href string")
    rows = people.parse_cards(df).orderBy("id").collect()
    assert rows[0].asDict() == {"id": 1, "name": "Anna Rossi", "url": "https://www.linkedin.com/in/anna r", "degree": "2nd", "headline": "Head of data",
                                "location": "Milan, Italy", "services": "Advice", "extra": "3 mutual connections | More"}
    assert (rows[1]["name"], rows[1]["url"], rows[1]["headline"]) == ("Bob", "https://www.linkedin.com/in/bob", "") and len(rows) == 2


def test_profiles(spark):
    rich = "\n".join(["Anna Rossi", "She/Her", "· 1st", "Data lead", "Milan", "·", "Informazioni di contatto", "ACME", "Some University", "500+", "collegamenti",
                      "Informazioni", "I like data.", "mostra altro", "A lot.", "Esperienza", "ACME", "#OpenToWork", "Privacy Policy", "Open footer"])
    df = spark.createDataFrame([(1, rich), (2, "Bob"), (3, None)], "id int, text string")
    a, b, c = people.parse_profiles(df).orderBy("id").collect()
    assert a.asDict() == {"id": 1, "name": "Anna Rossi", "headline": "Data lead", "location": "Milan", "current_company": "ACME", "education": "Some University",
                          "connections": "500+", "followers": "", "about": "I like data. A lot.", "contact_info": True, "open_to_work": True}
    assert (b["name"], b["headline"], b["about"], b["contact_info"]) == ("Bob", "", "", False) and c["name"] == ""
