"""Wrappers against a direct reading of regular pages; the pipeline stage by stage; the entry point without it."""

from __future__ import annotations

import html
import json
import random
import re
import shutil
import subprocess
import sys
import time
from pathlib import Path

import corpus_pipeline
from conftest import SF
from odd_rows import none, odd
from pyspark.sql import functions as F

from gridweave.llm import wrappers
from gridweave.session import settle

ROOT = Path(__file__).resolve().parents[2]


def article_of(source):
    body = source[source.index("<article>"):source.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"<(?:/?p|/?h1|br|article)>", body)]
    return "\n".join(b for b in blocks if b)


def test_main_text_of_regular_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.extract_text(pages).collect()}
    joined = {r.page_id: r.text for r in wrappers.extract_text(pages, broadcast_bytes=0).collect()}
    assert got == joined == {r.page_id: article_of(r.html) for r in pages.collect()}


def page(body):
    return f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def test_boilerplate_around_and_inside_the_article(spark):
    body = ("<header>Site</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use</div><main><article class=post><h1>Title &amp; more</h1>"
            "<div class='share-buttons'>Share</div><p>First&nbsp; <b>bold</b>\n text<!-- no --></p><aside>Side</aside><ul><li>one<li>two</ul>"
            "<blockquote>quote<br>next</blockquote><form><p>mail</p></form><table><tr><td>a<td>b</table></article>"
            "<section id=comments><article>reader</article></section></main><footer>&copy;</footer>")
    df = spark.createDataFrame([(1, "http://a.b/c", page(body))], "page_id long, url string, html string")
    assert wrappers.extract_text(df).first().text == "Title & more\nFirst bold text\none\ntwo\nquote\nnext\na\nb"


def test_a_host_without_article_loses_its_template(spark):
    rows = [(i, "http://h.example/x", page(f"<div>Always the same line</div><div><p>Own text {i} of this page</p><p>and more {i * 7}</p></div>"
                                           "<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>")) for i in range(8)]
    got = wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own text {i} of this page\nand more {i * 7}" for i in range(8)}


PAGES = "page_id long, url string, html string"


def test_copies_and_repeats_are_no_template(spark):
    lonely = page("<h1>Only title</h1><p>The one paragraph.</p>")
    rows = [(n * 10_000 + i, f"http://h{n}.example/{i}", lonely) for n in (4, 5, 1000) for i in range(n)]
    rows.append((1, "http://single.example/", page("<div><p>Again.</p></div>" * 7 + "<ul>" + "<li>item</li>" * 6 + "</ul>")))
    # copies beside different pages count once; a view counter does not make a page another one
    rows += [(100 + i, "http://mixed.example/x", page(f"<div><p>Shared by the four and the copies.</p><p>Own {min(i, 3)} words</p></div>")) for i in range(40)]
    rows += [(200 + i, "http://near.example/x", page(f"<h1>The title</h1><p>{'A long text. ' * 30}</p><p>views {i}</p>")) for i in range(20)]
    got = {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {got[n * 10_000 + i] for n in (4, 5, 1000) for i in range(n)} == {"Only title\nThe one paragraph."}
    assert got[1] == "\n".join(["Again."] * 7 + ["item"] * 6)
    assert all(got[100 + i] == f"Shared by the four and the copies.\nOwn {min(i, 3)} words" for i in range(40))
    assert all(got[200 + i].startswith("The title\nA long text.") and got[200 + i].endswith(f"views {i}") for i in range(20))


def test_unmarked_boilerplate_inside_the_article(spark):
    rows = [(i, "http://h.example/x", page(
        f"<article><h1>Title {i}</h1><p>Own text {i} of this page</p>" + "<h2>Part</h2>" * (i % 3 == 0) + f"<p>More {i * 7} text</p>" * (i % 4)
        + "<p>Read <b>also</b> our guide</p><div>We deliver on working days</div></article>")) for i in range(12)]
    rows += [(100 + i, "http://small.example/x", rows[i][2]) for i in range(4)]
    got = {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    own = [[f"Title {i}", f"Own text {i} of this page"] + ["Part"] * (i % 3 == 0) + [f"More {i * 7} text"] * (i % 4) for i in range(12)]
    assert all(got[i] == "\n".join(own[i]) for i in range(12))
    assert all(got[100 + i] == "\n".join(own[i]) for i in range(4))    # as on the larger host
    # it is the wrapper that tells: alone, every page keeps the lines
    assert all(text_of(rows[i][2][rows[i][2].index("<article>"):]).endswith("We deliver on working days") for i in range(12))


def test_what_stands_between_slots_stays(spark):
    def recipe(i):
        return page(f"<article><h1>Dish {i}</h1><h2>Ingredients</h2><ul><li>{i} eggs</li><li>salt</li></ul><table><tr><th>Step</th><th>Time</th></tr>"
                    f"<tr><td>{i}</td><td>10</td></tr></table><h2>Method</h2><p>Cook it {i} minutes, for dish {i}.</p><p>Printed from our kitchen</p></article>")
    for n in (2, 4, 6, 40):
        df = spark.createDataFrame([(i, "http://r.example/x", recipe(i)) for i in range(n)], PAGES)
        for r in wrappers.extract_text(df).collect():
            i = r.page_id
            assert r.text == f"Dish {i}\nIngredients\n{i} eggs\nsalt\nStep\nTime\n{i}\n10\nMethod\nCook it {i} minutes, for dish {i}."


def test_fixed_lines_equal_brute_force(spark):
    """Lines on all different pages of a host, counted one by one."""
    rnd = random.Random(6)
    rows = [(100 * h + i, f"http://h{h}.example/x", page("<article>" + "".join(
        f"<p>{rnd.choice(['same', 'other', f'own {i} {h}'])} line {k}</p>" if rnd.random() < 0.4 else f"<p>fixed line {k} of a page</p>" for k in range(6)) + "</article>"))
        for h in range(12) for i in range(rnd.choice([1, 2, 3, 7]))]
    df = spark.createDataFrame(rows, PAGES).select("page_id", wrappers.host_of(F.col("url")).alias("host"), "html")
    known = wrappers.template_lines(df, settle(wrappers.infer_wrappers(spark.createDataFrame(rows, PAGES)), "test")).collect()
    for r in known:
        extractor = wrappers.Extractor(wrappers.Part.load(json.loads(r.wrapper)))
        pages = {tuple(line for _, line in lines): {(p, wrappers.hash_of(line)) for p, line in lines}
                 for lines in (extractor.lines(source) for _, url, source in rows if f"//{r.host}/" in url)}
        want = set.intersection(*pages.values()) if len(pages) > 1 else set()
        assert set(map(tuple, json.loads(r.template))) == want


def test_broken_pages_take_time_in_proportion():
    for bad in ("<a ", "<!", "<script></script", "<a b='", "<a \">\" <b ", "</", "<!--", "<p class=x" + "y" * 50 + " ", "<a '\" ", "<x"):
        start = time.process_time()
        for end in ("", ">", "'>", "\"'>"):
            wrappers.parse(bad * (2_000_000 // len(bad)) + end)
        wrappers.key_of("p", bad * (1_000_000 // len(bad)) + " id=1")
        assert time.process_time() - start < 60, bad


def test_tags_are_read_as_before():
    def names(source):
        return [(t[2], t[3], t[4]) for t in wrappers.tags_of(source) if t[3]]
    assert names("<a href='x>y' b=\">\">t</a >< b><B/><!-- <i> --><!doctype x><p class=q>") == [
        ("", "a", " href='x>y' b=\">\""), ("/", "a", " "), ("", "b", "/"), ("", "p", " class=q")]
    assert wrappers.key_of("h2", " id='sec-17' class='title t-9 lead'") == "h2 lead title"
    assert wrappers.key_of("div", " id=sidebar class=\"ad12\"") == "div ad0 sidebar"


def test_wrappers_are_flat_over_pages_with_ids_of_their_own():
    sizes, whole = [], None
    for i in range(400):
        part = wrappers.part_of(wrappers.parse(page(f"<article class='post post-{i}'><h1 id='t{i}'>T {i}</h1>" + "".join(
            f"<h2 id='s-{i}-{k}'>S</h2><p class='p{k}'>x {i}</p>" for k in range(i % 5)) + "</article>")))
        whole = part if whole is None else wrappers.join_wrappers(whole, part)
        sizes.append(len(json.dumps(whole.dump())))
    assert sizes[-1] < 1.2 * sizes[20]


def text_of(body, *others):
    whole = None
    for x in (body, *others):
        part = wrappers.part_of(wrappers.parse(page(x)))
        whole = part if whole is None else wrappers.join_wrappers(whole, part)
    return wrappers.Extractor(whole).text(page(body))


def test_class_words_do_not_hide_the_main_part():
    long = "A long paragraph of the page, with words enough to be read. " * 8
    for mark in ("post has-sidebar", "no-sidebar", "layout-right-sidebar", "long-form", "comments-open", "related-work", "ad-free", "sidebar", "notice",
                 "form", "site-banner", "promo"):
        for body in ("<article class='{}'><h1>T</h1><p>Own text</p></article>", "<main id='{}'><h1>T</h1><p>Own text</p></main>",
                     "<div class='{}'><article><h1>T</h1><p>Own text</p></article></div>", "<div id='{}'><div role=main><h1>T</h1><p>Own text</p></div></div>"):
            assert text_of("<nav>Menu</nav>" + body.format(mark) + "<div class='sidebar'>Side</div><footer>F</footer>") == "T\nOwn text", (mark, body)
    for mark in ("has-sidebar", "layout-right-sidebar", "long-form", "comments-open", "related-work", "ad-free"):
        assert text_of(f"<div class='{mark}'><p>Short own text</p></div><div class='sidebar'>Side</div>") == "Short own text", mark
        assert text_of(f"<article><p>One</p><section class='{mark}'><p>Two</p></section></article>") == "One\nTwo", mark
    # the wrapper overrules the words where it has long varying text, but not for adverts, comments, links or short notices
    pages = [f"<div class='{{}}'><p>{i} {long}</p></div><div class='cookie-bar'>We use {i}</div>" for i in range(3)]
    for mark in ("form-content", "toolbar-page", "widget", "notice"):
        assert text_of(*(p.format(mark) for p in pages)) == f"0 {long.strip()}", mark
    for mark in ("ad", "comments", "comment-list", "sponsored-text"):
        assert text_of(*(p.format(mark) for p in pages)) == "", mark
    assert text_of(*(f"<article><p>Own {i}</p></article><div class='related-posts'><a>{i} {long}</a></div>" for i in range(3))) == "Own 0"
    assert text_of(f"<div class='sidebar-layout'><article><p>Own</p></article><div class='sidebar'>{long}</div></div>") == "Own"
    # teasers are no main part beside a longer text, nor are comments beside an article
    assert text_of(f"<div class=text><p>{long}</p></div><div class=related><article>Teaser</article></div>") == long.strip()
    assert text_of("<article class=post><p>Own</p></article><article class=comment>Reader</article>") == "Own"
    for mark in ("share-buttons", "cookie-notice", "site-footer", "left-sidebar", "post-comments", "sidebar-inner", "ad0"):
        assert text_of(f"<article><p>Own</p><div class='{mark}'>Side</div></article>") == "Own", mark


def test_wrappers_get_optional_and_repeated_groups():
    a, b = (wrappers.part_of(wrappers.parse(page(x))) for x in ("<h1>A</h1><p>1</p>", "<h1>B</h1><h2>s</h2><p>1</p><p>2</p>"))
    whole = wrappers.join_wrappers(a, b)
    pattern = whole.pattern()
    assert "<h1>TEXT</>" in pattern and "(<h2>text</>)?" in pattern and "(<p>TEXT</>)+" in pattern
    again = wrappers.Part.load(json.loads(json.dumps(whole.dump())))
    assert again.pages == 2 and again.pattern() == pattern


def test_a_wrapper_does_not_grow_with_pages():
    whole = None
    for i in range(60):
        tags = [["p", "h2", "ul", "div"][(i * k + k) % 4] for k in range(40)]
        part = wrappers.part_of(wrappers.parse(page("<article>" + "".join(f"<{t}>x{i}</{t}>" for t in tags) + "</article>")))
        whole = part if whole is None else wrappers.join_wrappers(whole, part)
    assert len(json.dumps(whole.dump())) < 3000


def test_partial_wrappers_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(13)
    got = wrappers.infer_wrappers(pages).collect()
    assert sum(r.n_pages for r in got) == pages.count() and len({r.host for r in got}) == len(got)


def test_odd_pages(spark):
    sources = [None, "", "   ", "plain text only", "<p>open <b>tags", "<<<>>>", "a < b > c", "<!-- never closed", "<script>never closed",
               "<article></article>", "</div></p>", "<p class=\"unbalanced>text</p>", "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>",
               "<div>" * 9000 + "deep" + "</div>" * 9000 + "<p>after</p>"]
    rows = [(i, None if i % 2 else "not a url", s, "x") for i, s in enumerate(sources)] + [(3, "not a url", "plain text only", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in wrappers.extract_text(df).collect()}
    assert got[0] == got[1] == got[2] == "" and got[4] == "open tags"
    assert got[12].count("\n") == 19_999 and got[13] == "deep\nafter"
    assert wrappers.extract_text(df).count() == len(rows)
    assert wrappers.extract_text(df.where("false")).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = settle(stage(spark, docs, "/root/testdata/sf0.01"), f"test-{name}")
        counts.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
        if name != "encode":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert counts[-1] == counts[-2] and docs.where("n_tokens = 0 or length(ids) <> 4 * n_tokens").isEmpty()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id", "left_semi").count() <= 2


def test_pipeline_of_odd_rows(spark):
    for docs in (odd(spark), none(spark)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_words")
        for name, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, SF), f"odd-{name}")


def test_the_rest_works_without_this_package(tmp_path):
    for name in ("gridweave", "workload", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "gridweave/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not [n for n in q if n.startswith('op')]; print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
