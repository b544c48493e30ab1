"""Jobs over stored pages, search results and profile texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import dom, pages, people

from . import derived, query, table


def nodes(spark, sf):
    return dom.dom_nodes(table(spark, sf, "pages"))


TITLE = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("x01_page_titles", rf"""
    WITH w AS (SELECT CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN 'https://nowhere.example/' || page_id END AS raw FROM pages),
    n AS (SELECT CASE WHEN raw LIKE 'http%://%' THEN raw ELSE 'https://' || raw END AS url FROM w WHERE raw IS NOT NULL)
    SELECT n.url, CASE WHEN p.url IS NULL THEN '' ELSE {TITLE} END AS title, CASE WHEN p.url IS NULL THEN 'no' ELSE 'yes' END AS ok FROM n LEFT JOIN pages p ON p.url = n.url""")
def x01(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id") % 4
    rows = p.select(F.when(k == 0, F.col("url")).when(k == 3, "  ").alias("url"),
                    F.when(k == 1, F.concat(F.lit(" "), F.regexp_replace("url", "^https?://", ""))).when(k == 3, "").alias("target_url"),
                    F.when(k == 2, F.concat(F.lit("https://nowhere.example/"), "page_id")).alias("profile_url"))
    return pages.page_titles(rows, p)


RESULTS = """SELECT page_id % 9 AS query, page_id % 5 AS page, page_id AS position, regexp_replace(url, '/[0-9].*$', '') AS url, 'title ' || page_id AS title FROM pages"""
RANKED = f"""WITH r AS ({RESULTS}), f AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY page, position) AS k FROM r)
    SELECT query, url, title, row_number() OVER (PARTITION BY query ORDER BY page, position, url) AS rank FROM f WHERE k = 1"""


def results(spark, sf):
    return table(spark, sf, "pages").select(
        (F.col("page_id") % 9).alias("query"), (F.col("page_id") % 5).alias("page"), F.col("page_id").alias("position"),
        F.regexp_replace("url", "/[0-9].*$", "").alias("url"), F.concat(F.lit("title "), "page_id").alias("title"))


@query("x02_rank_results", f"SELECT * FROM ({RANKED}) WHERE rank <= 10")
def x02(spark, sf):
    return pages.rank_results(results(spark, sf), 10).select("query", "url", "title", F.col("rank").cast("bigint").alias("rank"))


@query("x02_rank_all_results", RANKED)
def x02b(spark, sf):
    return pages.rank_results(results(spark, sf)).select("query", "url", "title", "rank")


@query("x03_result_host", r"""
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) END AS host FROM pages""")
def x03(spark, sf):
    k = F.col("page_id") % 5
    url = F.when(k == 0, "https://www.google.co.uk/goto?url=abc").when(k == 1, F.concat(F.lit("http://localhost/"), "page_id")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", pages.result_host(url).alias("host"))


@query("x04_breadcrumb_to_url", r"""
    SELECT page_id, CASE WHEN page_id % 6 = 5 THEN NULL ELSE CASE WHEN page_id % 6 = 1 THEN 'http://' ELSE 'https://' END || host || '/' || lang || CASE WHEN page_id % 6 = 2 THEN '' ELSE '/' || num END END AS url,
      CASE WHEN page_id % 6 <> 5 THEN page_id % 6 = 2 END AS elided
    FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_extract(url, '/([0-9]+)', 1) AS num FROM pages)""")
def x04(spark, sf):
    u, k = F.col("url"), F.col("page_id") % 6
    host, lang, num = (F.regexp_extract(u, p, 1) for p in ("^https?://([^/?#:]+)", "/([a-z]{2})/", "/([0-9]+)"))
    cite = F.when(k == 5, F.concat(F.lit("r/codex · "), num)).otherwise(F.concat(
        F.when(k == 1, "http://").otherwise(""), host, F.lit(" › "), lang, F.when(k == 2, " › ...").otherwise(F.concat(F.lit(" > "), num)), F.lit("\nsecond line")))
    b = pages.breadcrumb_to_url(cite)
    return table(spark, sf, "pages").select("page_id", b["url"].alias("url"), b["elided"].alias("elided"))


LINKS = """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages"""


# Every element of the given pages with what it directly holds: bodies have no text after closing tags, and the only
# elements left open are p, b and br, whose depths follow from their tags.
NODES = r"""opened AS (SELECT page_id, unnest(range(len(tags))) AS seq, unnest(tags) AS x FROM (
      SELECT page_id, regexp_extract_all(regexp_replace(html, '<head>.*?</head>|<!--.*?-->', '', 'gs'), '<[a-z][^>]*>[^<]*') AS tags FROM pages)),
    read AS (SELECT page_id, seq, regexp_extract(x, '^<([a-z0-9]+)', 1) AS tag, regexp_extract(x, ' class="([^"]*)"', 1) AS cls,
      replace(regexp_extract(x, ' href="([^"]*)"', 1), '&amp;', '&') AS href, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_extract(x, '>([^<]*)$', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g')) AS own FROM opened),
    nodes AS (SELECT *, CASE WHEN tag = 'html' THEN 0 WHEN tag = 'body' THEN 1 WHEN tag IN ('nav', 'div', 'article', 'footer') THEN 2
        WHEN tag IN ('ul', 'h1', 'p') THEN 3 WHEN tag IN ('li', 'b') THEN 4 ELSE 5 END AS depth,
      CASE WHEN tag = 'li' THEN max(CASE WHEN tag = 'ul' THEN seq END) OVER page WHEN tag IN ('h1', 'p') THEN max(CASE WHEN tag = 'article' THEN seq END) OVER page
        WHEN tag IN ('nav', 'div', 'article', 'footer') THEN 1 ELSE seq - 1 END AS parent
      FROM read WINDOW page AS (PARTITION BY page_id))"""


@query("x05_dom_nodes", f"""
    WITH {NODES} SELECT page_id, CAST(seq AS INTEGER) AS seq, depth, CAST(parent AS INTEGER) AS parent, tag, cls, href, own FROM nodes""")
def x05(spark, sf):
    return nodes(spark, sf).select("page_id", "seq", "depth", "parent", "tag", "cls", F.coalesce(dom.attr("href"), F.lit("")).alias("href"), "own")


@query("x06_extract_records", f"SELECT page_id, replace(href, '&amp;', '&') AS href, replace(trim(text), '&amp;', '&') AS text, regexp_extract(replace(trim(text), '&amp;', '&'), '^(.)', 1) AS initial FROM ({LINKS})")
def x06(spark, sf):
    out = dom.extract_records(nodes(spark, sf), "a", {"href": "@href", "text": "text", "initial": "regex:^(.)"})
    return out.select("page_id", "href", "text", "initial")


@query("x06_extract_nested_records", f"SELECT page_id, replace(href, '&amp;', '&') AS href, replace(trim(text), '&amp;', '&') AS label FROM ({LINKS})")
def x06b(spark, sf):
    return dom.extract_records(nodes(spark, sf), "li", {"href": "a[href]@href", "label": "a"}).select("page_id", "href", "label")


@query("x06_extract_by_chains", f"""
    WITH {NODES}, named AS (SELECT page_id, max(CASE WHEN tag = 'h1' THEN own END) AS title, max(CASE WHEN tag = 'div' THEN seq END) AS advert FROM nodes GROUP BY page_id)
    SELECT l.page_id, l.seq AS box, a.own AS label, a.href, l.seq = min(l.seq) OVER (PARTITION BY l.page_id) AS leads
    FROM nodes l JOIN nodes a ON a.page_id = l.page_id AND a.parent = l.seq JOIN named n ON n.page_id = l.page_id WHERE l.tag = 'li' AND l.seq < n.advert""")
def x06c(spark, sf):
    out = dom.extract_records(nodes(spark, sf), "body > nav li", {"label": ":scope > a", "href": "nav > ul a[href]@href", "first": "li:first-child > a"})
    return out.select("page_id", F.col("box").cast("bigint").alias("box"), "label", "href", F.col("first").isNotNull().alias("leads"))


@query("x06_extract_by_list", f"""
    WITH {NODES} SELECT page_id, seq AS box, own AS text FROM nodes n WHERE tag IN ('h1', 'footer') OR (tag = 'p' AND own <> '' AND seq = (
      SELECT min(seq) FROM nodes h WHERE h.page_id = n.page_id AND h.tag = 'h1') + 1)""")
def x06d(spark, sf):
    plain = "h1 + p, article > h1, body > div.ad ~ footer"
    out = dom.extract_records(nodes(spark, sf), plain, {"text": "text", "bold": ":scope > b"})
    return out.where("bold is null").select("page_id", F.col("box").cast("bigint").alias("box"), "text")


@query("x07_detect_repeated_block", "SELECT page_id, 'li' AS signature, n AS items, false AS too_broad FROM (SELECT page_id, len(regexp_extract_all(html, '<li><a ')) AS n FROM pages) WHERE n >= 3")
def x07(spark, sf):
    return dom.detect_repeated_block(nodes(spark, sf), min_text=1).select("page_id", "signature", "items", "too_broad")


@query("x08_page_outline", f"""
    WITH {NODES}, links AS (SELECT *, row_number() OVER page - 1 AS idx, (own, href) IS DISTINCT FROM lag((own, href)) OVER page AS fresh
        FROM nodes WHERE tag = 'a' WINDOW page AS (PARTITION BY page_id ORDER BY seq)),
    runs AS (SELECT page_id, min(seq) AS seq, min(idx) AS idx, count(*) AS n, any_value(own) AS own, any_value(href) AS href FROM (
        SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY page_id ORDER BY seq) AS run FROM links) GROUP BY page_id, run),
    lines AS (SELECT page_id, seq, own AS line FROM nodes WHERE tag <> 'a' AND length(own) > 1
        UNION ALL SELECT page_id, seq, '[' || idx || ']<a href="' || href || '">' || CASE WHEN own <> '' THEN ' ' || own ELSE '' END || CASE WHEN n > 1 THEN
          '  (×' || n || ' similar — idx ' || array_to_string(range(idx, idx + least(n, 5)), ', ') || CASE WHEN n > 5 THEN '…' ELSE '' END || ')' ELSE '' END FROM runs)
    SELECT page_id, CAST(length(outline) AS INTEGER) AS chars, sha256(outline) AS sha FROM (SELECT page_id, string_agg(line, chr(10) ORDER BY seq) AS outline FROM lines GROUP BY page_id)""")
def x08(spark, sf):
    out = dom.page_outline(dom.snapshot(nodes(spark, sf)), dedup=True, max_chars=None)
    return out.select("page_id", F.length("outline").alias("chars"), F.sha2("outline", 256).alias("sha"))


@query("x09_find_elements", f"SELECT page_id, replace(text, '&amp;', '&') AS name, href FROM ({LINKS}) WHERE contains(lower(text), 'an')")
def x09(spark, sf):
    return dom.find_elements(dom.snapshot(nodes(spark, sf)), "AN", "a").select("page_id", "name", "href")


@query("x10_resolve_redirects", """
    WITH RECURSIVE walk(url, now, hops) AS (SELECT url, url, 0 FROM pages UNION ALL SELECT w.url, r.location, w.hops + 1 FROM walk w JOIN redirects r ON r.url = w.now WHERE w.hops < 5)
    SELECT url, arg_max(now, hops) AS final_url, max(hops) AS hops FROM walk GROUP BY url""", uses=("redirects",))
def x10(spark, sf):
    return pages.resolve_redirects(table(spark, sf, "pages").select("url"), derived(spark, sf, "redirects"))


@query("x11_parse_cards", """
    SELECT c_custkey, c_name || ' Ltd' AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'https://www.linkedin.com/in/' || CASE WHEN c_custkey % 4 = 1 THEN 'é' ELSE 'p' END || c_custkey END AS url,
      CASE c_custkey % 3 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' ELSE '3rd+' END AS degree, 'Head of ' || lower(c_mktsegment) AS headline, 'Nation ' || c_nationkey AS location,
      CASE WHEN c_custkey % 2 = 0 THEN 'Consulting' ELSE '' END AS services, 'mutual one' || CASE WHEN c_custkey % 5 = 0 THEN ' | balance ' || CAST(c_acctbal AS VARCHAR) ELSE '' END AS extra FROM customer""")
def x11(spark, sf):
    c = table(spark, sf, "customer")
    badge = F.when(F.col("c_custkey") % 3 == 0, " • 1st").when(F.col("c_custkey") % 3 == 1, " · 2°").otherwise(" • 3rd+")
    name = F.concat("c_name", F.lit(" Ltd"))
    head = F.concat(F.lit("Head of "), F.lower("c_mktsegment"))
    text = F.concat_ws("\n", F.concat(name, badge), F.lit("​"), F.concat(F.lit(" • "), head), F.lit("View profile"), F.concat(F.lit("Nation  "), "c_nationkey"), F.lit("Connetti"),
                       F.when(F.col("c_custkey") % 2 == 0, "Provides services - Consulting"), F.upper(head), F.lit("mutual one"),
                       F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("balance "), "c_acctbal")))
    href = F.when(F.col("c_custkey") % 4 == 0, "/jobs/1").when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("/in/%C3%A9"), "c_custkey", F.lit("?x=1"))).otherwise(F.concat(F.lit("https://www.linkedin.com/in/p"), "c_custkey", F.lit("/")))
    cards = c.select("c_custkey", text.alias("text"), F.concat(F.lit(" "), name, badge).alias("name_text"), href.alias("href"))
    return people.parse_cards(cards)


@query("x12_parse_profiles", """
    SELECT c_custkey, c_name AS name, 'Head of ' || lower(c_mktsegment) AS headline, CASE WHEN c_custkey % 3 <> 0 THEN 'Nation ' || c_nationkey ELSE '' END AS location,
      CASE WHEN c_custkey % 3 <> 0 THEN 'Company ' || c_nationkey ELSE '' END AS current_company, CASE WHEN c_custkey % 3 = 1 THEN 'School' ELSE '' END AS education, '500+' AS connections,
      CASE WHEN c_custkey % 2 = 0 THEN '1,234' ELSE '' END AS followers, 'First line. Second line ' || c_custkey AS about, c_custkey % 3 <> 0 AS contact_info, c_custkey % 7 = 0 AS open_to_work FROM customer""")
def x12(spark, sf):
    k = F.col("c_custkey")
    contact = k % 3 != 0
    text = F.concat_ws("\n", "c_name", F.when(k % 2 == 0, "(She/Her)"), F.lit("· 2nd"), F.concat(F.lit("Head of "), F.lower("c_mktsegment")),
                       F.when(contact, F.concat(F.lit("Nation "), "c_nationkey")), F.when(contact, "·"), F.when(contact, F.when(k % 2 == 0, "Contact info").otherwise("Informazioni di contatto")),
                       F.when(contact, F.concat(F.lit("Company "), "c_nationkey")), F.when(k % 3 == 1, "School"), F.lit("500+ connections"), F.when(k % 2 == 0, "1,234 followers"),
                       F.lit("Connect"), F.lit("About"), F.lit("First line."), F.concat(F.lit(" Second  line "), k), F.lit("…see more"), F.lit("Experience"), F.lit("somewhere"),
                       F.when(k % 7 == 0, "Open to work"), F.lit("Accessibility"), F.lit("9,999 followers #opentowork"))
    return table(spark, sf, "customer").select("c_custkey", text.alias("text")).transform(people.parse_profiles)


@query("x13_dedup_people", """
    WITH p AS (SELECT c_custkey AS seq, 'P' || (c_custkey % 400) AS name, c_mktsegment AS headline, CASE WHEN c_custkey % 3 = 0 THEN 'https://x/in/' || (c_custkey % 333) ELSE '' END AS url FROM customer),
    f AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url <> '' THEN url ELSE name || '|' || headline END ORDER BY seq) AS k FROM p)
    SELECT seq, name, headline, url, row_number() OVER (ORDER BY seq) AS rank FROM f WHERE k = 1""")
def x13(spark, sf):
    k = F.col("c_custkey")
    cards = table(spark, sf, "customer").select(k.alias("seq"), F.concat(F.lit("P"), k % 400).alias("name"), F.col("c_mktsegment").alias("headline"),
                                                F.when(k % 3 == 0, F.concat(F.lit("https://x/in/"), k % 333)).otherwise("").alias("url"))
    return people.dedup_people(cards)


@query("x14_enrich", """
    SELECT c_custkey AS url, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE c_name END AS name, c_mktsegment AS headline, CASE WHEN n_nationkey IS NULL THEN 'card' ELSE 'R' || n_regionkey END AS location,
      CASE WHEN n_nationkey IS NULL THEN '' ELSE 'school' END AS education, CASE WHEN n_nationkey % 3 = 0 THEN 'yes' ELSE '' END AS premium
    FROM customer LEFT JOIN nation ON n_nationkey * 7 = c_custkey""")
def x14(spark, sf):
    cards = table(spark, sf, "customer").select(F.col("c_custkey").alias("url"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("headline"),
                                                F.lit("card").alias("location"))
    n = table(spark, sf, "nation")
    profiles = n.select((F.col("n_nationkey") * 7).cast("bigint").alias("url"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("name"),
                        F.lit(None).cast("string").alias("headline"), F.concat(F.lit("R"), "n_regionkey").alias("location"), F.lit("school").alias("education"),
                        (F.col("n_nationkey") % 3 == 0).alias("premium"))
    return people.enrich(cards, profiles)


@query("x15_build_search_urls", """
    WITH s AS (SELECT c_custkey AS id, c_mktsegment AS kw, c_custkey % 4 AS m, c_nationkey AS n, c_name FROM customer)
    SELECT id, 'https://www.linkedin.com/search/results/people/?keywords=' || url_encode(kw || CASE WHEN m = 2 THEN ' Atlantis' ELSE '' END) || '&firstName=' || url_encode(c_name)
      || CASE WHEN m = 1 THEN '&schoolFreetext=' || url_encode('"MIT & co"') ELSE '' END || '&network=' || url_encode('["F","O"]') || '&profileLanguage=' || url_encode('["en","it"]')
      || CASE m WHEN 0 THEN '&geoUrn=' || url_encode('["' || (1000 + n) || '"]') WHEN 1 THEN '&geoUrn=' || url_encode('["77","900"]') WHEN 3 THEN '&geoUrn=' || url_encode('["900"]') ELSE '' END || '&origin=FACETED_SEARCH' AS search_url FROM s""")
def x15(spark, sf):
    k = F.col("c_custkey") % 4
    specs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("keywords"), F.col("c_name").alias("first_name"), F.when(k == 1, "MIT & co").alias("school"),
        F.lit("1st, 3RD+,bogus,f").alias("connections"), F.lit("en, it,").alias("profile_languages"),
        F.when(k == 0, F.concat(F.lit("nation_"), "c_nationkey")).when(k == 1, "Roma, 77").when(k == 2, "Atlantis").otherwise("Atlantis, Rome").alias("locations"))
    n = table(spark, sf, "nation")
    entities = n.select(F.lit("location").alias("kind"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 1000).cast("string").alias("entity_id")).unionByName(
        n.where("n_nationkey = 0").select(F.lit("location").alias("kind"), F.lit("Rome").alias("name"), F.lit("900").alias("entity_id")))
    return people.build_search_urls(specs, entities).select("id", "search_url")


RULES = [("french", r"\b(qui|dans)\b"), ("german", "nicht|schst"), ("digits", r"\d{3,}")]


@query("x16_classify_text", r"""
    SELECT doc_id, CASE WHEN regexp_matches(text, '(?i) (qui|dans) ') THEN 'french' WHEN regexp_matches(text, '(?i)nicht|schst') THEN 'german' WHEN regexp_matches(text, '\d{3,}') THEN 'digits' ELSE 'ok' END AS status FROM documents""")
def x16(spark, sf):
    rules = [("french", " (qui|dans) "), *RULES[1:]]
    return table(spark, sf, "documents").select("doc_id", pages.classify_text(F.col("text"), rules).alias("status"))


@query("x16_refusals_by_status", r"""
    SELECT CASE o_orderkey % 7 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'needs_flair' WHEN 2 THEN 'not_postable' WHEN 3 THEN 'community_not_found' WHEN 4 THEN 'community_restricted' WHEN 5 THEN 'rate_limited' ELSE 'ok' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def x16b(spark, sf):
    said = ["Try again in 5 minutes", "Post Flair required, please SELECT a flair", "Your account is too new", "Sorry, nobody on Reddit goes by that name", "This is a private community",
            "Slow down: you are banned from here", "all fine"]
    text = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    o = table(spark, sf, "orders").select(F.concat_ws(" / ", "o_orderpriority", text).alias("text"))
    return o.groupBy(pages.classify_text(F.col("text"), pages.REFUSAL_RULES).alias("status")).agg(F.count("*").alias("n"))


@query("x17_canonical_post_url", """
    SELECT o_orderkey AS post, CASE o_orderkey % 4 WHEN 0 THEN 'https://www.reddit.com/r/a/comments/' || o_orderkey || '/slug/' WHEN 1 THEN 'https://www.reddit.com/user/b/comments/' || o_orderkey || '/mine/'
      WHEN 2 THEN 'https://www.reddit.com/r/c/comments/' || o_orderkey || '/first/' ELSE '' END AS post_url FROM orders""")
def x17(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 4
    oid = F.col("o_orderkey").cast("string")
    cands = F.array(
        F.struct(F.lit("url").alias("kind"), F.when(k == 0, F.concat(F.lit("https://old.reddit.com/r/a/comments/"), oid, F.lit("/slug?x=1"))).otherwise("https://www.reddit.com/r/a/submit/").alias("href"), F.lit(1).alias("seq")),
        F.struct(F.lit("title").alias("kind"), F.when(k < 2, F.concat(F.lit("/user/b/comments/"), oid, F.lit("/mine/"))).otherwise("/nope").alias("href"), F.lit(2).alias("seq")),
        F.struct(F.lit("first").alias("kind"), F.when(k < 3, F.concat(F.lit("/r/c/comments/"), oid, F.lit("/first?ref=1"))).otherwise("/r/c/").alias("href"), F.lit(3).alias("seq")),
        F.struct(F.lit("first").alias("kind"), F.lit("/r/c/comments/later/one").alias("href"), F.lit(4).alias("seq")))
    return pages.canonical_posts(o.select(F.col("o_orderkey").alias("post"), F.inline(cands)))
