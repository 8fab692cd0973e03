import pytest

from siteloom.functions import protocols as P
from siteloom.functions.html import SelectorError, parse, select, squeeze
from siteloom.functions.url import match_key, normalize, resolve
from siteloom.operators import agents
from siteloom.operators.features import extraction_rules, facts, parse_rule
from siteloom.operators.logs import detect_format
from siteloom.operators.neardup import shingle_words, signature
from siteloom.operators.sampling import bucket_quotas
from siteloom.sources.crawls import fetch_page, file_stamp, free_stamp, stamp_of

PAGE = """<!doctype html><html lang="en-GB"><head><title> A
 title </title><title>two</title><META NAME=Description content="d &amp; e"><link rel="canonical" href="/c/"><link rel=alternate hreflang=de href="/de"><link rel=alternate hreflang="bad tag" href="/x">
<meta property="og:title" content="og"><meta name=viewport content="width=device-width"><script type="application/ld+json">{"@graph":[{"@type":["Article","Thing"],"headline":"h"}]}</script></head>
<body><h1> One <b>two</b></h1><p>para<p>graph<ul><li class="a x">1<li id=z data-k="v w">2</ul><a href="/p#f">read more</a><a href="mailto:x">m</a><a href="q"><img alt="pic" src=a.png></a><img src="b.webp" alt=" ">"""


def test_facts():
    f = facts(PAGE, "https://h.example/dir/page", extraction_rules({"items": {"selector": "li", "all": True}, "k": "li#z@data-k", "raw": "h1#html", "none": ".q"}))
    assert (f["title"], f["title_count"], f["meta_description"], f["canonical"], f["html_lang"]) == ("A title", 2, "d & e", "https://h.example/c", "en-GB")
    assert f["hreflang"] == [{"lang": "de", "url": "https://h.example/de"}] and f["hreflang_invalid"] == ["bad tag"] and f["h1s"] == ["One two"]
    assert [(a["url"], a["text"]) for a in f["anchors"]] == [("https://h.example/p", "read more"), ("https://h.example/dir/q", "pic")]
    assert dict(f["extracted"]) == {"items": ["1", "2"], "k": ["v w"], "raw": ["One <b>two</b>"], "none": []}
    assert f["schema_types"] == ["Article", "Thing"] and f["schema_codes"] == ["SCHEMA_ARTICLE_MISSING_IMAGE", "SCHEMA_ARTICLE_MISSING_DATE_PUBLISHED", "SCHEMA_ARTICLE_MISSING_AUTHOR"]
    assert f["open_graph"] == {"title": "og", "description": None, "image": None} and len(f["images"]) == 2
    empty = facts(None, "")
    assert empty["title"] is None and empty["anchors"] == [] and empty["body_text"] == ""
    assert facts("<div><<p>" * 3000, "x")["title"] is None


@pytest.mark.parametrize(("selector", "texts"), [("li", ["1", "2"]), ("ul > li.a", ["1"]), ("li:first-child", ["1"]), ("li + li", ["2"]), ("li ~ li", ["2"]), ("[data-k~=w]", ["2"]), ("[data-k^='v']", ["2"]), ("[data-k]", ["2"]), ("li:not(.a)", ["2"]), ("h1 b, #z", ["two", "2"]), ("li:nth-child(2n)", ["2"]), ("p:first-of-type", ["para"]), ("ul li:last-of-type", ["2"]), (".none", [])])
def test_selectors(selector, texts):
    assert [squeeze(n.text()) for n in select(parse(PAGE), selector)] == texts


def test_bad_selectors_and_rules():
    for bad in ("", "li >> ", "a[", ":hover"):
        with pytest.raises(SelectorError):
            select(parse(PAGE), bad)
    assert parse_rule("a.b@href") == {"selector": "a.b", "attr": "href", "html": False} and parse_rule("[x='a@b']")["attr"] is None
    with pytest.raises(ValueError):
        extraction_rules({"x": "@href"})


def test_urls():
    assert normalize("HTTPS://Www.Ex.example:443/a/b//?q=1#f") == "https://www.ex.example/a/b?q=1" and normalize("http://e.example") == "http://e.example/" and normalize("ftp://x/") is None and normalize("http://[") is None
    assert resolve("https://h.example/a/b", "../c/") == "https://h.example/c" and resolve("https://h.example/", "javascript:void(0)") is None
    assert match_key("https://H.example:443/a/?b=2&utm_source=x&a=1&gclid=3") == "https://h.example/a/?a=1&b=2" and match_key("  none ") == "none"


def test_link_header():
    got = P.parse_link_header('<https://a/x,y>; rel="canonical next"; title="a, b; c", </z>; rel=prev, broken')
    assert [(x["url"], x["rel"]) for x in got] == [("https://a/x,y", ["canonical", "next"]), ("/z", ["prev"])] and got[0]["params"]["title"] == "a, b; c" and P.parse_link_header(None) == []


def test_robots():
    text = "User-agent: A\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\nSitemap: https://h/s.xml\n\nDisallow: /\nUser-agent: B\nDisallow:\n"
    r = P.parse_robots(text)
    assert r["sitemaps"] == ["https://h/s.xml"] and not r["blocks_all"] and [x[0] for x in r["rules"]] == ["*", "*", "*", "b"]
    assert P.url_allowed("/x/y/z", "a", r["rules"]) and not P.url_allowed("/x/q", "a", r["rules"]) and P.url_allowed("/x", "none", [])
    assert P.parse_robots("User-agent: *\nDisallow: /")["blocks_all"] and P.parse_robots(None)["rules"] == []
    assert P.parse_content_signals("Content-Signal: search=yes, ai-train=no\ncontent-signal: ai-train=yes, x=maybe") == {"search": "yes", "ai-train": "yes"}
    assert P.parse_content_signals("Content-Signals: ai-input=disallow, search=TRUE, other=yes") == {"ai-input": "no", "search": "yes"}
    llms = P.evaluate_llms("  # T\n\n  ## S\n[a](b \"title\")\n[c](d)")
    assert llms["has_h1"] and llms["sections"] == 1 and llms["links"] == 2
    assert P.link_rels('</a>; rel="Next prev", </b>; rel=next') == ["next", "prev"]


def test_sitemaps():
    xml = "<urlset><url><loc>https://h/a&amp;b</loc><lastmod>2024-01-01</lastmod></url><url><loc><![CDATA[https://h/c]]></loc></url><url></url></urlset>"
    assert P.sitemap_entries(xml) == [("https://h/a&b", "2024-01-01"), ("https://h/c", None)] and P.sitemap_locations(xml + "<loc x='1'>https://h/c</loc>") == ["https://h/a&b", "https://h/c"]
    assert P.sitemap_index("<sitemapindex><sitemap><loc>https://h/1.xml</loc></sitemap></sitemapindex>") == ["https://h/1.xml"] and P.sitemap_index(xml) == [] and P.sitemap_entries(None) == []


@pytest.mark.parametrize(("node", "codes"), [
    ({"@type": "Product", "name": "n", "image": ["i"], "offers": {"price": 0}}, ["SCHEMA_PRODUCT_OFFERS_MISSING_CURRENCY"]), ({"@type": "Product"}, ["SCHEMA_PRODUCT_MISSING_NAME", "SCHEMA_PRODUCT_MISSING_IMAGE", "SCHEMA_PRODUCT_MISSING_OFFERS"]),
    ({"@type": "Product", "name": "n", "image": ["i"], "offers": {"x": 0}}, ["SCHEMA_PRODUCT_OFFERS_MISSING_PRICE"]), ({"@type": "Product", "name": "n", "image": ["i"], "offers": [{"price": 1, "priceCurrency": "EUR"}, {"price": 2}, {}]}, ["SCHEMA_PRODUCT_OFFERS_MISSING_CURRENCY"]),
    ({"@type": "FAQPage", "mainEntity": []}, ["SCHEMA_FAQ_NO_QUESTIONS"]), ({"@type": "FAQPage", "mainEntity": [{"name": "q"}]}, ["SCHEMA_FAQ_QUESTION_INCOMPLETE"]), ({"@type": "BreadcrumbList", "itemListElement": [{"position": 1, "name": "x"}]}, ["SCHEMA_BREADCRUMB_ITEM_INCOMPLETE"]),
    ({"@type": "LocalBusiness", "name": "n", "url": "u", "logo": "l", "address": {"a": 1}}, ["SCHEMA_LOCALBUSINESS_MISSING_TELEPHONE"]), ({"@type": "Organization", "name": " "}, ["SCHEMA_ORG_MISSING_NAME", "SCHEMA_ORG_MISSING_URL", "SCHEMA_ORG_MISSING_LOGO"]), ({"@type": "Thing"}, []),
])
def test_structured_data(node, codes):
    assert P.ld_issues([node]) == codes


def test_ld_nodes():
    assert [P.ld_types(n) for n in P.ld_nodes('[{"@type":"A"},{"@graph":{"@type":["B","C"]}}]')] == [["A"], ["B", "C"]] and P.ld_nodes("{bad") == [] and P.ld_nodes(None) == []


def test_quotas():
    assert bucket_quotas([("a", 10), ("b", 3), ("c", 1)], 2) == {"a": 1, "b": 1} and bucket_quotas([("a", 10), ("b", 3), ("c", 1)], 8) == {"a": 5, "b": 2, "c": 1} and sum(bucket_quotas([("a", 5), ("b", 5), ("c", 5)], 8).values()) == 8


def test_minhash():
    words = shingle_words("The, QUICK brown; fox é a 12 under_score")
    assert words == ["the", "quick", "brown", "fox", "12", "under", "score"]
    a, b = [f"s{i}" for i in range(200)], [f"s{i}" for i in range(20, 200)]
    for mode in ("fast", "parity"):
        x, y = signature(a, mode=mode), signature(b, mode=mode)
        assert len(x) == 128 and signature(a, mode=mode) == x and abs(sum(p == q for p, q in zip(x, y)) / 128 - 0.9) < 0.1


def test_formats():
    assert detect_format(['1 - - [x] "GET / HTTP/1.1" 200 1 "-" "u"']) == "combined" and detect_format(['{"client_ip":1,"fastly_id":2}']) == "fastly" and detect_format(['{"EdgeStartTimestamp":1}']) == "cloudflare"
    assert detect_format(['{"a":1}', "[1]"]) == "json" and detect_format([]) == detect_format(["x"]) == detect_format(["", " "]) == "unknown"


def test_fetching():
    site = {"http://h/a": (301, {"location": "/b"}, ""), "http://h/b": (302, {"location": "http://h/c/"}, ""), "http://h/c": (200, {"content-type": "text/html"}, "ok"), "http://h/l": (301, {"location": "/l"}, "")}
    calls = []

    def fetch(url, timeout, agent):
        calls.append(url)
        if url == "http://h/busy":
            return (503, {}, "") if calls.count(url) < 3 else (200, {}, "late")
        if url == "http://h/odd":
            return 501, {}, "odd"
        return site[url]

    got = fetch_page("http://h/a", fetch, pause=lambda s: None)
    assert (got["final_url"], got["status"], len(got["redirect_chain"]), got["html"]) == ("http://h/c", 200, 2, "ok")
    assert fetch_page("http://h/busy", fetch, pause=lambda s: None)["html"] == "late"
    assert fetch_page("http://h/odd", fetch, pause=lambda s: None)["status"] == 501 and calls.count("http://h/odd") == 1
    assert fetch_page("http://h/l", fetch, pause=lambda s: None)["status"] == 0 and fetch_page("http://h/none", fetch, pause=lambda s: None)["status"] == 0


def test_stamps():
    assert free_stamp("2026-01-01T00:00:00.000Z", {"2026-01-01T00:00:00.000Z"}) == "2026-01-01T00:00:00.001Z"
    assert stamp_of(file_stamp("2026-04-27T01:02:07.897Z")) == "2026-04-27T01:02:07.897Z"


def test_readiness():
    robots = "User-agent: GPTBot\nDisallow: /\nUser-agent: ClaudeBot\nDisallow: /private\nContent-Signal: search=yes"
    assert agents.bot_policies(robots)["GPTBot"] == "blocked" and agents.bot_policies(robots)["ClaudeBot"] == "allowed" and agents.bot_policies(None)["CCBot"] == "unspecified"
    cover = {"article_like": 4, "article_with_schema": 2, "home_crawled": True, "home_has_organization": False}
    got = agents.readiness(robots, "# T\n## S\n[a](b)", cover, {"api-catalog": True, "web-bot-auth": True})
    assert (got["discoverability"], got["content"], got["bot_access"], got["capabilities"], got["total"]) == (85, 60, 30, 23, 50)
    assert [c for c, _ in got["issues"]] == ["AGENT_LLMSTXT_TOO_SMALL", "AGENT_HOMEPAGE_NO_ORG"]
