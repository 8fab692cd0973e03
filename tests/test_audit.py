import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.operators import agents, components, diff, enrichment, keywords, linkgraph, logs, neardup, rules, sampling, sitewide
from siteloom.plans.audit import analyze_logs, audit, scan_directory
from siteloom.plans.render import diff_text, log_html, log_json, log_text, to_html, to_json, to_text, write_json
from siteloom.sources import crawls
from siteloom.streaming import logs as streams

S = "https://s.example"


def captures(spark, site, headers=None):
    rows = [(f"{S}{p}", f"{S}{p}", 200, "text/html", headers or {}, [], html, i) for i, (p, html) in enumerate(site.items())]
    return spark.createDataFrame(rows, crawls.FETCHES)


def page(title, links=(), body="word " * 5, extra=""):
    return f"<html lang=en><head><title>{title}</title>{extra}</head><body><h1>x</h1><p>{body}</p>{''.join(f'<a href={x}>to {x}</a> ' for x in links)}</body></html>"


@pytest.fixture(scope="module")
def report(spark):
    words = " ".join(f"word{i}" for i in range(60))
    site = {"/": page("Home of the tested site", ["/a", "/b", "/gone"]), "/a": page("Same title on two pages", ["/"], words, '<link rel=canonical href="https://other.example/">'), "/b": page("same  TITLE on two pages", ["/a"], words), "/c": page(None, [], ""), "/d": None}
    fetches = captures(spark, site, {"Content-Type": "text/html", "X-Robots-Tag": "noindex, bot: nofollow", "Link": "</b>; rel=canonical", "Cache-Control": "no-store, no-cache, max-age=0", "content-encoding": "gzip"})
    gone = spark.createDataFrame([(f"{S}/gone", f"{S}/gone", 404, "text/html", {}, [], "", 9), (f"{S}/f.pdf", f"{S}/f.pdf", 200, "application/pdf", None, None, None, 10), (f"{S}/dead", f"{S}/dead", 0, None, None, None, None, 11)], crawls.FETCHES)
    gsc = spark.createDataFrame([(S + "/a/?utm_source=q", 1, 50, 0.1, 2.0)], "url string, clicks long, impressions long, ctr double, position double")
    stages = []
    out = audit(fetches.unionByName(gone), S + "/", spark.createDataFrame([(S + "/a",), (S + "/c",)], "url string"), "User-agent: *\nDisallow: /b", keyword_list=["word1", "zzz"], top_terms=3, extract={"h": "h1", "q": {"selector": ".q", "required": True}}, gsc=gsc, on_progress=stages.append)
    assert stages[0] == "parse" and stages[-1] == "done"
    return out


def test_audit_issues(report):
    got = {}
    for r in report.issues.collect():
        got.setdefault(r.final_url.removeprefix(S), set()).add(r.code)
    assert got["/gone"] == {"HTTP_ERROR"} and got["/f.pdf"] == {"NON_HTML_CONTENT"} and got["/dead"] == {"FETCH_FAILED"}
    assert {"INTERNAL_LINK_BROKEN", "HEADER_X_ROBOTS_NOINDEX", "HEADER_LINK_CANONICAL_MULTIPLE"} & got["/"] == {"INTERNAL_LINK_BROKEN", "HEADER_X_ROBOTS_NOINDEX"} and "HEADER_X_ROBOTS_NOFOLLOW" not in got["/"]
    assert {"CANONICAL_CROSS_HOST", "SITEMAP_CANONICAL_MISMATCH", "TITLE_DUPLICATE_SITEWIDE", "CONTENT_NEAR_DUPLICATE", "HEADER_LINK_CANONICAL_HTML_MISMATCH", "EXTRACTION_MISSING_REQUIRED"} <= got["/a"]
    assert {"ROBOTS_DISALLOWS_URL", "SITEMAP_URL_MISSING", "INTERNAL_LINK_INCOMING_FEW", "HEADER_CACHE_CONTROL_AGGRESSIVE_NOCACHE", "HEADER_VARY_ACCEPT_ENCODING_MISSING", "HEADER_HSTS_MISSING"} <= got["/b"]
    assert {"ORPHAN_CANDIDATE", "LOW_WORD_COUNT"} <= got["/c"] and "TITLE_MISSING" in got["/d"]


def test_audit_parts(report):
    s = report.summary.first()
    assert s.crawled_pages == 8 and s.pages_broken_links == 1 and s.orphan_candidates == 2
    assert {(r.keyword, r.pages, r.total) for r in report.parts["keywords"].collect()} == {("zzz", 0, 0), ("word1", 2, 22)}
    assert {(r.field, r.pages_matched) for r in report.parts["extractions"].collect()} == {("h", 4), ("q", 0)}
    assert {r.url for r in report.parts["priorities"].collect()} == {S + "/a"}
    assert report.parts["link_ranks"].agg(F.sum("page_rank")).first()[0] == pytest.approx(1)
    data = json.loads(to_json(report))
    assert data["summary"]["crawled_pages"] == 8 and "KEYWORDS" in to_text(report) and "<table>" in to_html(report, "a<b") and "a&lt;b" in to_html(report, "a<b")


def test_pagerank_shapes(spark):
    def rank(n, edges):
        v = spark.range(n).select("id")
        return [r.rank for r in linkgraph.pagerank(v, spark.createDataFrame(edges, "src long, dst long")).orderBy("id").collect()]

    assert rank(4, [(0, 1), (1, 2), (2, 3), (3, 0)]) == pytest.approx([0.25] * 4)
    leaves = rank(4, [(0, 1), (0, 2), (0, 3)])
    assert leaves[1] == pytest.approx(leaves[2]) and leaves[1] > leaves[0] and sum(leaves) == pytest.approx(1)
    assert rank(1, []) == [1.0] and rank(0, []) == []


def test_components_of_a_long_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[200] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "u1", base), (2, "u2", base), (3, "u3", base + " extra words at the very end"), (4, "u4", " ".join(f"other{i}" for i in range(60))), (5, "u5", None), (6, "u6", " ".join(f"word{i}" for i in range(49))), (7, "u7", "")]
    got = {r.page_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "page_id long, final_url string, body_text string")).collect()}
    assert set(got) == {1, 2, 3} and {r.representative_url for r in got.values()} == {"u3"} and got[3].similarity == 1.0


def test_traffic_and_properties(spark):
    traffic = spark.createDataFrame([("https://s.example/a/", 5, 9, None, 1.0), ("https://s.example/b", 1, 1, 0.5, 1.0), (None, 1, 1, 1.0, 1.0)], "url string, clicks long, impressions long, ctr double, position double")
    pages = spark.createDataFrame([("https://S.example/a",), ("https://s.example/b?utm_source=1",), ("https://s.example/c",)], "final_url string")
    got = {r.final_url: r.metrics.gsc for r in enrichment.with_traffic(pages, gsc=traffic).collect()}
    assert got["https://S.example/a"].impressions == 9 and got["https://S.example/a"].ctr == 0 and got["https://s.example/b?utm_source=1"].clicks == 1 and got["https://s.example/c"] is None
    assert tuple(enrichment.match_counts(pages, traffic).first()) == (2, 3, 1)
    props = spark.createDataFrame([("sc-domain:s.example", "siteOwner"), ("https://s.example/", "siteUnverifiedUser"), ("https://t.example/", "siteOwner")], "site_url string, permission string")
    assert enrichment.best_property(props, "https://www.s.example").first().site_url == "sc-domain:s.example"
    streams_ = spark.createDataFrame([("p1", "https://www.s.example"), ("p2", "https://s.example/x"), ("p3", "https://q.example")], "property string, default_uri string")
    assert [enrichment.matching_streams(streams_, o).first().state for o in ("https://s.example", "https://q.example", "https://n.example")] == ["ambiguous", "ok", "none"]


def test_sampling_covers_buckets(spark):
    urls = [f"{S}/en/blog/{i:03}" for i in range(90)] + [f"{S}/docs/{i}" for i in range(9)] + [f"{S}/", None]
    df = spark.createDataFrame([(u,) for u in urls + urls[:5]], "url string")
    got = sampling.sampled_urls(df, 20).collect()
    assert len(got) == 20 and {r.bucket for r in got} == {"en/blog", "docs", "/"} and sampling.sampled_urls(df, 500).count() == 100


def test_diff_and_gate(spark):
    schema = "final_url string, status int, crawl_order int, issues array<struct<code:string>>"
    old = spark.createDataFrame([("a", 200, 1, [("X",), ("Y",)]), ("b", 200, 2, [("Y",)]), ("c", None, 3, None)], schema)
    new = spark.createDataFrame([("a", 404, 1, [("X",), ("Z",)]), ("c", 200, 2, []), ("d", 200, 3, [("X",)])], schema)
    parts = diff.diff_reports(old, new)
    assert {tuple(r) for r in parts["pages"].collect()} == {("d", "added"), ("b", "removed")}
    assert {(r.code, r.change) for r in parts["issues"].collect()} == {("X", "increased"), ("Y", "resolved"), ("Z", "new")}
    assert {tuple(r) for r in parts["status"].collect()} == {("a", 200, 404), ("c", None, 200)} and parts["common"].count() == 2
    assert all(d.count() == 0 for k, d in diff.diff_reports(old, old).items() if k in ("pages", "status"))
    assert diff.evaluate_fail_on({"high": 1}, "high").should_fail and not diff.evaluate_fail_on({"high": -1}, "high").should_fail and not diff.evaluate_fail_on(None, "low").should_fail
    assert "PAGES" in diff_text(parts)


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("https://www.S.example:8080/", "https://s/a", 200, ["X"], (1, 0, 0))], "start_url string, page_url string, status int, codes array<string>, totals struct<high:int,medium:int,low:int>")
    assert crawls.load_history(spark, path).count() == 0
    first, second = (crawls.persist_crawl(rows, path, "2026-01-01T00:00:00.000Z") for _ in range(2))
    assert first == {"host": "s.example_8080", "crawled_at": "2026-01-01T00:00:00.000Z", "previous": None} and second["previous"] == first["crawled_at"] != second["crawled_at"]
    assert [r.crawled_at for r in crawls.list_crawls(spark, path).collect()] == [second["crawled_at"], first["crawled_at"]]
    assert crawls.recent_crawls(crawls.load_history(spark, path), 1).count() == 1


LOG = [
    '66.249.66.1 - - [25/Apr/2026:10:15:23 +0000] "GET /orphan HTTP/1.1" 200 5 "-" "Mozilla Googlebot/2.1"', '66.249.66.1 - - [25/Apr/2026:11:45:23 +0000] "GET /broken HTTP/1.1" 503 5 "-" "Googlebot"', '9.9.9.9 - - [25/Apr/2026:11:45:23 +0000] "GET /fake HTTP/1.1" 200 5 "-" "Googlebot"',
    '5.5.5.5 - - [25/Apr/2026:12:00:00 +0000] "GET /index.html HTTP/1.1" 200 5 "-" "GPTBot/1"', '1.1.1.1 - - [25/Apr/2026:12:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "Firefox"', "garbage",
]


def test_log_analysis(spark):
    lines = spark.createDataFrame([(x,) for x in LOG[:5]], "value string")
    crawl = spark.createDataFrame([(S + "/broken", S + "/broken", 200, 1), (S + "/x", S + "/index.html", 200, 2)], "url string, final_url string, status int, crawl_order int")
    dns = spark.createDataFrame([("66.249.66.1", ["crawl-1.GoogleBot.com"], ["66.249.66.1"]), ("9.9.9.9", ["host.evil.example"], ["9.9.9.9"])], "ip string, ptr array<string>, forward array<string>")
    ranks = crawl.select("url", F.lit(0.5).alias("page_rank"), "crawl_order")
    r = analyze_logs(lines, S, crawl=crawl, ranks=ranks, dns=dns, crawled_at="2026-01-01")
    assert r.layout == "combined" and {(b.bot, b.hits) for b in r.bots.collect()} == {("googlebot", 2), ("gptbot", 1)}
    assert [o.url for o in r.orphans.collect()] == [S + "/orphan"] and [(m.url, m.worst_status, m.hits) for m in r.mismatches.collect()] == [(S + "/broken", 503, 1)]
    assert [x.url for x in r.stale.collect()] == [S + "/x"] and r.issues == [("LOG_BASELINE_STALE", "low")] and r.window.first().duration_hours == 2
    assert {x.code for x in logs.log_issues(r).collect()} == {"LOG_ORPHAN_PAGE", "LOG_STATUS_MISMATCH", "LOG_STALE_PRIORITY_PAGE"}
    assert tuple(r.verdicts.first()) == (1, 0) and json.loads(log_json(r))["summary"]["spoofed_hits"] == 1 and "BOTS" in log_text(r) and "<table>" in log_html(r)
    assert logs.fails(r.issues, "low") and not logs.fails(r.issues, "medium") and not logs.fails(r.issues, None)
    assert analyze_logs(lines, S, "combined").issues == []
    late = analyze_logs(lines, S, "combined", since="2026-04-25T11:00:00Z", until="2026-04-25T12:00:00Z", verify=True)
    assert late.bots.collect()[0].hits == 2 and late.orphans is None and ("LOG_DNS_UNAVAILABLE", "low") in late.issues
    with pytest.raises(ValueError):
        analyze_logs(spark.createDataFrame([("garbage",)], "value string"), S)


def test_json_layouts(spark):
    raw = ['{"ip":"1","timestamp":"t","method":"GET","url":"/a","status":"200x","userAgent":5}', "[1]", "null", "{", '{"ip":1}']
    got = logs.parse_lines(spark.createDataFrame([(x,) for x in raw], "value string"), "json").collect()
    assert [tuple(r) for r in got] == [("1", "t", "GET", "/a", 200, ""), ("", "", "", "", None, "")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LOG))
    hits = streams.stream_bot_hits(streams.stream_lines(spark, str(tmp_path / "in"), 1), "combined", S)
    streams.write_hits(hits, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert logs.bot_aggregates(spark.read.parquet(str(tmp_path / "out"))).count() == 2
    q = streams.windowed_hits(hits, "1 hour").writeStream.format("memory").queryName("wh").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.bot, r.hits) for r in spark.table("wh").collect()} == {("googlebot", 1), ("googlebot", 2), ("gptbot", 1)}


def test_crawl_replay(spark):
    site = {"/": page("t", ["/a", "/skip/x", "/i.png"]), "/a": page("t", ["/b", "/"]), "/b": page("t", ["/c"]), "/c": page("t")}
    corpus = captures(spark, site).drop("crawl_order")
    from siteloom.operators.features import parsed_pages

    links = lambda got: parsed_pages(got).select(F.explode("facts.anchors.url").alias("url"))
    got = crawls.crawl(spark, [S], lambda frontier: corpus.join(frontier, "url"), links, max_pages=3, exclude=["^/skip"])
    assert [r.url for r in got.orderBy("crawl_order").collect()] == [S + "/", S + "/a", S + "/b"]


def test_sitemap_seeds(spark):
    files = spark.createDataFrame([("r", "<sitemapindex><sitemap><loc>s1</loc></sitemap></sitemapindex>"), ("s1", "<urlset><url><loc>https://s.example/a/</loc><lastmod>2020-01-01</lastmod></url><url><loc>bad</loc></url></urlset>")], "url string, xml string")
    urls, limited = crawls.sitemap_seeds(files, ["r"])
    assert [r.url for r in urls.collect()] == ["https://s.example/a"] and not limited
    assert [tuple(r) for r in crawls.sitemap_table(files).collect()] == [("s1", "https://s.example/a/", "2020-01-01"), ("s1", "bad", None)]


def test_directory_and_keywords(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "index.HTML").write_text(page("Alpha beta", body="alpha alpha"))
    (tmp_path / "x.htm").write_text(page("Gamma", extra='<link rel="canonical" href="https://k.example/x">'))
    (tmp_path / "no.txt").write_text("alpha")
    (tmp_path / "kw").write_text("# c\nalpha\n\n beta \nalpha\nc# guide\n")
    words = crawls.keyword_file(spark, str(tmp_path / "kw"))
    r = scan_directory(spark, str(tmp_path), words[:2], 2)
    assert words == ["alpha", "beta", "c# guide"] and {x.final_url for x in r.pages.collect()} == {"/sub/", "https://k.example/x"}
    assert {(k.keyword, k.total) for k in r.parts["keywords"].collect()} == {("alpha", 3), ("beta", 1)}


def test_infrastructure_and_vitals(spark):
    site = spark.createDataFrame([("a", 200, True, [], 404, ["2020-01-01", "x"], 200, " "), ("b", None, None, None, None, [], None, None)], "site string, robots_status int, robots_blocks_all boolean, robots_sitemaps array<string>, sitemap_status int, lastmods array<string>, llms_status int, llms_text string")
    got = {}
    for r in rules.infrastructure_issues(site, "2026-01-01").collect():
        got.setdefault(r.site, set()).add(r.code)
    assert got == {"a": {"ROBOTS_BLOCKS_ALL", "ROBOTS_NO_SITEMAP", "SITEMAP_MISSING", "SITEMAP_LASTMOD_STALE", "LLMSTXT_EMPTY"}, "b": {"ROBOTS_UNREACHABLE", "SITEMAP_UNREACHABLE", "LLMSTXT_UNREACHABLE"}}
    crux = '{"record":{"metrics":{"largest_contentful_paint":{"percentiles":{"p75":2600}},"interaction_to_next_paint":{"percentiles":{"p75":501}},"cumulative_layout_shift":{"percentiles":{"p75":"0.05"}}}}}'
    rows = spark.createDataFrame([(crux,), ("{bad",), (None,)], "raw_json string")
    assert [r.codes for r in rules.web_vitals(rows).collect()] == [["CRUX_LCP_NEEDS_IMPROVEMENT", "CRUX_INP_POOR"], [], []]
    speed = spark.createDataFrame([('{"categories":{"performance":{"score":0.955}},"audits":{"speed-index":{"numericValue":1234.567}}}',)], "raw_json string")
    assert (lambda r: (r.performance, r.seo, r.speed_index))(rules.speed_reports(speed).first()) == (96, None, 1234.57)


def test_no_pages(spark):
    empty = audit(spark.createDataFrame([], crawls.FETCHES))
    assert empty.issues.count() == 0 and empty.pages.count() == 0


def test_query_names(spark):
    from siteloom.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and {"p5_found", "p6_found", "p7_found"} <= set(QUERIES)
    assert isinstance(dt.datetime.now(), dt.datetime)


def test_groups_list_every_url(spark):
    urls = [f"{S}/{i:04}" for i in range(1050)]
    schema = "final_url string, crawl_order int, title string, meta_description string, h1s array<string>, body_text string, issues array<struct<code:string,severity:string,message:string,recommendation:string>>"
    pages = spark.createDataFrame([(u, i, "Same", None, [], "", [("X", "low", "m", "")]) for i, u in enumerate(urls)], schema)
    issues = sitewide.page_issues(pages)
    group, code, word = sitewide.duplicate_groups(pages, "title").first(), sitewide.issue_catalog(issues).first(), keywords.keyword_summary(pages, ["same"]).first()
    assert group["count"] == code["count"] == code.n_urls == word.pages == 1050
    for rows in (sitewide.duplicate_members(pages, "title"), sitewide.issue_urls(issues), keywords.keyword_urls(pages, ["same"])):
        assert sorted(r.final_url for r in rows.collect()) == urls


def test_site_files_field_data_and_agents_count(spark, tmp_path):
    files = {"robots.txt": (200, "User-agent: *\nDisallow: /\n"), "sitemap.xml": (404, ""), "llms.txt": (None, "")}
    site = crawls.site_row(spark, S, files)
    vitals = spark.createDataFrame([(S, None)], "site string, raw_json string")
    probes = agents.probe_site(S + "/", lambda url, method, headers: (200, {"Content-Type": "text/markdown", "Link": '</x>; rel="api describedby"'}, "") if url == S + "/" else (404, {}, ""))
    assert probes["link_rels"] == ["api", "describedby"] and probes["probes"]["markdown"] and not probes["probes"]["api-catalog"] and probes["statuses"]["api-catalog"] == 404
    out = audit(captures(spark, {"/": page("Home of the tested site")}), S + "/", robots_txt=files["robots.txt"][1], site=site, now="2026-01-01", field_data=vitals, agent_probes=probes, content_dedup=False, link_graph=False)
    own = {r.code for r in out.parts["site_issues"].collect()}
    assert own == {"ROBOTS_BLOCKS_ALL", "ROBOTS_NO_SITEMAP", "SITEMAP_MISSING", "LLMSTXT_UNREACHABLE", "CRUX_QUERY_FAILED", "AGENT_NO_EXPLICIT_AI_POLICY", "AGENT_HOMEPAGE_NO_ORG"}
    s = out.summary.first()
    assert s.issues_high + s.issues_medium + s.issues_low == out.issues.count() + len(own)
    write_json(out, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "site_issues")).count() == len(own)
    missing = rules.field_data_issues(None, vitals.select("site"), key_given=False).collect()
    assert [(r.code, r.severity) for r in missing] == [("CRUX_API_KEY_MISSING", "medium")]


def test_near_duplicates_of_a_hot_band(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 30, 128)
    sigs = []
    for k in range(6):  # six clusters that share one band, so it is hot
        centre = rng.integers(0, 1 << 30, 128)
        centre[:8] = base[:8]
        for _ in range(15):
            one = centre.copy()
            at = rng.choice(np.arange(8, 128), 8, replace=False)
            one[at] = rng.integers(0, 1 << 30, 8)
            sigs.append((k, one))
    df = spark.createDataFrame([(i, s.tolist()) for i, (_, s) in enumerate(sigs)], "sid long, sig array<long>")
    pairs = neardup.similar_signatures(df)
    assert {sigs[r.a][0] == sigs[r.b][0] for r in pairs.collect()} == {True}
    comp = {r.id: r.component for r in components.connected_components(pairs.select("a", "b")).collect()}
    assert len(comp) == len(sigs) and len({(sigs[i][0], c) for i, c in comp.items()}) == 6


def test_median_and_numbers(spark):
    values = [float(i % 37) for i in range(1001)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert linkgraph.exact_median(rows, "x") == np.median([v for v in values if v is not None]) and linkgraph.exact_median(rows.limit(0), "x") is None
    assert linkgraph.exact_median(spark.createDataFrame([(1.0,), (2.0,)], "x double"), "x") == 1.5
    urls = [f"{S}/{i % 7}/{i:03}" for i in range(90)]
    got = crawls.numbered(spark.createDataFrame([(i % 2, u) for i, u in enumerate(urls)], "g int, u string"), ["g"], "u", "n", head=22).orderBy("n").collect()
    assert [r.n for r in got] == list(range(90)) and [(r.g, r.u) for r in got] == sorted((i % 2, u) for i, u in enumerate(urls))


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_page_url_of_a_file(spark, tmp_path):
    (tmp_path / "a.html").write_text('<base href="https://b.example/"><meta property="og:url" content="https://b.example/og">')
    (tmp_path / "b.html").write_text('<base href="https://b.example/x">')
    (tmp_path / "c.html").write_text('<meta property="og:url" content="https://b.example/og"><link href=" https://c.example/c " rel="canonical">')
    (tmp_path / "d.html").write_text('<meta property="og:url" content="https://b.example/og"><link rel="canonical" href="/rel">')
    assert sorted(r.url for r in crawls.html_folder(spark, str(tmp_path)).collect()) == ["/d.html", "https://b.example/og", "https://b.example/x", "https://c.example/c"]


def test_nested_sitemaps_keep_their_order(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>s{i}</loc></sitemap>" for i in range(60)) + "</sitemapindex>"
    files = spark.createDataFrame([("r", index)] + [(f"s{i}", f"<urlset><url><loc>https://s.example/{i}</loc></url></urlset>") for i in range(60)], "url string, xml string")
    urls, limited = crawls.sitemap_seeds(files, ["r"], max_files=5)
    assert sorted(r.url for r in urls.collect()) == [f"https://s.example/{i}" for i in range(4)] and limited
    everything, limited = crawls.sitemap_seeds(files, ["r"], max_files=61)
    assert everything.count() == 60 and not limited
