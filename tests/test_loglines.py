import json

from siteloom.functions.loglayout import LineParser, TemplateTree, head_tokens, member, mined_plans, template_plan
from siteloom.operators.loglines import log_entries, log_templates

A = '192.0.2.1 - - [15/Oct/2025:00:49:31 +0000] "GET /a?x=1 HTTP/1.1" 200 60749 "https://h/t" "UA (x; y)"'
LINES = {
    A: ("15/Oct/2025:00:49:31 +0000", "", "", "/a?x=1", 200, "UA (x; y)"),
    '2001:db8::1 - editor [15/Oct/2025:00:49:31 +0000] "GET /a and more HTTP/2.0" 404 - "-" "-"': ("15/Oct/2025:00:49:31 +0000", "", "", "/a and more", 404, ""),
    '192.0.2.58 - - [15/Oct/2025:01:01:37 +0000] "-" 408 0 "-" "-"': ("15/Oct/2025:01:01:37 +0000", "", "", "", 408, ""),
    '{"client_ip":"1","timestamp":"2026-01-19T01:59:38Z","url":"\\/deep","status":"301","user_agent":"A\\/1"}': ("2026-01-19T01:59:38Z", "", "", "/deep", 301, "A/1"),
    '{"level": 40, "time": 1774094468713, "name": "robots", "msg": "x", "req": {"url": "/b", "userAgent": "-"}, "res": {"status": 200}}': ("1774094468713", "WARN", "robots", "/b", 200, ""),
    "2025-11-07 16:29:25|WARN|audit.rules|-|-|This stale": ("2025-11-07 16:29:25", "WARN", "audit.rules", "", -1, ""),
    "1768788026951|F|http/client|/q?p=1|503|INFO: x": ("1768788026951", "FATAL", "http/client", "/q?p=1", 503, ""),
    "Oct 5, 2025 5:25:09 AM|20|gsc_import|-|-|The": ("Oct 5, 2025 5:25:09 AM", "DEBUG", "gsc_import", "", -1, ""),
    '2025-10-14T16:50:50.112 40    [report.pdf] That url=/a/c and more status=200 ua="M (a; b)"': ("2025-10-14T16:50:50.112", "WARN", "report.pdf", "/a/c and more", 200, "M (a; b)"),
    "2026-03-20T22:55:07+05:30 NOTICE [dns] The [ERROR count 2]": ("2026-03-20T22:55:07+05:30", "INFO", "dns", "", -1, ""),
    "2026-03-20 17:53:33 [worker-9] warning crawler.queue - Each": ("2026-03-20 17:53:33", "WARN", "crawler.queue", "", -1, ""),
    "[2025-12-04T20:21:25+00:00] dns.CRITICAL: We until 2026-01-14T01:15:00Z": ("2025-12-04T20:21:25+00:00", "FATAL", "dns", "", -1, ""),
    "[Wed Nov 19 03:39:54 2025] [http/client:info] [pid 5131] We": ("Wed Nov 19 03:39:54 2025", "INFO", "http/client", "", -1, ""),
    "E0121 09:37:23.770309 50057 crawler.fetch:522] When": ("0121 09:37:23.770309", "ERROR", "crawler.fetch", "", -1, ""),
    'ts="2025-10-19 18:24:36" level=ERR component=a-b msg="x y" url=/t status=200 ua="U 1"': ("2025-10-19 18:24:36", "ERROR", "a-b", "/t", 200, "U 1"),
    'level=I ts=1775212059.564 msg="One" component=x': ("1775212059.564", "INFO", "x", "", -1, ""),
    "<132>1 2026-04-14T19:13:36.862Z node9 sitemap 9423 - - We": ("2026-04-14T19:13:36.862Z", "WARN", "sitemap", "", -1, ""),
    "<30>Mar  2 13:23:58 node10 robots[1090]: When": ("Mar  2 13:23:58", "INFO", "robots", "", -1, ""),
}
NO_HEADS = ["", "   ", "Traceback (most recent call last):", "\tat a.b.C(D.java:1)", "> GET /x HTTP/1.1", "< HTTP/1.1 503", "<", "SELECT url, status", "WHERE status = 500", "}", "  },", "#011at x", "ValueError: 5", "Caused by: x: closed", "{broken json", "🙂" * 40, "2025"]


def test_layouts():
    p = LineParser()
    assert {k: p.fields(k) for k in LINES} == LINES
    assert [p.fields(x) for x in NO_HEADS] == [None] * len(NO_HEADS)
    assert p.fields("x" * 200_000) is None


def test_member():
    assert member('  "severity": "critical",') == ("severity", "critical")
    assert member('    "status": 200') == ("status", "200")
    assert member('  "req": {') is None and member("  x") is None


def test_tree_merges_similar_heads():
    tree = TemplateTree()
    for line in ("2025-11-07 16:29:25|WARN|audit|-|-|a", "2025-11-07 16:29:25|INFO|audit|-|-|b", "2025-11-07 16:29:25|INFO|audit|/x|200|b"):
        tree.add(tuple(t[0] for t in head_tokens(line)), 1, line)
    assert sum(n for _, n, _ in tree.templates()) == 3 and len(list(tree.templates())) <= 2


def entries(spark, rows, **options):
    df = spark.createDataFrame(rows, "line_id long, host string, log_file string, line_no int, raw string, block string, head int, kind string")
    return {(r.log_file, r.line_no): tuple(r)[2:] for r in log_entries(df, **options).collect()}


def test_entries(spark):
    pretty = json.dumps({"@timestamp": "2026-03-25T01:07:40Z", "severity": "critical", "logger": "q", "message": '"url": "no"', "req": {"url": "/u", "userAgent": "A\"B"}, "res": {"status": 200}}, indent=2).split("\n")
    file = ["  at tail of another file", "}", A, "", "=== new session ===", "2025-11-07 16:29:25|WARN|r|-|-|x", "  at a", None, "Traceback (most recent call last):", *pretty, "-------- log rotated --------", "  late", A]
    rows = [(i, "h", "f", i + 1, raw, "b", 1, "k") for i, raw in enumerate(file)]
    rows += rows[2:9] + [(99, "h", None, 1, A, None, None, None), (98, "h", "g", None, A, None, None, None), (97, "h", "only", 3, "  tail", None, None, None)]
    n = len(pretty)
    expected = {
        ("f", 3): (1, *LINES[A]), ("f", 6): (3, "2025-11-07 16:29:25", "WARN", "r", "", -1, ""),
        ("f", 10): (n + 1, "2026-03-25T01:07:40Z", "FATAL", "q", "/u", 200, 'A"B'), ("f", 12 + n): (1, *LINES[A]),
    }
    assert entries(spark, rows) == expected
    assert entries(spark, rows, block_lines=2) == expected
    assert entries(spark, []) == {}


def test_templates(spark):
    df = spark.createDataFrame([(k,) for k in LINES] * 3 + [(None,), ("  x",)], "raw string")
    got = log_templates(df).collect()
    assert sum(r.n_lines for r in got) == 3 * len(LINES)


def test_entries_of_unlisted_layouts_take_the_plan_of_their_template(spark):
    file = [
        "2025-11-07 16:29:25,100 - crawl.queue - ERROR - first", "  at a", "2025-11-07 16:29:26,100 - crawl.fetch - AUDIT - second url=/x status=404", "2025-11-07 16:29:27,100 - dns - INFO - third",
        "Mar  2 13:23:58 node10 robots[1090]: When error", "plain text goes on", "Mar  2 13:23:59 node10 audit[7]: error at once", "Mar  2 13:24:00 node11 audit[8]: One more",
        "WARN 2025-11-07 16:29:25 [rules] stale", "until 2025-11-07 16:29:25 it goes on", "1768788026951 rows",
    ]
    got = entries(spark, [(i, "h", "f", i + 1, raw, "b", 1, "k") for i, raw in enumerate(file)])
    expected = {
        ("f", 1): (2, "2025-11-07 16:29:25,100", "ERROR", "crawl.queue", "", -1, ""), ("f", 3): (1, "2025-11-07 16:29:26,100", "", "crawl.fetch", "/x", 404, ""), ("f", 4): (1, "2025-11-07 16:29:27,100", "INFO", "dns", "", -1, ""),
        ("f", 5): (2, "Mar  2 13:23:58", "", "robots", "", -1, ""), ("f", 7): (1, "Mar  2 13:23:59", "", "audit", "", -1, ""), ("f", 8): (1, "Mar  2 13:24:00", "", "audit", "", -1, ""),
        ("f", 9): (3, "2025-11-07 16:29:25", "WARN", "rules", "", -1, ""),
    }
    assert got == expected
    assert entries(spark, [(i, "h", "f", i + 1, raw, "b", 1, "k") for i, raw in enumerate(file)], block_lines=2) == expected


NEW_LAYOUTS = {
    "(2025-11-07T16:29:25Z) {fetcher} <INFO> rows of the queue were read": ("2025-11-07T16:29:25Z", "INFO", "fetcher", "", -1, ""),
    "(2025-11-07T16:29:26Z) {store.disk} <CRITICAL> no space was left url=/a status=507": ("2025-11-07T16:29:26Z", "FATAL", "store.disk", "/a", 507, ""),
    "2025-11-07 16:29:25 | WARN | crawl.queue | stale rows remain in it": ("2025-11-07 16:29:25", "WARN", "crawl.queue", "", -1, ""),
    "2025-11-07 16:29:27 | ERROR | dns | no answer came back": ("2025-11-07 16:29:27", "ERROR", "dns", "", -1, ""),
    "07/Nov/2025:16:29:25 +0000;E;web.pool;/x?a=1;502;the pool was empty again": ("07/Nov/2025:16:29:25 +0000", "ERROR", "web.pool", "/x?a=1", 502, ""),
    "INFO [2025-11-07 16:29:25] mail.sender: the letter was sent away": ("2025-11-07 16:29:25", "INFO", "mail.sender", "", -1, ""),
    "2025-11-07T16:29:25.001Z DEBUG (worker) the pool grew by 3": ("2025-11-07T16:29:25.001Z", "DEBUG", "worker", "", -1, ""),
    "Nov  7 16:29:25 gate7 sshd: session was opened for root": ("Nov  7 16:29:25", "", "sshd", "", -1, ""),
}


def test_layouts_that_no_pattern_names(spark):
    rows = [(i, "h", "f", i + 1, raw, "b", 1, "k") for i, raw in enumerate(NEW_LAYOUTS)]
    got = entries(spark, rows)
    assert {raw: got.get(("f", i + 1)) for i, raw in enumerate(NEW_LAYOUTS)} == {raw: (1, *v) for raw, v in NEW_LAYOUTS.items()}


def test_fields_come_from_the_template():
    # alone, the middle word is no level; among its template's heads the position is one
    heads = [("2025-11-07 16:29:2%d - q - %s - a b c" % (i, w)) for i, w in enumerate(("INFO", "WARN", "ERROR", "AUDIT"))]
    masks = [tuple(t[0] for t in head_tokens(h)) for h in heads]
    plans = mined_plans((m, 1) for m in masks)
    assert len({tuple(sorted(p.items())) for p in plans.values()}) == 1 and "l" in plans[masks[3]]
    assert "l" not in template_plan([(masks[3], 1)])


def test_token_counts_route():
    counts = {len(head_tokens(x)) for x in LINES}
    assert len(counts) >= 6 and max(counts) < 24
