"""Access logs: parsing, bot attribution, aggregates, and findings against a crawl.

All transformations work on batch and streaming DataFrames alike, except the top-k findings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import half_up
from siteloom.functions.url import normalize_url

COMBINED = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (.*?) HTTP/[\d.]+" (\d+) \S+ "[^"]*" "([^"]*)"$'
# Bots by user agent, the first that matches; host names of those that can be verified by DNS.
BOTS: tuple[tuple[str, str], ...] = (
    ("googlebot", "googlebot"), ("bingbot", "bingbot"), ("applebot", "applebot"), ("duckduckbot", "duckduckbot"), ("claudebot", "claudebot|claude-web"), ("gptbot", "gptbot"), ("perplexitybot", "perplexitybot"),
)
DNS_SUFFIXES: dict[str, tuple[str, ...]] = {"googlebot": (".googlebot.com", ".google.com"), "bingbot": (".search.msn.com",), "applebot": (".applebot.apple.com",), "duckduckbot": (".duckduckgo.com",)}
#: Names of the fields in each JSON layout: ip, timestamp, method, url, status, user agent.
LAYOUTS: dict[str, tuple[str, ...]] = {
    "json": ("ip", "timestamp", "method", "url", "status", "userAgent"),
    "cloudflare": ("ClientIP", "EdgeStartTimestamp", "ClientRequestMethod", "ClientRequestURI", "EdgeResponseStatus", "ClientRequestUserAgent"),
    "fastly": ("client_ip", "timestamp", "request_method", "url", "status", "user_agent"),
}
FIELDS = ("ip", "timestamp", "method", "url", "status", "user_agent")
ORPHAN_CAP = MISMATCH_CAP = 200
STALE_DAYS, STALE_TOP = 30, 100


def detect_format(sample: Sequence[str]) -> str:
    """combined, json, cloudflare, fastly or unknown, from up to five lines: combined if every line is, else by the keys of the first three."""
    lines = [x for x in sample[:5] if x.strip()]
    if not lines:
        return "unknown"
    if all(re.match(COMBINED, x) for x in lines):
        return "combined"
    objects = []
    for x in lines[:3]:
        try:
            objects.append(json.loads(x))
        except ValueError:
            return "unknown"
    if not all(isinstance(o, (dict, list)) for o in objects):
        return "unknown"
    keys = objects[0] if isinstance(objects[0], dict) else {}
    if "EdgeStartTimestamp" in keys or "ClientRequestUserAgent" in keys:
        return "cloudflare"
    return "fastly" if "client_ip" in keys and "fastly_id" in keys else "json"


def clf_to_iso(stamp: Column) -> Column:
    """A bracketed stamp as ISO 8601 with its own offset; null if it is none."""
    pattern = r"^(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2}) ([+-]\d{2})(\d{2})$"
    p = lambda i: F.regexp_extract(stamp, pattern, i)
    at = F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), p(2))
    month = F.lpad(((at - 1) / 3 + 1).cast("int").cast("string"), 2, "0")
    iso = F.concat(p(3), F.lit("-"), month, F.lit("-"), p(1), F.lit("T"), p(4), F.lit(":"), p(5), F.lit(":"), p(6), p(7), F.lit(":"), p(8))
    return F.when(stamp.rlike(pattern) & (at > 0) & (F.pmod(at, F.lit(3)) == 1), iso)


def parse_lines(lines: DataFrame, layout: str, column: str = "value") -> DataFrame:
    """``ip, timestamp, method, url, status, user_agent`` of access-log lines; lines of no such form give no row.

    In JSON, values of another type than text are ''; a status may be a number or its digits.
    """
    text = F.col(column)
    if layout == "combined":
        g = lambda i: F.regexp_extract(text, COMBINED, i)
        rows = lines.where(text.rlike(COMBINED)).select(g(1).alias("ip"), clf_to_iso(g(2)).alias("timestamp"), g(3).alias("method"), g(4).alias("url"), g(5).try_cast("int").alias("status"), g(6).alias("user_agent"))
        return rows.where("timestamp is not null")
    if layout not in LAYOUTS:
        raise ValueError(f"cannot parse lines of layout {layout}")
    parsed = lines.select(F.try_parse_json(text).alias("v")).where("v is not null").where(F.schema_of_variant("v").startswith("OBJECT"))
    names = LAYOUTS[layout]

    def string(name: str) -> Column:
        inner = F.expr(f"try_variant_get(v, '$.{name}', 'variant')")
        return F.when(F.schema_of_variant(inner) == "STRING", F.expr(f"try_variant_get(v, '$.{name}', 'string')")).otherwise(F.lit(""))

    status = F.regexp_extract(F.coalesce(F.expr(f"try_variant_get(v, '$.{names[4]}', 'string')"), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int")
    return parsed.select(*[(status if i == 4 else string(n)).alias(f) for i, (n, f) in enumerate(zip(names, FIELDS))])


def classify_bot(agent: Column, bots: Sequence[tuple[str, str]] = BOTS) -> Column:
    """The first bot whose pattern the user agent matches; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(bots):
        out = F.when(agent.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def within(stamp: Column, since: str | None, until: str | None) -> Column:
    """Whether a stamp lies in [since, until); one that gives no time passes."""
    at = F.try_to_timestamp(stamp)
    keep = F.lit(True)
    if since is not None:
        keep = keep & F.coalesce(at >= F.lit(since).cast("timestamp"), F.lit(True))
    if until is not None:
        keep = keep & F.coalesce(at < F.lit(until).cast("timestamp"), F.lit(True))
    return keep


def resolve_log_url(url: Column, site: str) -> Column:
    """A logged path as an absolute URL of the site."""
    origin = re.match(r"^[A-Za-z][\w+.\-]*://[^/?#]*", site)
    base = origin[0] if origin else site.rstrip("/")
    return F.when(url.rlike(r"^[A-Za-z][\w+.\-]*://"), url).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(F.concat(F.lit(base + "/"), url))


def bot_hits(hits: DataFrame, site: str | None = None, since: str | None = None, until: str | None = None, bots: Sequence[tuple[str, str]] = BOTS, normalize: bool = False) -> DataFrame:
    """Hits of known bots with ``bot``: cheap filters (fields, time) come before the user agent's patterns."""
    rows = hits.where((F.col("url") != "") & (F.col("timestamp") != "")).where(within(F.col("timestamp"), since, until)).withColumn("bot", classify_bot(F.col("user_agent"), bots)).where("bot is not null")
    if site:
        rows = rows.withColumn("url", resolve_log_url(F.col("url"), site))
    return rows.withColumn("url", F.coalesce(normalize_url(F.col("url")), "url")) if normalize else rows


def _some_ends(names: str, ending: str) -> Column:
    return F.exists(names, lambda n: F.lower(n).endswith(ending))


def verified_hits(hits: DataFrame, dns: DataFrame | None, suffixes: dict[str, tuple[str, ...]] = DNS_SUFFIXES) -> DataFrame:
    """``hits`` with ``verdict``: verified, spoofed or unverified.

    ``dns(ip, ptr, forward)`` holds the answers for the addresses in question. A bot with known
    suffixes is verified if some name of its address ends in one and the forward addresses contain
    it, spoofed otherwise, and unverified without an answer; a bot without suffixes is taken at
    its word. Without ``dns`` every hit is unverified. Only distinct (ip, bot) meet the answers.
    """
    if dns is None:
        return hits.withColumn("verdict", F.lit("unverified"))
    pairs = hits.select("ip", "bot").distinct().join(dns.dropDuplicates(["ip"]), "ip", "left")
    named, checked = F.lit(False), F.lit(False)
    for bot, ends in suffixes.items():
        fits = F.lit(False)
        for e in ends:
            fits = fits | _some_ends("ptr", e)
        named = named | ((F.col("bot") == bot) & fits)
        checked = checked | (F.col("bot") == bot)
    verdict = F.when(~checked, "verified").when(F.col("ptr").isNull(), "unverified").when(named & F.array_contains("forward", F.col("ip")), "verified").otherwise("spoofed")
    return hits.join(pairs.select("ip", "bot", verdict.alias("verdict")), ["ip", "bot"])


def url_aggregates(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per URL: ``hits, bots, status_counts, first_seen, last_seen``. Statuses are counted first, so a hot URL costs one row per status and bot."""
    fine = hits.groupBy(*by, "url", "status", "bot").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    per_status = fine.groupBy(*by, "url", "status").agg(F.sum("n").alias("n"), F.collect_set("bot").alias("bots"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("status").isNotNull(), F.struct("status", "n")))))
    return per_status.groupBy(*by, "url").agg(F.sum("n").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("bots")))).alias("bots"), counts.alias("status_counts"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"))


def bot_aggregates(hits: DataFrame) -> DataFrame:
    """Per bot: ``hits, unique_urls, unique_ips``, all exact, most hits first."""
    return hits.groupBy("bot").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("url").alias("unique_urls"), F.count_distinct("ip").alias("unique_ips")).orderBy(F.desc("hits"), "bot")


def time_window(hits: DataFrame) -> DataFrame:
    """``earliest, latest, duration_hours``; empty strings and 0 without hits."""
    one = hits.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("z"))
    hours = half_up((F.unix_millis(F.try_to_timestamp("z")) - F.unix_millis(F.try_to_timestamp("a"))) / 3_600_000)
    return one.select(F.coalesce("a", F.lit("")).alias("earliest"), F.coalesce("z", F.lit("")).alias("latest"), F.coalesce(hours, F.lit(0)).alias("duration_hours"))


def hit_counters(hits: DataFrame, bots: Sequence[tuple[str, str]] = BOTS) -> DataFrame:
    """``total_lines, parse_errors, bot_lines`` in one pass."""
    bad = (F.col("url") == "") | (F.col("timestamp") == "")
    return hits.agg(F.count(F.lit(1)).alias("total_lines"), F.count_if(bad).alias("parse_errors"), F.count_if(~bad & classify_bot(F.col("user_agent"), bots).isNotNull()).alias("bot_lines"))


def verdict_counters(hits: DataFrame, verified: bool) -> DataFrame:
    """``spoofed_hits, unverified_bot_hits``; without verification every bot's hit is unverified."""
    return hits.agg(F.count_if(F.lit(verified) & (F.col("verdict") == "spoofed")).alias("spoofed_hits"), F.count_if(F.lit(not verified) | (F.col("verdict") == "unverified")).alias("unverified_bot_hits"))


def fails(issues: Sequence[tuple[str, str]], severity: str | None) -> bool:
    """Whether issues (code, severity) reach the severity from which a run counts as failed; None never does."""
    order = ("high", "medium", "low")
    return severity is not None and any(order.index(s) <= order.index(severity) for _, s in issues)


def orphans(urls: DataFrame, pages: DataFrame, cap: int | None = ORPHAN_CAP) -> DataFrame:
    """Visited URLs that no page of the crawl has, as requested or final URL, most hits first."""
    known = pages.select(F.explode(F.array("url", "final_url")).alias("url")).distinct()
    found = urls.join(known, "url", "left_anti").select("url", "hits", "bots", "first_seen", "last_seen")
    return found if cap is None else found.orderBy(F.desc("hits"), "url").limit(cap)


def stale_priorities(urls: DataFrame, ranked: DataFrame, window_end: str, days: int = STALE_DAYS, top: int = STALE_TOP) -> DataFrame:
    """Of the ``top`` pages by rank those unseen in the window or for more than ``days``: ``url, page_rank, days_since, hits``.

    ``ranked`` needs ``url, page_rank, crawl_order``.
    """
    best = ranked.where("page_rank is not null").orderBy(F.desc("page_rank"), "crawl_order").limit(top).select("url", "page_rank")
    since = half_up((F.unix_millis(F.lit(window_end).cast("timestamp")) - F.unix_millis(F.try_to_timestamp("last_seen"))) / 86_400_000)
    rows = best.join(urls.select("url", "hits", "last_seen"), "url", "left").select("url", "page_rank", since.alias("days_since"), F.coalesce("hits", F.lit(0)).alias("hits"))
    return rows.where((F.col("hits") == 0) | (F.col("days_since") > days))


def status_mismatches(urls: DataFrame, pages: DataFrame, cap: int | None = MISMATCH_CAP) -> DataFrame:
    """URLs that the crawl got with 200 but bots with errors: ``url, crawl_status, worst_status, hits, status_counts``. The worst status is the highest."""
    crawl = pages.groupBy("url").agg(F.max_by("status", "crawl_order").alias("crawl_status")).where("crawl_status = 200")
    bad = F.array_max(F.filter(F.map_keys("status_counts"), lambda s: s >= 400))
    found = urls.join(crawl, "url").withColumn("worst_status", bad).where("worst_status is not null")
    found = found.select("url", "crawl_status", "worst_status", F.element_at("status_counts", F.col("worst_status")).alias("hits"), "status_counts")
    return found if cap is None else found.orderBy(F.desc("hits"), "url").limit(cap)


@dataclass
class LogReport:
    """All parts of a log analysis."""

    layout: str
    counters: DataFrame
    window: DataFrame
    bots: DataFrame
    urls: DataFrame
    orphans: DataFrame | None = None
    stale: DataFrame | None = None
    mismatches: DataFrame | None = None
    verdicts: DataFrame | None = None
    issues: list[tuple[str, str]] = field(default_factory=list)


def log_issues(report: LogReport) -> DataFrame | None:
    """``code, severity, url`` of the findings; null without a crawl."""
    if report.orphans is None or report.stale is None or report.mismatches is None:
        return None
    part = lambda df, code: df.select(F.lit(code).alias("code"), F.lit("low").alias("severity"), "url")
    return part(report.orphans, "LOG_ORPHAN_PAGE").unionByName(part(report.stale, "LOG_STALE_PRIORITY_PAGE")).unionByName(part(report.mismatches, "LOG_STATUS_MISMATCH"))
