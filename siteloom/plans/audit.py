"""Whole analyses: an audit of captured pages, of a folder, and of access logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.protocols import parse_robots
from siteloom.operators import agents, diff, enrichment, features, keywords, linkgraph, logs, neardup, rules, sitewide
from siteloom.session import staged
from siteloom.sources.crawls import html_folder

Progress = Callable[[str], None]


@dataclass
class SiteReport:
    """The parts of an audit; those that weren't asked for are absent."""

    pages: DataFrame
    issues: DataFrame
    summary: DataFrame
    parts: dict[str, DataFrame] = field(default_factory=dict)


def audit(fetches: DataFrame, start_url: str | None = None, sitemap: DataFrame | None = None, robots_txt: str | None = None, user_agent: str = "*", keyword_list: Sequence[str] = (), top_terms: int = 0, extract: dict[str, Any] | None = None,
          site: DataFrame | None = None, now: str | None = None, field_data: DataFrame | None = None, field_data_wanted: bool = False, field_data_key: bool = True, agent_probes: dict[str, Any] | None = None, llms_txt: str | None = None, content_dedup: bool = True, link_graph: bool = True, gsc: DataFrame | None = None, ga4: DataFrame | None = None, on_progress: Progress = lambda _stage: None) -> SiteReport:
    """Audit the pages of one site, given as captures.

    HTML is parsed once and the features written once; everything after that is joins and aggregations over them. ``site`` is the
    row of the site's files (``sources.crawls.site_row``), ``field_data`` holds ``site, raw_json``, ``agent_probes`` what
    ``agents.probe_site`` found. Their issues carry no page; they are the part ``site_issues`` and count in the summary.
    """
    on_progress("parse")
    specs = features.extraction_rules(extract)
    page = staged(features.page_features(fetches, extract), "features")
    robots = parse_robots(robots_txt)["rules"] if robots_txt else None
    on_progress("rules")
    local = rules.audit_issues(page, [n for n, s in specs.items() if s["required"]], robots, user_agent)
    blank = F.lit(None).cast("string")
    as_issue = F.struct("code", "severity", blank.alias("message"), blank.alias("recommendation"))
    base = page.join(local.groupBy("final_url", "crawl_order").agg(F.collect_list(as_issue).alias("issues")), ["final_url", "crawl_order"], "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<code:string,severity:string,message:string,recommendation:string>>")))
    base = sitewide.in_sitemap(base, sitemap) if sitemap is not None else base.withColumn("in_sitemap", F.lit(False))
    base = staged(base, "audited")
    on_progress("site")
    named = lambda df: df.select("final_url", "code", "severity")
    found = [
        named(local), named(sitewide.duplicate_issues(base, "title", "TITLE_DUPLICATE_SITEWIDE", "medium")), named(sitewide.duplicate_issues(base, "meta_description", "META_DESCRIPTION_DUPLICATE_SITEWIDE", "low")),
        named(sitewide.link_issues(base)), named(sitewide.hreflang_issues(base)), named(sitewide.architecture_issues(base, start_url, sitemap is not None)),
    ]
    parts: dict[str, DataFrame] = {}
    spark = fetches.sparkSession
    about = [spark.createDataFrame([], "site string, code string, severity string")]
    origin = start_url or ""
    if site is not None:
        on_progress("site files")
        about.append(rules.infrastructure_issues(site, now or datetime.now(timezone.utc).isoformat()))
    if field_data_wanted or field_data is not None:
        about.append(rules.field_data_issues(field_data, spark.createDataFrame([(origin,)], "site string"), field_data_key))
    if agent_probes is not None and start_url:
        on_progress("agents")
        cover = agents.schema_coverage(base, start_url).first().asDict()
        ready = agents.readiness(robots_txt, llms_txt, cover, agent_probes["probes"], sitemap is not None, bool(agent_probes["link_rels"]))
        parts["agent_readiness"] = spark.createDataFrame([(k, int(ready[k])) for k in ("discoverability", "content", "bot_access", "capabilities", "total")], "area string, score int")
        about.append(spark.createDataFrame([(origin, c, s) for c, s in ready["issues"]], "site string, code string, severity string"))
    if content_dedup:
        on_progress("near-duplicates")
        parts["clusters"] = staged(neardup.near_duplicates(base, "crawl_order"), "clusters")
        found.append(parts["clusters"].select(F.col("url").alias("final_url"), F.lit("CONTENT_NEAR_DUPLICATE").alias("code"), F.lit("medium").alias("severity")))
    if link_graph:
        on_progress("link graph")
        parts |= {f"link_{k}": v for k, v in linkgraph.link_graph(base, "crawl_order").items()}
    site_issues = about[0]
    for more in about[1:]:
        site_issues = site_issues.unionByName(more)
    parts["site_issues"] = site_issues = staged(site_issues, "site-issues")
    issues = found[0]
    for more in found[1:]:
        issues = issues.unionByName(more)
    issues = staged(issues, "issues")
    complete = base.drop("issues").join(issues.groupBy("final_url").agg(F.collect_list(as_issue).alias("issues")), "final_url", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<code:string,severity:string,message:string,recommendation:string>>")))
    for name, column in (("titles", "title"), ("descriptions", "meta_description")):
        parts[f"duplicate_{name}"] = sitewide.duplicate_groups(base, column)
        parts[f"duplicate_{name}_pages"] = sitewide.duplicate_members(base, column)
    parts["issue_catalog"] = sitewide.issue_catalog(issues.withColumns({"crawl_order": F.lit(0), "ord": F.lit(0), "message": blank}))
    parts["issue_urls"] = sitewide.issue_urls(issues)
    parts["top_issues"] = sitewide.top_issues(issues.select("code").unionByName(site_issues.select("code")))
    if keyword_list:
        parts["keywords"] = keywords.keyword_summary(base, keyword_list)
        parts["keyword_urls"] = keywords.keyword_urls(base, keyword_list)
    if top_terms:
        parts["terms"] = keywords.top_terms(base, top_terms)
    if extract:
        parts["extractions"] = features.extraction_summary(base, extract)
    if gsc is not None or ga4 is not None:
        complete = enrichment.with_traffic(complete, gsc, ga4)
        parts["priorities"] = sitewide.priority_issues(complete)
    on_progress("done")
    # the site's own issues count in the totals: at most one row per severity
    own = {r["severity"]: r["n"] for r in site_issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    summary = sitewide.site_summary(complete).withColumns({f"issues_{s}": F.col(f"issues_{s}") + F.lit(own.get(s, 0)) for s in ("high", "medium", "low")})
    return SiteReport(complete, issues, summary, parts)


def scan_directory(spark: SparkSession, path: str, keyword_list: Sequence[str] = (), top_terms: int = 0) -> SiteReport:
    """Keywords and terms of the HTML files below a folder; no issues, links or duplicates, as files have no site."""
    fetches = html_folder(spark, path)
    page = staged(features.page_features(fetches), "features")
    if page.isEmpty():
        raise ValueError(f"no HTML files in {path}")
    page = page.withColumn("issues", F.array().cast("array<struct<code:string,severity:string,message:string,recommendation:string>>"))
    parts = {}
    if keyword_list:
        parts["keywords"] = keywords.keyword_summary(page, keyword_list)
        parts["keyword_urls"] = keywords.keyword_urls(page, keyword_list)
    if top_terms:
        parts["terms"] = keywords.top_terms(page, top_terms)
    return SiteReport(page, page.select("final_url", F.lit("").alias("code"), F.lit("").alias("severity")).limit(0), sitewide.site_summary(page), parts)


def analyze_logs(lines: DataFrame, site: str, layout: str = "auto", crawl: DataFrame | None = None, ranks: DataFrame | None = None, dns: DataFrame | None = None, since: str | None = None, until: str | None = None,
                 bots: Sequence[tuple[str, str]] = logs.BOTS, crawled_at: str | None = None, verify: bool = False) -> logs.LogReport:
    """Access-log lines (column ``value``) to bots, URLs and, with a crawl, findings.

    Hits of spoofed and, where there are DNS answers, unverified bots aren't aggregated but counted. ``verify`` says that
    verification was wanted; without ``dns`` that is an issue.
    """
    if not site:
        raise ValueError("site is required")
    if layout == "auto":
        layout = logs.detect_format([r["value"] for r in lines.where("value != ''").limit(5).collect()])
        if layout == "unknown":
            raise ValueError("the layout of the log could not be told; name it")
    hits = logs.parse_lines(lines, layout)
    judged = staged(logs.verified_hits(logs.bot_hits(hits, site, since, until, bots), dns), "bot-hits")
    kept = judged.where("verdict = 'verified'") if dns is not None else judged
    urls = staged(logs.url_aggregates(kept), "log-urls")
    window = logs.time_window(kept)
    report = logs.LogReport(layout, logs.hit_counters(hits, bots), window, logs.bot_aggregates(kept), urls, verdicts=logs.verdict_counters(judged, dns is not None))
    if crawl is not None:
        report.orphans = logs.orphans(urls, crawl)
        end = window.first()
        ranked = ranks if ranks is not None else crawl.select("url", F.lit(None).cast("double").alias("page_rank"), "crawl_order")
        report.stale = logs.stale_priorities(urls, ranked, end["latest"] or "1970-01-01")
        report.mismatches = logs.status_mismatches(urls, crawl)
        if crawled_at and end["earliest"] and crawled_at < end["earliest"]:
            report.issues.append(("LOG_BASELINE_STALE", "low"))
    if verify and dns is None:
        report.issues.append(("LOG_DNS_UNAVAILABLE", "low"))
    return report


def all_issues(report: SiteReport) -> DataFrame:
    """``code, severity`` of every issue of a report, the site's own included."""
    own = report.parts.get("site_issues")
    issues = report.issues.select("code", "severity")
    return issues if own is None else issues.unionByName(own.select("code", "severity"))


def diff_crawls(old: SiteReport, new: SiteReport) -> dict[str, Any]:
    """All differences of two audits, and the change of issue totals."""
    return {**diff.diff_reports(old.pages, new.pages), "severity_delta": diff.severity_delta(sitewide.severity_totals(all_issues(old)), sitewide.severity_totals(all_issues(new)))}
