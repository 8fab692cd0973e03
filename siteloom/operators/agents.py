"""How ready a site is for software agents: policies, llms.txt, structured data, capabilities."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.protocols import evaluate_llms, link_rels, parse_content_signals, parse_robots, url_allowed

# Agents whose policies are looked up, their files, and what counts as an article and an organisation.
AI_AGENTS = ("GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "anthropic-ai", "PerplexityBot", "Google-Extended", "CCBot", "Bytespider", "Applebot-Extended", "cohere-ai", "Meta-ExternalAgent")
WELL_KNOWN = ("agent-skills/index.json", "api-catalog", "mcp/server-card.json", "oauth-authorization-server", "oauth-protected-resource")
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle")
ARTICLE_PATH = r"(?i)/(blog|posts?|news|articles?)(/|$)"
SITE_TYPES = ("Organization", "WebSite")


def bot_policies(robots_txt: str | None, agents: tuple[str, ...] = AI_AGENTS) -> dict[str, str]:
    """Per agent: whether a block of its own lets it fetch the root (allowed or blocked); unspecified without such a block."""
    text = robots_txt or ""
    rules = parse_robots(text)["rules"]
    named = {m.strip().lower() for m in re.findall(r"(?im)^\s*user-agent\s*:\s*([^#\r\n]*)", text)}
    out = {}
    for agent in agents:
        own = [r for r in rules if r[0] == agent.lower()]
        out[agent] = "unspecified" if agent.lower() not in named else "allowed" if url_allowed("/", agent, own) else "blocked"
    return out


def schema_coverage(pages: DataFrame, start_url: str) -> DataFrame:
    """One row: ``article_like, article_with_schema, home_crawled, home_has_organization``.

    Article-like pages lie in a folder for posts, news or articles. The homepage is the root of the
    start URL's origin, or the start URL itself.
    """
    origin = lambda c: F.lower(F.regexp_extract(c, r"^[A-Za-z][\w+.\-]*://[^/?#]*", 0))
    path = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][\w+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", ""), F.lit("")), F.lit("/"))
    url, start = F.col("final_url"), F.lit(start_url)
    article = F.regexp_extract(url, r"^[A-Za-z][\w+.\-]*://[^/?#]*([^?#]*)", 1).rlike(ARTICLE_PATH)
    types = F.coalesce("schema_types", F.array().cast("array<string>"))
    typed = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    home = (origin(url) == origin(start)) & ((path(url) == "/") | (path(url) == path(start)))
    first_home = F.min_by(F.when(home, typed(SITE_TYPES)), F.when(home, F.col("crawl_order")))
    return pages.agg(
        F.count_if(article).alias("article_like"), F.count_if(article & typed(ARTICLE_TYPES)).alias("article_with_schema"), F.coalesce(F.bool_or(home), F.lit(False)).alias("home_crawled"), F.coalesce(first_home, F.lit(False)).alias("home_has_organization")
    )


#: A fetcher takes (url, method, headers) and gives (status, headers, text); it raises if there is no answer.
Probe = Callable[[str, str, dict[str, str]], tuple[int, dict[str, str], str]]
WEB_BOT_AUTH = "http-message-signatures-directory"


def probe_site(start_url: str, fetch: Probe) -> dict[str, Any]:
    """What a site offers to agents: ``probes`` as ``readiness`` takes them, ``statuses`` of the well-known files (None without an answer), and
    ``link_rels`` of the start page's Link header."""
    origin = re.match(r"[A-Za-z][\w+.\-]*://[^/?#]*", start_url)[0]

    def ask(url: str, method: str = "GET", headers: dict[str, str] | None = None) -> tuple[int | None, dict[str, str]]:
        try:
            status, got, _ = fetch(url, method, headers or {})
            return status, {k.lower(): v for k, v in got.items()}
        except Exception:
            return None, {}

    ok = lambda status: status is not None and 200 <= status < 300
    statuses = {name: ask(f"{origin}/.well-known/{name}")[0] for name in (*WELL_KNOWN, WEB_BOT_AUTH)}
    status, headers = ask(start_url, headers={"Accept": "text/markdown"})
    kind = headers.get("content-type", "").lower()
    rels = link_rels(ask(start_url, "HEAD")[1].get("link"))
    probes = {name: ok(statuses[name]) for name in WELL_KNOWN} | {"web-bot-auth": ok(statuses[WEB_BOT_AUTH]), "markdown": ok(status) and ("text/markdown" in kind or "application/markdown" in kind)}
    return {"probes": probes, "statuses": statuses, "link_rels": rels}


def readiness(robots_txt: str | None, llms_txt: str | None, coverage: Mapping[str, Any], probes: Mapping[str, bool], sitemap: bool = True, link_header: bool = False, llms_full: bool = False) -> dict[str, Any]:
    """Four scores of at most 100, their rounded mean, and the issues as (code, severity).

    ``probes`` says which files and abilities a site has: the names of ``WELL_KNOWN``, ``web-bot-auth`` and ``markdown``.
    """
    policies, signals, llms = bot_policies(robots_txt), parse_content_signals(robots_txt), evaluate_llms(llms_txt)
    whole = lambda x: math.floor(x + 0.5)
    explicit = sum(v != "unspecified" for v in policies.values())
    likes, typed = coverage["article_like"], coverage["article_with_schema"]
    found = sum(bool(probes.get(k)) for k in WELL_KNOWN)
    has = llms_txt is not None
    scores = {
        "discoverability": 50 * (robots_txt is not None) + 35 * sitemap + 15 * link_header,
        "content": min(100, has * (30 + 10 * (llms["has_h1"] + (llms["sections"] > 0) + (llms["links"] > 0) + (llms["bytes"] >= 200))) + 15 * llms_full + 15 * bool(probes.get("markdown"))),
        "bot_access": min(100, whole(explicit / len(policies) * 60) + 10 * sum(k in signals for k in ("search", "ai-train", "ai-input")) + 10 * bool(probes.get("web-bot-auth"))),
        "capabilities": min(100, whole(found / len(WELL_KNOWN) * 50) + 25 * bool(coverage["home_has_organization"]) + (whole(typed / likes * 25) if likes else 25)),
    }
    rules = [
        ("AGENT_NO_EXPLICIT_AI_POLICY", explicit == 0), ("AGENT_LLMSTXT_NO_H1", has and not llms["has_h1"]), ("AGENT_LLMSTXT_NO_SECTIONS", has and llms["sections"] == 0),
        ("AGENT_LLMSTXT_NO_LINKS", has and llms["links"] == 0), ("AGENT_LLMSTXT_TOO_SMALL", 0 < llms["bytes"] < 200), ("AGENT_ARTICLES_NO_SCHEMA", likes > 0 and typed == 0),
        ("AGENT_HOMEPAGE_NO_ORG", coverage["home_crawled"] and not coverage["home_has_organization"]),
    ]
    return {**scores, "total": whole(sum(scores.values()) / 4), "policies": policies, "signals": signals, "issues": [(c, "low") for c, on in rules if on]}


def site_readiness(sites: DataFrame) -> DataFrame:
    """``readiness`` for many sites: ``site``, the scores, ``total`` and ``codes``.

    ``sites`` has ``site, robots_text, llms_text, probes`` (map from name to boolean), ``sitemap, link_header, llms_full`` (booleans) and the columns of
    ``schema_coverage``. Null texts are files that a site lacks, other nulls count as no. One pass, nothing is shuffled.
    """
    names = ("discoverability", "content", "bot_access", "capabilities", "total")
    columns = ("site", "robots_text", "llms_text", "probes", "sitemap", "link_header", "llms_full", "article_like", "article_with_schema", "home_crawled", "home_has_organization")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            got = []
            for r in rows:
                cover = {k: r[k] or 0 for k in columns[-4:]}
                got.append(readiness(r["robots_text"], r["llms_text"], cover, dict(r["probes"] or {}), bool(r["sitemap"]), bool(r["link_header"]), bool(r["llms_full"])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("site"), *[pa.array([int(g[n]) for g in got], pa.int32()) for n in names], pa.array([[c for c, _ in g["issues"]] for g in got], pa.list_(pa.string()))], names=["site", *names, "codes"]
            )

    return sites.select(*columns).mapInArrow(run, "site string, " + ", ".join(f"{n} int" for n in names) + ", codes array<string>")
