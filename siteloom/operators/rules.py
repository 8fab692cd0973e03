"""Issue rules: each is a condition over a row of page features, with a code and a severity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import half_up
from siteloom.functions.url import expected_locale, is_web_url, normalize_url, primary_lang, url_host, url_path, url_scheme

H, M, L = "high", "medium", "low"

# Codes and severities of the rules on a single page.
SEVERITY: dict[str, str] = {
    "HTTP_ERROR": H, "NON_HTML_CONTENT": L, "FETCH_FAILED": H,
    "PAGE_NOT_HTTPS": H, "URL_REDIRECTED": L, "URL_REDIRECT_CHAIN": M, "TITLE_MISSING": H, "TITLE_MULTIPLE": M, "TITLE_TOO_SHORT": L, "TITLE_TOO_LONG": L, "META_DESCRIPTION_MISSING": M,
    "META_DESCRIPTION_LENGTH": L, "HTML_LANG_MISSING": L, "HTML_LANG_LOCALE_MISMATCH": M, "HREFLANG_INVALID": M, "HREFLANG_DUPLICATE": M, "HREFLANG_MISSING": L, "HREFLANG_X_DEFAULT_MISSING": L,
    "HREFLANG_SELF_MISSING": L, "CANONICAL_MISSING": M, "CANONICAL_CROSS_HOST": M, "CANONICAL_DIFFERS": L, "CANONICAL_INVALID": M, "H1_MISSING": M, "H1_MULTIPLE": L, "ROBOTS_NOINDEX": H,
    "IMAGES_MISSING_ALT": M, "OG_TITLE_MISSING": L, "OG_DESCRIPTION_MISSING": L, "OG_IMAGE_MISSING": L, "METADATA_SUSPICIOUS_VALUE": M, "SCHEMA_MISSING": L, "LOW_WORD_COUNT": L,
    "NO_INTERNAL_LINKS": L, "INTERNAL_LINK_ANCHOR_EMPTY": M, "INTERNAL_LINK_ANCHOR_GENERIC": L, "EXTRACTION_MISSING_REQUIRED": L, "IMAGES_MISSING_DIMENSIONS": L, "IMAGES_MISSING_LAZY_LOADING": L,
    "IMAGES_LEGACY_FORMAT": L, "MOBILE_VIEWPORT_MISSING": M, "MOBILE_VIEWPORT_WEAK": M, "MOBILE_VIEWPORT_LOCKS_ZOOM": M, "HEADER_X_ROBOTS_NOINDEX": H, "HEADER_X_ROBOTS_NOFOLLOW": M,
    "HEADER_HSTS_MISSING": L, "HEADER_CONTENT_TYPE_MISSING": M, "HEADER_CACHE_CONTROL_AGGRESSIVE_NOCACHE": L, "HEADER_LINK_CANONICAL_MULTIPLE": M, "HEADER_LINK_CANONICAL_INVALID": M,
    "HEADER_LINK_CANONICAL_HTML_MISMATCH": M, "HEADER_CONTENT_ENCODING_MISSING": L, "HEADER_VARY_ACCEPT_ENCODING_MISSING": L, "ROBOTS_DISALLOWS_URL": H,
}
#: Of structured data only a missing URL of an organisation is low.
SCHEMA_LOW = "SCHEMA_ORG_MISSING_URL"
# Codes that mark a site's infrastructure.
SITE_SEVERITY: dict[str, str] = {
    "ROBOTS_BLOCKS_ALL": H, "ROBOTS_NO_SITEMAP": L, "ROBOTS_MISSING": M, "ROBOTS_UNREACHABLE": M, "SITEMAP_MISSING": M, "SITEMAP_UNREACHABLE": M, "SITEMAP_LASTMOD_STALE": L,
    "LLMSTXT_EMPTY": L, "LLMSTXT_MISSING": L, "LLMSTXT_UNREACHABLE": L, "CRUX_API_KEY_MISSING": M, "CRUX_QUERY_FAILED": L, "CRUX_LCP_POOR": H, "CRUX_LCP_NEEDS_IMPROVEMENT": M,
    "CRUX_INP_POOR": H, "CRUX_INP_NEEDS_IMPROVEMENT": M, "CRUX_CLS_POOR": H, "CRUX_CLS_NEEDS_IMPROVEMENT": M,
}
_SUSPICIOUS = r"(?i)\[object object\]|\bundefined\b|\bnull\b"
_LEGACY = r"(?i)^(?!data:)[^?#]*\.(jpe?g|png|gif)(?:[?#].*)?$"


def is_html(content_type: Column) -> Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return low.contains("text/html") | low.contains("application/xhtml+xml")


def header(name: str) -> Column:
    """A response header by its lower-case name."""
    return F.element_at(F.transform_keys("headers", lambda k, _: F.lower(k)), name)


def length_rules(title: str = "title", meta: str = "meta_description") -> list[tuple[str, Column]]:
    t, m = F.col(title), F.col(meta)
    tl, ml = F.length(t), F.length(m)
    return [
        ("TITLE_MISSING", t.isNull()), ("TITLE_TOO_SHORT", tl < 20), ("TITLE_TOO_LONG", tl > 60), ("META_DESCRIPTION_MISSING", m.isNull()), ("META_DESCRIPTION_LENGTH", (ml < 70) | (ml > 160)),
    ]


def metadata_rules() -> list[tuple[str, Column]]:
    """Rules on columns that audit rows and page features both have."""
    url, canonical, locale = F.col("final_url"), F.col("canonical"), F.col("expected_locale")
    alt = F.coalesce("hreflang", F.array().cast("array<struct<lang:string,url:string>>"))
    langs = F.transform(alt, lambda a: a["lang"])
    hops = F.coalesce(F.size("redirect_chain"), F.lit(0))
    valid = is_web_url(canonical)
    other_host = url_host(canonical) != url_host(url)
    og = lambda k: F.coalesce(F.col(f"open_graph.{k}"), F.lit("")) == ""
    values = ("title", "meta_description", "canonical", "open_graph.title", "open_graph.description", "open_graph.image")
    suspicious = F.lit(False)
    for v in values:
        suspicious = suspicious | F.coalesce(F.col(v).rlike(_SUSPICIOUS), F.lit(False))
    return [
        ("PAGE_NOT_HTTPS", url_scheme(url) != "https"), ("URL_REDIRECTED", hops == 1), ("URL_REDIRECT_CHAIN", hops > 1), *length_rules(),
        ("HTML_LANG_MISSING", F.col("html_lang").isNull()), ("HTML_LANG_LOCALE_MISMATCH", locale.isNotNull() & F.col("html_lang").isNotNull() & ~locale.eqNullSafe(primary_lang(F.col("html_lang")))),
        ("HREFLANG_DUPLICATE", F.size(F.array_distinct(langs)) < F.size(langs)), ("HREFLANG_MISSING", locale.isNotNull() & (F.size(alt) == 0)),
        ("HREFLANG_X_DEFAULT_MISSING", (F.size(alt) > 0) & ~F.array_contains(langs, "x-default")),
        ("HREFLANG_SELF_MISSING", (F.size(alt) > 0) & locale.isNotNull() & ~F.exists(alt, lambda a: (primary_lang(a["lang"]) == locale) & (a["url"] == url))),
        ("CANONICAL_MISSING", canonical.isNull()), ("CANONICAL_CROSS_HOST", valid & other_host), ("CANONICAL_DIFFERS", valid & ~other_host & (canonical != url)), ("CANONICAL_INVALID", canonical.isNotNull() & ~valid),
        ("H1_MISSING", F.coalesce(F.size("h1s"), F.lit(0)) == 0), ("H1_MULTIPLE", F.size("h1s") > 1), ("ROBOTS_NOINDEX", F.lower("robots_meta").contains("noindex")), ("IMAGES_MISSING_ALT", F.col("images_missing_alt") > 0),
        ("OG_TITLE_MISSING", og("title")), ("OG_DESCRIPTION_MISSING", og("description")), ("OG_IMAGE_MISSING", og("image")), ("METADATA_SUSPICIOUS_VALUE", suspicious),
        ("SCHEMA_MISSING", F.coalesce(F.size("schema_types"), F.lit(0)) == 0), ("LOW_WORD_COUNT", F.col("word_count") < 200), ("NO_INTERNAL_LINKS", F.col("internal_links") == 0),
        ("INTERNAL_LINK_ANCHOR_EMPTY", F.col("anchors_empty") > 0), ("INTERNAL_LINK_ANCHOR_GENERIC", F.col("anchors_generic") > 0),
    ]


def markup_rules(required: list[str] | None = None) -> list[tuple[str, Column]]:
    """Rules that need the parsed markup."""
    images, view = F.col("images"), F.lower(F.coalesce("viewport", F.lit("")))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = lambda name: F.size(F.coalesce(F.element_at("extracted", name), F.array().cast("array<string>"))) > 0
    missing = F.lit(False)
    for name in required or []:
        missing = missing | ~found(name)
    return [
        ("TITLE_MULTIPLE", F.col("title").isNotNull() & (F.col("title_count") > 1)), ("HREFLANG_INVALID", F.size("hreflang_invalid") > 0), ("EXTRACTION_MISSING_REQUIRED", missing),
        ("IMAGES_MISSING_DIMENSIONS", F.exists(images, lambda i: blank(i["width"]) & blank(i["height"]))), ("IMAGES_MISSING_LAZY_LOADING", F.exists(images, lambda i: blank(i["loading"]))),
        ("IMAGES_LEGACY_FORMAT", F.exists(images, lambda i: F.coalesce(i["src"].rlike(_LEGACY), F.lit(False)))), ("MOBILE_VIEWPORT_MISSING", F.trim(view) == ""),
        ("MOBILE_VIEWPORT_WEAK", (F.trim(view) != "") & ~F.replace(view, F.lit(" "), F.lit("")).contains("width=device-width")),
        ("MOBILE_VIEWPORT_LOCKS_ZOOM", F.replace(view, F.lit(" "), F.lit("")).contains("user-scalable=no") | F.replace(view, F.lit(" "), F.lit("")).contains("maximum-scale=1")),
    ]


def header_rules() -> list[tuple[str, Column]]:
    """Rules on response headers. Link headers are split on commas before a target, so commas inside one don't matter."""
    robots = F.transform(F.split(F.lower(F.coalesce(header("x-robots-tag"), F.lit(""))), ","), lambda x: F.trim(x))
    plain = F.filter(robots, lambda d: ~d.contains(":"))
    cache = F.lower(F.coalesce(header("cache-control"), F.lit("")))
    encoding = F.lower(F.trim(F.coalesce(header("content-encoding"), F.lit(""))))
    vary = F.transform(F.split(F.lower(F.coalesce(header("vary"), F.lit(""))), ","), lambda x: F.trim(x))
    links = F.filter(F.split(F.coalesce(header("link"), F.lit("")), r",\s*(?=<)"), lambda p: p.rlike(r'(?i);\s*rel\s*=\s*("[^"]*\bcanonical\b[^"]*"|canonical\b)'))
    target = F.regexp_extract(F.get(links, F.lit(0)), "<([^>]*)>", 1)
    origin = F.regexp_extract("final_url", r"^[a-zA-Z][\w+.\-]*://[^/?#]*", 0)
    whole = F.when(target.startswith("/"), F.concat(origin, target)).otherwise(target)
    one = F.size(links) == 1
    return [
        ("HEADER_X_ROBOTS_NOINDEX", F.array_contains(plain, "noindex")), ("HEADER_X_ROBOTS_NOFOLLOW", F.array_contains(plain, "nofollow")),
        ("HEADER_HSTS_MISSING", (url_scheme(F.col("final_url")) == "https") & header("strict-transport-security").isNull()), ("HEADER_CONTENT_TYPE_MISSING", header("content-type").isNull()),
        ("HEADER_CACHE_CONTROL_AGGRESSIVE_NOCACHE", cache.contains("no-store") & cache.contains("no-cache") & cache.contains("max-age=0")), ("HEADER_LINK_CANONICAL_MULTIPLE", F.size(links) > 1),
        ("HEADER_LINK_CANONICAL_INVALID", one & normalize_url(whole).isNull()), ("HEADER_LINK_CANONICAL_HTML_MISMATCH", one & F.col("canonical").isNotNull() & (normalize_url(whole) != normalize_url(F.col("canonical")))),
        ("HEADER_CONTENT_ENCODING_MISSING", is_html(F.col("content_type")) & encoding.isin("", "identity")),
        ("HEADER_VARY_ACCEPT_ENCODING_MISSING", ~encoding.isin("", "identity") & ~F.array_contains(vary, "*") & ~F.array_contains(vary, "accept-encoding")),
    ]


def robots_allows(path: Column, rules: Column, agent: str) -> Column:
    """Whether a path may be crawled under ``rules``, an array of (agent, ord, kind, path): the longest prefix decides, of equals the agent's own and the earlier."""
    own = lambda r: F.when(r["agent"] == agent.lower(), 0).when(r["agent"] == "*", 1)
    fits = F.filter(rules, lambda r: own(r).isNotNull() & (r["path"] != "") & path.startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((-F.length(r["path"])).alias("n"), own(r).alias("o"), r["ord"].alias("i"), r["kind"].alias("kind")))
    return F.coalesce(F.array_min(ranked)["kind"] == "allow", F.lit(True))


def codes_of(rules: list[tuple[str, Column]]) -> Column:
    """The codes whose conditions hold, in the order of the rules; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def severity_of(code: Column) -> Column:
    """Severity of a rule's code, one lookup in a literal map."""
    table = F.create_map(*[F.lit(x) for kv in (SEVERITY | SITE_SEVERITY).items() for x in kv])
    return F.when(code.startswith("SCHEMA_") & (code != "SCHEMA_MISSING"), F.when(code == SCHEMA_LOW, L).otherwise(M)).otherwise(F.try_element_at(table, code))


def fetch_outcome() -> Column:
    """HTTP_ERROR, NON_HTML_CONTENT or FETCH_FAILED, which exclude all other rules; null for a fetched HTML page."""
    return F.when(F.coalesce("status", F.lit(0)) == 0, "FETCH_FAILED").when(F.col("status") >= 400, "HTTP_ERROR").when(~is_html(F.col("content_type")), "NON_HTML_CONTENT")


def rule_issues(pages: DataFrame, rules: Callable[[], list[tuple[str, Column]]] | list[tuple[str, Column]], keep: tuple[str, ...] = ("final_url",), extra: Column | None = None) -> DataFrame:
    """``keep, code, severity`` for every page and rule that fires. All rules are one projection; nothing is shuffled."""
    codes = codes_of(rules() if callable(rules) else rules)
    if extra is not None:
        codes = F.concat(codes, F.coalesce(extra, F.array().cast("array<string>")))
    outcome = fetch_outcome()
    fired = F.when(outcome.isNotNull(), F.array(outcome)).otherwise(codes)
    rows = pages.select(*keep, F.explode(fired).alias("code"))
    return rows.select(*keep, "code", severity_of(F.col("code")).alias("severity"))


def audit_issues(features: DataFrame, required: list[str] | None = None, robots: list[tuple[str, int, str, str]] | None = None, agent: str = "*", keep: tuple[str, ...] = ("final_url", "crawl_order")) -> DataFrame:
    """All single-page issues of parsed pages."""
    rules = metadata_rules() + markup_rules(required) + header_rules()
    if robots:
        table = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(i).alias("ord"), F.lit(k).alias("kind"), F.lit(p).alias("path")) for a, i, k, p in robots])
        rules = [*rules, ("ROBOTS_DISALLOWS_URL", ~robots_allows(url_path(F.col("final_url")), table, agent))]
    return rule_issues(features, rules, keep, F.col("schema_codes"))


def web_vitals(rows: DataFrame) -> DataFrame:
    """Field data of an origin, from ``raw_json``: ``lcp_ms, inp_ms, cls`` and the ``codes`` they break; unreadable numbers are null."""
    v = F.try_parse_json("raw_json")
    p75 = lambda name: F.expr(f"try_variant_get(_v, '$.record.metrics.{name}.percentiles.p75', 'string')").try_cast("double")
    out = rows.withColumn("_v", v).select("*", p75("largest_contentful_paint").alias("lcp_ms"), p75("interaction_to_next_paint").alias("inp_ms"), p75("cumulative_layout_shift").alias("cls")).drop("_v")
    grade = lambda c, good, poor, name: F.when(F.col(c) > poor, f"CRUX_{name}_POOR").when(F.col(c) > good, f"CRUX_{name}_NEEDS_IMPROVEMENT")
    return out.withColumn("codes", F.array_compact(F.array(grade("lcp_ms", 2500, 4000, "LCP"), grade("inp_ms", 200, 500, "INP"), grade("cls", 0.1, 0.25, "CLS"))))


def field_data_issues(rows: DataFrame | None, spark_rows: DataFrame, key_given: bool = True) -> DataFrame:
    """``site, code, severity`` of field data that was asked for: what ``web_vitals`` finds, CRUX_QUERY_FAILED where ``raw_json`` is null or no
    JSON, and CRUX_API_KEY_MISSING alone for every site of ``spark_rows`` where there was no key to ask with."""
    if not key_given or rows is None:
        found = spark_rows.select("site", F.lit("CRUX_API_KEY_MISSING").alias("code"))
    else:
        failed = F.try_parse_json("raw_json").isNull()
        found = web_vitals(rows).withColumn("codes", F.when(failed, F.array(F.lit("CRUX_QUERY_FAILED"))).otherwise(F.col("codes"))).select("site", F.explode("codes").alias("code"))
    return found.select("site", "code", severity_of(F.col("code")).alias("severity"))


def speed_reports(rows: DataFrame) -> DataFrame:
    """Scores (0 to 100) and metrics of speed audits from ``raw_json``; what is absent is null."""
    score = lambda name: half_up(F.expr(f"try_variant_get(_v, '$.categories[\"{name}\"].score', 'double')") * 100)
    metric = lambda name: F.round(F.expr(f"try_variant_get(_v, '$.audits[\"{name}\"].numericValue', 'double')"), 2)
    return rows.withColumn("_v", F.try_parse_json("raw_json")).select(
        "*", *[score(n).alias(n.replace("-", "_")) for n in ("performance", "accessibility", "best-practices", "seo")],
        *[metric(n).alias(n.replace("-", "_")) for n in ("first-contentful-paint", "largest-contentful-paint", "total-blocking-time", "cumulative-layout-shift", "speed-index", "interactive")],
    ).drop("_v")


def infrastructure_issues(site: DataFrame, now: str, stale_days: int = 365) -> DataFrame:
    """Issues of a site's files: ``site, code, severity`` from ``site, robots_status, robots_blocks_all, robots_sitemaps, sitemap_status, lastmods, llms_status, llms_text``.

    A null status means that the fetch failed. ``now`` is a parameter, so results can be repeated.
    """
    ok = lambda c: (F.col(c) >= 200) & (F.col(c) < 300)
    none = F.size(F.coalesce("robots_sitemaps", F.array().cast("array<string>"))) == 0
    old = F.exists("lastmods", lambda d: F.coalesce(F.try_to_timestamp(d) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(stale_days)} DAYS"), F.lit(False)))
    blank = F.trim(F.coalesce("llms_text", F.lit(""))) == ""
    rules = [
        ("ROBOTS_BLOCKS_ALL", ok("robots_status") & F.col("robots_blocks_all")), ("ROBOTS_NO_SITEMAP", ok("robots_status") & none), ("ROBOTS_MISSING", ~ok("robots_status")), ("ROBOTS_UNREACHABLE", F.col("robots_status").isNull()),
        ("SITEMAP_MISSING", ~ok("sitemap_status") & none), ("SITEMAP_UNREACHABLE", F.col("sitemap_status").isNull() & none), ("SITEMAP_LASTMOD_STALE", old),
        ("LLMSTXT_EMPTY", ok("llms_status") & blank), ("LLMSTXT_MISSING", ~ok("llms_status")), ("LLMSTXT_UNREACHABLE", F.col("llms_status").isNull()),
    ]
    return site.select("site", F.explode(codes_of(rules)).alias("code")).select("site", "code", severity_of(F.col("code")).alias("severity"))


__all__ = ["SEVERITY", "SITE_SEVERITY", "audit_issues", "codes_of", "expected_locale", "field_data_issues", "header_rules", "infrastructure_issues", "is_html", "markup_rules", "metadata_rules", "robots_allows", "rule_issues", "severity_of", "speed_reports", "web_vitals"]
