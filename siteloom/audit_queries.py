"""Registered queries of the audit operators over the test tables, and their SQL.

The crawl's pages are the table ``pages``, ordered by ``page_id`` (unique), so that every tie has
a defined result. Its links lead out of the table; where links are wanted each page links to
the two pages fetched after it on its host.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions.text import STOP_WORDS, comparable, duplicate_key, half_up, summarized
from siteloom.functions.url import bucket_key, expected_locale, host_key, is_asset, match_url, matches_paths, normalize_url, primary_lang, toggled_slash, url_host, url_path
from siteloom.operators import agents, components, diff, enrichment, features, keywords, linkgraph, logs, neardup, rules, sampling, sitewide
from siteloom.plans.audit import audit
from siteloom.session import shared_dir, staged, table
from siteloom.sources.crawls import recent_crawls, sitemap_table
from siteloom.streaming import logs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS = ["crawl budget", "sitemap", "the", "caché", "no such phrase", "Journal"]
BOTS = (("otter", "otterbot"), ("tern", "ternbot"), ("lantern", "lanternspider"), ("moss", "mosscrawler"), ("pine", "pineindexer"), ("gulliver", "gulliverfetch"))
SITE = "https://fernhollow-market.example"
ROBOTS = [("*", 0, "disallow", "/forms"), ("*", 1, "allow", "/forms/s"), ("*", 2, "disallow", "/team/"), ("tester", 3, "allow", "/team/a"), ("tester", 4, "disallow", "/docs")]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return add


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("crawl_order", F.col("page_id").cast("int"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(url_host(F.col("final_url"))).orderBy("page_id")
    links = F.array_distinct(F.array_compact(F.array(F.lead("url", 1).over(w), F.lead("final_url", 2).over(w))))
    return pages_of(spark, sf_dir).withColumn("discovered_links", links)


_P = r"'^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(\?[^#]*)?(?:#.*)?$'"


def _u(c: str, n: int) -> str:
    return f"regexp_extract({c}, {_P}, {n})"


def _path(c: str) -> str:
    return f"(CASE WHEN {_u(c, 3)} = '' THEN '/' ELSE {_u(c, 3)} END)"


def _norm(c: str) -> str:
    return f"(lower({_u(c, 1)}) || '://' || lower({_u(c, 2)}) || CASE WHEN {_u(c, 3)} IN ('', '/') THEN '/' ELSE rtrim({_u(c, 3)}, '/') END || {_u(c, 4)})"


_LINKED = f"""
WITH p AS (SELECT * EXCLUDE (crawl_order, discovered_links), page_id AS crawl_order,
  list_distinct(list_filter([lead(url, 1) OVER w, lead(final_url, 2) OVER w], x -> x IS NOT NULL)) AS discovered_links
  FROM pages WINDOW w AS (PARTITION BY lower({_u("final_url", 2)}) ORDER BY page_id)),
k AS (SELECT url AS key, 1 AS prio, p.* FROM p UNION ALL SELECT final_url, 0, p.* FROM p),
lk AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY prio DESC, crawl_order DESC) = 1),
l AS (SELECT p.final_url AS src, t.key AS target, t.url AS t_url, t.final_url AS t_final, len(t.redirect_chain) AS hops,
  list_has_any(list_transform(t.issues, i -> i.code), ['HTTP_ERROR', 'FETCH_FAILED']) AS broken
  FROM (SELECT final_url, unnest(discovered_links) AS target FROM p) p JOIN lk t ON t.key = p.target)
"""
_HTML = "(contains(lower(coalesce(content_type, '')), 'text/html') OR contains(lower(coalesce(content_type, '')), 'application/xhtml'))"
_CODES = "list_transform(issues, i -> i.code)"


# ------------------------------------------------------------------ scalar functions


@query("url_parts", f"SELECT page_id, {_norm('url')} AS norm, lower({_u('url', 2)}) AS host, {_path('url')} AS path, regexp_replace(lower({_u('url', 2)}), '^www\\.', '') AS host_key, "
       f"CASE WHEN {_path('url')} = '/' THEN NULL WHEN ends_with({_path('url')}, '/') THEN lower({_u('url', 1)}) || '://' || lower({_u('url', 2)}) || rtrim({_path('url')}, '/') || {_u('url', 4)} ELSE lower({_u('url', 1)}) || '://' || lower({_u('url', 2)}) || {_path('url')} || '/' || {_u('url', 4)} END AS toggled, "
       f"regexp_matches({_path('url')}, '(?i)\\.(avif|css|gif|ico|jpe?g|js|json|map|mp3|mp4|pdf|png|svg|txt|webm|webp|woff2?|xml|zip)$') AS asset, "
       f"regexp_matches({_path('url')} || {_u('url', 4)}, '^/(blog|docs)') AND NOT regexp_matches({_path('url')} || {_u('url', 4)}, 'stale') AS wanted FROM pages")  # fmt: skip
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return pages_of(spark, sf_dir).select(
        "page_id", normalize_url(u).alias("norm"), url_host(u).alias("host"), url_path(u).alias("path"), host_key(u).alias("host_key"), toggled_slash(u).alias("toggled"), is_asset(u).alias("asset"), matches_paths(u, ["^/(blog|docs)"], ["stale"]).alias("wanted")
    )


@query("language_tags", f"SELECT page_id, CASE WHEN coalesce(trim(html_lang), '') IN ('', 'x-default') THEN NULL ELSE split_part(lower(replace(trim(html_lang), '_', '-')), '-', 1) END AS lang, "
       f"CASE WHEN regexp_matches(regexp_extract({_path('hreflang[1].url')}, '^/+([^/]+)', 1), '(?i)^[a-z]{{2}}(-[a-z]{{2}})?$') THEN lower(left(regexp_extract({_path('hreflang[1].url')}, '^/+([^/]+)', 1), 2)) END AS locale FROM pages")  # fmt: skip
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.coalesce(F.get("hreflang", F.lit(0))["url"], F.lit(""))
    return pages_of(spark, sf_dir).select("page_id", primary_lang(F.col("html_lang")).alias("lang"), expected_locale(first).alias("locale"))


@query("comparable_titles", r"SELECT page_id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS dup_key, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS plain, CAST(floor(title_length / 7.0 + 0.5) AS BIGINT) AS sevenths FROM pages")
def comparable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(spark, sf_dir).select("page_id", duplicate_key(F.col("title")).alias("dup_key"), comparable(F.col("title")).alias("plain"), half_up(F.col("title_length") / 7.0).alias("sevenths"))


@query("sitemap_buckets", f"""WITH s AS (SELECT page_id, list_filter(string_split(lower({_path('url')}), '/'), x -> x <> '') AS g FROM pages)
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN len(g) = 0 THEN '/' WHEN regexp_matches(g[1], '^[a-z]{{2}}(-[a-z]{{2}})?$') THEN left(g[1], 2) || '/' || coalesce(g[2], '(root)') ELSE g[1] END AS bucket FROM s) GROUP BY bucket""")
def sitemap_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(spark, sf_dir).groupBy(bucket_key(F.col("url")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ rules

_R = {
    "PAGE_NOT_HTTPS": f"lower({_u('final_url', 1)}) <> 'https'", "URL_REDIRECTED": "len(redirect_chain) = 1", "URL_REDIRECT_CHAIN": "len(redirect_chain) > 1", "TITLE_MISSING": "title IS NULL", "TITLE_TOO_SHORT": "length(title) < 20", "TITLE_TOO_LONG": "length(title) > 60",
    "META_DESCRIPTION_MISSING": "meta_description IS NULL", "META_DESCRIPTION_LENGTH": "length(meta_description) < 70 OR length(meta_description) > 160", "HTML_LANG_MISSING": "html_lang IS NULL",
    "HTML_LANG_LOCALE_MISMATCH": "expected_locale IS NOT NULL AND html_lang IS NOT NULL AND expected_locale IS DISTINCT FROM split_part(lower(replace(trim(html_lang), '_', '-')), '-', 1)",
    "HREFLANG_DUPLICATE": "len(list_distinct(list_transform(hreflang, a -> a.lang))) < len(hreflang)", "HREFLANG_MISSING": "expected_locale IS NOT NULL AND coalesce(len(hreflang), 0) = 0", "HREFLANG_X_DEFAULT_MISSING": "len(hreflang) > 0 AND NOT list_contains(list_transform(hreflang, a -> a.lang), 'x-default')",
    "HREFLANG_SELF_MISSING": "len(hreflang) > 0 AND expected_locale IS NOT NULL AND len(list_filter(hreflang, a -> split_part(lower(replace(trim(a.lang), '_', '-')), '-', 1) = expected_locale AND a.url = final_url)) = 0",
    "CANONICAL_MISSING": "canonical IS NULL", "CANONICAL_CROSS_HOST": f"lower({_u('canonical', 1)}) IN ('http', 'https') AND {_u('canonical', 2)} <> '' AND lower({_u('canonical', 2)}) <> lower({_u('final_url', 2)})",
    "CANONICAL_DIFFERS": f"lower({_u('canonical', 1)}) IN ('http', 'https') AND lower({_u('canonical', 2)}) = lower({_u('final_url', 2)}) AND canonical <> final_url", "CANONICAL_INVALID": f"canonical IS NOT NULL AND NOT (lower({_u('canonical', 1)}) IN ('http', 'https') AND {_u('canonical', 2)} <> '')",
    "H1_MISSING": "coalesce(len(h1s), 0) = 0", "H1_MULTIPLE": "len(h1s) > 1", "ROBOTS_NOINDEX": "contains(lower(robots_meta), 'noindex')", "IMAGES_MISSING_ALT": "images_missing_alt > 0",
    "OG_TITLE_MISSING": "coalesce(open_graph.title, '') = ''", "OG_DESCRIPTION_MISSING": "coalesce(open_graph.description, '') = ''", "OG_IMAGE_MISSING": "coalesce(open_graph.image, '') = ''",
    "METADATA_SUSPICIOUS_VALUE": " OR ".join(f"coalesce(regexp_matches({c}, '(?i)\\[object object\\]|\\bundefined\\b|\\bnull\\b'), false)" for c in ("title", "meta_description", "canonical", "open_graph.title", "open_graph.description", "open_graph.image")),
    "SCHEMA_MISSING": "coalesce(len(schema_types), 0) = 0", "LOW_WORD_COUNT": "word_count < 200", "NO_INTERNAL_LINKS": "internal_links = 0", "INTERNAL_LINK_ANCHOR_EMPTY": "anchors_empty > 0", "INTERNAL_LINK_ANCHOR_GENERIC": "anchors_generic > 0",
}
_PAGE_RULES = (
    f"SELECT page_id, CASE WHEN coalesce(status, 0) = 0 THEN 'FETCH_FAILED' WHEN status >= 400 THEN 'HTTP_ERROR' ELSE 'NON_HTML_CONTENT' END AS code FROM pages WHERE coalesce(status, 0) = 0 OR status >= 400 OR NOT {_HTML} UNION ALL "
    + " UNION ALL ".join(f"SELECT page_id, '{code}' FROM pages WHERE status < 400 AND status > 0 AND {_HTML} AND ({cond})" for code, cond in _R.items())
)
_SEVERITIES = "(VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in rules.SEVERITY.items()) + ") s(code, severity)"


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_issues(pages_of(spark, sf_dir), rules.metadata_rules, ("page_id", "final_url", "crawl_order"))


@query("page_rule_issues", f"SELECT r.page_id, r.code, s.severity FROM ({_PAGE_RULES}) r JOIN {_SEVERITIES} USING (code)")
def page_rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir).select("page_id", "code", "severity")


@query("page_rule_totals", f"SELECT s.severity, count(*) AS n, count(DISTINCT r.page_id) AS pages FROM ({_PAGE_RULES}) r JOIN {_SEVERITIES} USING (code) GROUP BY s.severity")
def page_rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_rows(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("robots_allowed", f"""WITH p AS (SELECT page_id, {_path('final_url')} AS path FROM pages), r(agent, ord, kind, prefix) AS (VALUES {', '.join(f"('{a}', {i}, '{k}', '{x}')" for a, i, k, x in ROBOTS)}),
m AS (SELECT page_id, kind FROM p JOIN r ON starts_with(path, prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, agent = '*', ord) = 1)
SELECT page_id, coalesce(kind = 'allow', true) AS allowed FROM p LEFT JOIN m USING (page_id)""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(i).alias("ord"), F.lit(k).alias("kind"), F.lit(p).alias("path")) for a, i, k, p in ROBOTS])
    return pages_of(spark, sf_dir).select("page_id", rules.robots_allows(url_path(F.col("final_url")), table_, "tester").alias("allowed"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures whose HTML is written from the audit columns."""
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    quoted = lambda c: F.replace(esc(c), F.lit('"'), F.lit("&quot;"))
    tag = lambda when, *parts: F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<!doctype html><html"), tag(F.col("html_lang").isNotNull(), ' lang="', quoted("html_lang"), '"'), F.lit("><head>"), tag(F.col("title").isNotNull(), "<title> ", esc("title"), "\n</title>"),
        tag(F.col("meta_description").isNotNull(), '<meta name="description" content="', quoted("meta_description"), '">'), tag(F.col("robots_meta").isNotNull(), "<META NAME=robots CONTENT='", quoted("robots_meta"), "'>"),
        F.lit("</head><body>"), F.array_join(F.transform("h1s", lambda h: F.concat(F.lit("<h1>"), F.replace(h, F.lit("<"), F.lit("&lt;")), F.lit("</h1>"))), ""), F.array_join(F.transform("discovered_links", lambda u: F.concat(F.lit('<a href="'), u, F.lit('#top"><b>go</b></a><p>text'))), ""), F.lit("</body>"),
    )
    return pages_of(spark, sf_dir).select("url", "final_url", "status", "content_type", F.create_map().cast("map<string,string>").alias("headers"), "redirect_chain", html.alias("html"), "crawl_order")


@query("html_features", r"""SELECT page_id AS crawl_order, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(meta_description, '\s+', ' ', 'g')), '') AS meta_description, nullif(trim(html_lang), '') AS html_lang,
nullif(trim(robots_meta), '') AS robots_meta, len(h1s) AS n_h1, len(discovered_links) AS n_links FROM pages""")
def html_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.page_features(captures(spark, sf_dir)).select("crawl_order", "title", "meta_description", "html_lang", "robots_meta", F.size("h1s").alias("n_h1"), (F.size("discovered_links") + F.col("external_links")).alias("n_links"))


# ------------------------------------------------------------------ headers, markup, structured data, files of a site, field data


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with response headers, a viewport, images and extracted values that follow from ``page_id``, so that every rule fires somewhere."""
    k = lambda n: F.col("page_id") % n
    link = F.when(k(7) == 0, F.concat(F.lit("<"), F.col("canonical"), F.lit('>; rel="canonical"'))).when(k(7) == 1, F.lit("</a>; rel=canonical, </b>; rel=canonical")).when(k(7) == 2, F.lit("<mailto:x>; rel=canonical")).when(k(7) == 3, F.lit("</a>; rel=prev"))
    headers = {
        "X-Robots-Tag": F.when(k(5) == 0, "noindex, nofollow").when(k(5) == 1, "somebot: noindex"), "Strict-Transport-Security": F.when(k(3) == 0, "max-age=9"), "Content-Type": F.col("content_type"),
        "cache-control": F.when(k(4) == 0, "no-store, no-cache, max-age=0").when(k(4) == 1, "no-store"), "content-encoding": F.when(k(6) == 0, "gzip").when(k(6) == 1, "identity"), "Vary": F.when(k(12) == 0, "Cookie, Accept-Encoding"), "Link": link,
    }
    given = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in headers.items()]), lambda e: e["v"].isNotNull()))
    images = F.transform(F.slice(F.array(*map(F.lit, (0, 1, 2, 3))), 1, k(5).cast("int")), lambda i: F.struct(F.when(i % 2 == 0, F.lit("/a.JPG?x")).otherwise(F.lit("data:image/x.png")).alias("src"), F.when(i < 2, F.lit("4")).alias("width"), F.lit(" ").alias("height"), F.when(i < 3, F.lit("lazy")).alias("loading")))
    view = F.when(k(4) == 0, "width=device-width, initial-scale=1").when(k(4) == 1, "width = device-width, user-scalable=no").when(k(4) == 2, "width=320")
    return pages_of(spark, sf_dir).select(
        "*", given.alias("headers"), images.alias("images"), view.alias("viewport"), (1 + k(2)).cast("int").alias("title_count"), F.when(k(5) == 0, F.array(F.lit("bad tag"))).otherwise(F.array().cast("array<string>")).alias("hreflang_invalid"),
        F.create_map(F.lit("price"), F.when(k(3) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1")))).alias("extracted"),
    )


_OK = f"coalesce(status, 0) <> 0 AND status < 400 AND {_HTML}"
_FAILED = f"SELECT page_id, CASE WHEN coalesce(status, 0) = 0 THEN 'FETCH_FAILED' WHEN status >= 400 THEN 'HTTP_ERROR' ELSE 'NON_HTML_CONTENT' END AS code FROM pages WHERE coalesce(status, 0) = 0 OR status >= 400 OR NOT {_HTML}"


def _rule_sql(conditions: dict[str, str]) -> str:
    return _FAILED + "".join(f" UNION ALL SELECT page_id, '{code}' FROM pages WHERE {_OK} AND ({cond})" for code, cond in conditions.items())


_WEB = lambda c: f"(lower({_u(c, 1)}) IN ('http', 'https') AND {_u(c, 2)} <> '')"


@query("header_issues", _rule_sql({
    "HEADER_X_ROBOTS_NOINDEX": "page_id % 5 = 0", "HEADER_X_ROBOTS_NOFOLLOW": "page_id % 5 = 0", "HEADER_HSTS_MISSING": f"lower({_u('final_url', 1)}) = 'https' AND page_id % 3 <> 0", "HEADER_CONTENT_TYPE_MISSING": "content_type IS NULL",
    "HEADER_CACHE_CONTROL_AGGRESSIVE_NOCACHE": "page_id % 4 = 0", "HEADER_LINK_CANONICAL_MULTIPLE": "page_id % 7 = 1", "HEADER_LINK_CANONICAL_INVALID": f"page_id % 7 = 2 OR (page_id % 7 = 0 AND canonical IS NOT NULL AND NOT {_WEB('canonical')})",
    "HEADER_LINK_CANONICAL_HTML_MISMATCH": "false", "HEADER_CONTENT_ENCODING_MISSING": "page_id % 6 <> 0", "HEADER_VARY_ACCEPT_ENCODING_MISSING": "page_id % 6 = 0 AND page_id % 12 <> 0",
}))
def header_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_issues(headed(spark, sf_dir), rules.header_rules, ("page_id",)).select("page_id", "code")


@query("markup_issues", _rule_sql({
    "TITLE_MULTIPLE": "title IS NOT NULL AND page_id % 2 = 1", "HREFLANG_INVALID": "page_id % 5 = 0", "EXTRACTION_MISSING_REQUIRED": "page_id % 3 = 0", "IMAGES_MISSING_DIMENSIONS": "page_id % 5 > 2", "IMAGES_MISSING_LAZY_LOADING": "page_id % 5 > 3",
    "IMAGES_LEGACY_FORMAT": "page_id % 5 > 0", "MOBILE_VIEWPORT_MISSING": "page_id % 4 = 3", "MOBILE_VIEWPORT_WEAK": "page_id % 4 = 2", "MOBILE_VIEWPORT_LOCKS_ZOOM": "page_id % 4 = 1",
}))
def markup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_issues(headed(spark, sf_dir), rules.markup_rules(["price"]), ("page_id",)).select("page_id", "code")


_BLANK = lambda c: f"coalesce(trim({c}), '') = ''"


@query("schema_issues", " UNION ALL ".join(f"SELECT page_id AS crawl_order, '{code}' AS code FROM pages WHERE page_id % 6 = {k} AND ({cond})" for k, code, cond in (
    (0, "SCHEMA_ARTICLE_MISSING_HEADLINE", _BLANK("title")), (0, "SCHEMA_ARTICLE_MISSING_IMAGE", _BLANK("canonical")), (0, "SCHEMA_ARTICLE_MISSING_DATE_PUBLISHED", _BLANK("html_lang")), (0, "SCHEMA_ARTICLE_MISSING_AUTHOR", _BLANK("meta_description")),
    (1, "SCHEMA_ORG_MISSING_NAME", _BLANK("title")), (1, "SCHEMA_ORG_MISSING_URL", _BLANK("canonical")), (1, "SCHEMA_ORG_MISSING_LOGO", _BLANK("meta_description")), (1, "SCHEMA_LOCALBUSINESS_MISSING_ADDRESS", _BLANK("html_lang")), (1, "SCHEMA_LOCALBUSINESS_MISSING_TELEPHONE", _BLANK("robots_meta")),
    (2, "SCHEMA_PRODUCT_MISSING_NAME", _BLANK("title")), (2, "SCHEMA_PRODUCT_MISSING_IMAGE", _BLANK("canonical")), (2, "SCHEMA_PRODUCT_OFFERS_MISSING_PRICE", _BLANK("meta_description")), (2, "SCHEMA_PRODUCT_OFFERS_MISSING_CURRENCY", f"NOT ({_BLANK('meta_description')}) AND {_BLANK('html_lang')}"),
    (3, "SCHEMA_PRODUCT_MISSING_NAME", "true"), (3, "SCHEMA_PRODUCT_MISSING_IMAGE", "true"), (3, "SCHEMA_PRODUCT_MISSING_OFFERS", "true"),
    (4, "SCHEMA_FAQ_NO_QUESTIONS", _BLANK("title")), (4, "SCHEMA_FAQ_QUESTION_INCOMPLETE", f"NOT ({_BLANK('title')}) AND {_BLANK('meta_description')}"), (5, "SCHEMA_BREADCRUMB_NO_ITEMS", _BLANK("title")), (5, "SCHEMA_BREADCRUMB_ITEM_INCOMPLETE", f"NOT ({_BLANK('title')}) AND {_BLANK('html_lang')}"),
)))
def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose structured data, one kind by ``page_id``, is written from the audit columns."""
    t, c, m, g, r = (F.col(x) for x in ("title", "canonical", "meta_description", "html_lang", "robots_meta"))
    some = F.trim(F.coalesce(t, F.lit(""))) != ""
    kinds = (
        F.struct(F.lit("NewsArticle").alias("@type"), t.alias("headline"), c.alias("image"), g.alias("datePublished"), m.alias("author")),
        F.struct(F.lit("LocalBusiness").alias("@type"), t.alias("name"), c.alias("url"), m.alias("logo"), g.alias("address"), r.alias("telephone")),
        F.struct(F.lit("Product").alias("@type"), t.alias("name"), c.alias("image"), F.array(F.struct(m.alias("price"), g.alias("priceCurrency")), F.struct(F.lit(None).cast("string").alias("price"), F.lit(None).cast("string").alias("priceCurrency"))).alias("offers")),
        F.struct(F.lit("Product").alias("@type")),
        F.struct(F.lit("FAQPage").alias("@type"), F.when(some, F.array(F.struct(t.alias("name"), F.struct(m.alias("text")).alias("acceptedAnswer")))).alias("mainEntity")),
        F.struct(F.lit("BreadcrumbList").alias("@type"), F.when(some, F.array(F.struct(F.lit(1).alias("position"), t.alias("name"), g.alias("item")))).alias("itemListElement")),
    )
    script = F.lit("")
    for i, kind in enumerate(kinds):
        # the second, empty offer of a product would only matter where the first is complete
        text = F.to_json(kind) if i != 2 else F.to_json(kind.withField("offers", F.slice(kind["offers"], 1, 1)))
        script = F.when(F.col("page_id") % 6 == i, text).otherwise(script)
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.replace(script, F.lit("<"), F.lit("\\u003c")), F.lit("</script></head><body></body></html>"))
    made = pages_of(spark, sf_dir).select("url", "final_url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.create_map().cast("map<string,string>").alias("headers"), "redirect_chain", html.alias("html"), "crawl_order")
    return features.page_features(made).select("crawl_order", F.explode("schema_codes").alias("code"))


_SITES = f"SELECT lower({_u('final_url', 2)}) AS site, count(*) AS n, min(page_id) AS k FROM pages WHERE final_url IS NOT NULL GROUP BY 1"


@query("infrastructure_issues", f"WITH s AS ({_SITES}), f AS (SELECT site, k, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 404 ELSE 200 END AS robots, k % 3 = 0 AS blocks, k % 2 = 0 AS listed, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 500 ELSE 200 END AS sitemap, k % 3 = 1 AS old, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 410 ELSE 204 END AS llms, k % 7 = 0 AS blank FROM s) "
       + " UNION ALL ".join(f"SELECT site, '{c}' AS code FROM f WHERE {w}" for c, w in (
           ("ROBOTS_BLOCKS_ALL", "robots = 200 AND blocks"), ("ROBOTS_NO_SITEMAP", "robots = 200 AND NOT listed"), ("ROBOTS_MISSING", "robots = 404"), ("ROBOTS_UNREACHABLE", "robots IS NULL"), ("SITEMAP_MISSING", "sitemap = 500 AND NOT listed"),
           ("SITEMAP_UNREACHABLE", "sitemap IS NULL AND NOT listed"), ("SITEMAP_LASTMOD_STALE", "old"), ("LLMSTXT_EMPTY", "llms = 204 AND blank"), ("LLMSTXT_MISSING", "llms = 410"), ("LLMSTXT_UNREACHABLE", "llms IS NULL"))))
def infrastructure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: F.col("k") % n
    sites = pages_of(spark, sf_dir).where("final_url is not null").groupBy(url_host(F.col("final_url")).alias("site")).agg(F.min("page_id").alias("k"))
    row = sites.select(
        "site", F.when(k(4) == 0, None).when(k(4) == 1, 404).otherwise(200).alias("robots_status"), (k(3) == 0).alias("robots_blocks_all"), F.when(k(2) == 0, F.array(F.lit("/s.xml"))).alias("robots_sitemaps"), F.when(k(5) == 0, None).when(k(5) == 1, 500).otherwise(200).alias("sitemap_status"),
        F.when(k(3) == 1, F.array(F.lit("2025-06-01"), F.lit("2020-06-01"))).otherwise(F.array(F.lit("2025-06-01"), F.lit("no date"))).alias("lastmods"), F.when(k(6) == 0, None).when(k(6) == 1, 410).otherwise(204).alias("llms_status"), F.when(k(7) == 0, "  ").otherwise("# t").alias("llms_text"),
    )
    return rules.infrastructure_issues(row, "2026-01-01").select("site", "code")


@query("field_data_issues", f"WITH s AS ({_SITES}) SELECT site, unnest(CASE WHEN k % 9 = 0 THEN ['CRUX_QUERY_FAILED'] ELSE list_filter([CASE WHEN n * 40 > 4000 THEN 'CRUX_LCP_POOR' WHEN n * 40 > 2500 THEN 'CRUX_LCP_NEEDS_IMPROVEMENT' END, CASE WHEN k % 700 > 500 THEN 'CRUX_INP_POOR' WHEN k % 700 > 200 THEN 'CRUX_INP_NEEDS_IMPROVEMENT' END, CASE WHEN k % 30 > 25 THEN 'CRUX_CLS_POOR' WHEN k % 30 > 10 THEN 'CRUX_CLS_NEEDS_IMPROVEMENT' END], x -> x IS NOT NULL) END) AS code FROM s")
def field_data_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = pages_of(spark, sf_dir).where("final_url is not null").groupBy(url_host(F.col("final_url")).alias("site")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("k"))
    part = lambda name, value: F.concat(F.lit(f'"{name}":{{"percentiles":{{"p75":'), value, F.lit("}}"))
    cls = F.concat(F.lit('"'), (F.col("k") % 30 / 100).cast("decimal(4,2)").cast("string"), F.lit('"'))
    body = F.concat(F.lit('{"record":{"metrics":{'), part("largest_contentful_paint", (F.col("n") * 40).cast("string")), F.lit(","), part("interaction_to_next_paint", (F.col("k") % 700).cast("string")), F.lit(","), part("cumulative_layout_shift", cls), F.lit("}}}"))
    rows = sites.select("site", F.when(F.col("k") % 9 == 0, F.when(F.col("k") % 2 == 0, "{broken")).otherwise(body).alias("raw_json"))
    return rules.field_data_issues(rows, sites.select("site")).select("site", "code")


@query("sitemap_entries", f"SELECT lower({_u('final_url', 2)}) AS sitemap_url, url AS url, CASE WHEN page_id % 2 = 0 THEN crawled_at END AS lastmod FROM pages WHERE final_url IS NOT NULL AND coalesce(trim(url), '') <> ''")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of one sitemap per site, written with entities and CDATA."""
    loc = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<![CDATA["), F.col("url"), F.lit("]]>"))).otherwise(F.replace("url", F.lit("&"), F.lit("&amp;")))
    entry = F.concat(F.lit("<url>\n<loc> "), loc, F.lit(" </loc>"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<lastmod>"), F.col("crawled_at"), F.lit("</lastmod>"))).otherwise(F.lit("")), F.lit("</url>"))
    files = pages_of(spark, sf_dir).where("final_url is not null and trim(coalesce(url, '')) != ''").groupBy(url_host(F.col("final_url")).alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return sitemap_table(files)


@query("sitemap_membership", "WITH s AS (SELECT DISTINCT url AS key FROM pages WHERE page_id % 2 = 0 AND url IS NOT NULL) SELECT page_id, coalesce(url IN (SELECT key FROM s), false) OR coalesce(final_url IN (SELECT key FROM s), false) AS in_sitemap FROM pages")
def sitemap_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages_of(spark, sf_dir)
    return sitewide.in_sitemap(p.drop("in_sitemap"), p.where("page_id % 2 = 0").select("url")).select("page_id", "in_sitemap")


@query("extracted_values", "SELECT page_id AS crawl_order, coalesce(len(h1s), 0) AS heads, coalesce(len(discovered_links), 0) AS links, coalesce(len(h1s), 0) = 0 AS missing FROM pages")
def extracted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features.page_features(captures(spark, sf_dir), {"heads": {"selector": "h1", "all": True}, "links": {"selector": "a@href", "all": True}, "first": "body > h1"})
    size = lambda name: F.coalesce(F.size(F.element_at("extracted", name)), F.lit(0))
    return got.select("crawl_order", size("heads").alias("heads"), size("links").alias("links"), (size("first") == 0).alias("missing"))


@query("extraction_totals", "SELECT 'heads' AS field, true AS required, count_if(len(h1s) > 0) AS pages_matched, count_if(coalesce(len(h1s), 0) = 0) AS pages_missing FROM pages UNION ALL SELECT 'links', false, count_if(len(discovered_links) > 0), count_if(coalesce(len(discovered_links), 0) = 0) FROM pages UNION ALL SELECT 'none', false, 0, count(*) FROM pages")
def extraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = {"heads": {"selector": "h1", "all": True, "required": True}, "links": {"selector": "a@href", "all": True}, "none": ".nowhere"}
    return features.extraction_summary(features.page_features(captures(spark, sf_dir), specs), specs)


# ------------------------------------------------------------------ site-wide

_DUP = """SELECT min_by({c}, page_id) AS value, count(*) AS "count" FROM pages WHERE {c} IS NOT NULL AND {c} <> '' GROUP BY lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) HAVING count(*) > 1"""
_DUP_PAGES = """WITH k AS (SELECT page_id, final_url, {c} AS v, lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) AS key FROM pages WHERE {c} IS NOT NULL AND {c} <> ''), g AS (SELECT key, min_by(v, page_id) AS value FROM k GROUP BY key HAVING count(*) > 1) SELECT value, final_url FROM k JOIN g USING (key)"""


@query("duplicate_titles", _DUP.format(c="title"))
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.duplicate_groups(pages_of(spark, sf_dir), "title")


@query("duplicate_descriptions", _DUP.format(c="meta_description"))
def duplicate_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.duplicate_groups(pages_of(spark, sf_dir), "meta_description")


@query("duplicate_title_pages", _DUP_PAGES.format(c="title"))
def duplicate_title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.duplicate_members(pages_of(spark, sf_dir), "title")


@query("duplicate_description_pages", _DUP_PAGES.format(c="meta_description"))
def duplicate_description_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.duplicate_members(pages_of(spark, sf_dir), "meta_description")


@query("duplicate_title_issues", r"""WITH n AS (SELECT final_url, count(*) OVER (PARTITION BY lower(trim(regexp_replace(title, '\s+', ' ', 'g')))) AS group_size FROM pages WHERE title IS NOT NULL AND title <> '')
SELECT DISTINCT final_url, 'TITLE_DUPLICATE_SITEWIDE' AS code, 'medium' AS severity, group_size FROM n WHERE group_size > 1""")
def duplicate_title_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.duplicate_issues(pages_of(spark, sf_dir), "title", "TITLE_DUPLICATE_SITEWIDE", "medium")


@query("link_issues", _LINKED + """SELECT final_url, code, CASE WHEN code = 'INTERNAL_LINK_REDIRECTS' THEN 'low' ELSE 'medium' END AS severity, count(DISTINCT label) AS targets FROM (
SELECT src AS final_url, CASE WHEN broken THEN 'INTERNAL_LINK_BROKEN' WHEN t_url = target AND t_final <> target AND hops > 1 THEN 'INTERNAL_LINK_REDIRECT_CHAIN' WHEN t_url = target AND t_final <> target THEN 'INTERNAL_LINK_REDIRECTS' END AS code,
CASE WHEN broken THEN target ELSE target || ' -> ' || t_final END AS label FROM l) WHERE code IS NOT NULL GROUP BY final_url, code""")
def link_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.link_issues(linked_pages(spark, sf_dir)).drop("summary")


@query("incoming_links", _LINKED + "SELECT d.final_url, coalesce(c.n, 0) AS incoming FROM (SELECT DISTINCT final_url FROM p) d LEFT JOIN (SELECT t_final AS final_url, count(*) AS n FROM l WHERE src <> t_final GROUP BY t_final) c USING (final_url)")
def incoming_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.incoming_links(linked_pages(spark, sf_dir))


_PRIMARY = "(CASE WHEN coalesce(trim({c}), '') IN ('', 'x-default') THEN NULL ELSE split_part(lower(replace(trim({c}), '_', '-')), '-', 1) END)"


@query("hreflang_issues", _LINKED + f"""SELECT final_url, code, CASE WHEN code = 'HREFLANG_TARGET_LOCALE_MISMATCH' THEN 'medium' ELSE 'low' END AS severity, count(DISTINCT label) AS targets FROM (
SELECT final_url, unnest(list_filter([CASE WHEN t_url = target AND t_final <> target THEN {{'code': 'HREFLANG_TARGET_REDIRECTS', 'label': lang || ': ' || target}} END,
CASE WHEN {_PRIMARY.format(c='lang')} <> t_locale THEN {{'code': 'HREFLANG_TARGET_LOCALE_MISMATCH', 'label': lang || ': ' || t_final}} END,
CASE WHEN source IS NOT NULL AND len(list_filter(t_alt, c -> {_PRIMARY.format(c='c.lang')} = source AND c.url = final_url)) = 0 THEN {{'code': 'HREFLANG_RETURN_MISSING', 'label': lang || ': ' || t_final}} END], x -> x IS NOT NULL), recursive := true)
FROM (SELECT a.final_url, a.lang, a.target, coalesce(a.expected_locale, {_PRIMARY.format(c='a.html_lang')}) AS source, t.url AS t_url, t.final_url AS t_final, coalesce(t.expected_locale, {_PRIMARY.format(c='t.html_lang')}) AS t_locale, t.hreflang AS t_alt
FROM (SELECT final_url, expected_locale, html_lang, h.lang AS lang, CASE WHEN page_id % 2 = 0 THEN final_url ELSE h.url END AS target FROM (SELECT *, unnest(hreflang) AS h FROM p)) a JOIN
(SELECT lk.* REPLACE (list_transform(hreflang, x -> {{'lang': x.lang, 'url': CASE WHEN page_id % 2 = 0 THEN final_url ELSE x.url END}}) AS hreflang) FROM lk) t ON t.key = a.target WHERE a.lang <> 'x-default')) GROUP BY final_url, code""")
def hreflang_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform("hreflang", lambda a: F.struct(a["lang"].alias("lang"), F.when(F.col("page_id") % 2 == 0, F.col("final_url")).otherwise(a["url"]).alias("url")))
    return sitewide.hreflang_issues(linked_pages(spark, sf_dir).withColumn("hreflang", own))


@query("architecture_issues", _LINKED + f""", n AS (SELECT t_final AS final_url, count(*) AS n FROM l WHERE src <> t_final GROUP BY t_final),
r AS (SELECT p.*, coalesce(n.n, 0) AS inc, coalesce(in_sitemap, false) AS listed, canonical IS NOT NULL AND canonical <> final_url AS other, status >= 200 AND status < 400 AND {_HTML} AND NOT list_contains({_CODES}, 'ROBOTS_NOINDEX') AS ok FROM p LEFT JOIN n USING (final_url))
SELECT DISTINCT final_url, code, severity FROM (SELECT final_url, 'SITEMAP_CANONICAL_MISMATCH' AS code, 'medium' AS severity FROM r WHERE listed AND other UNION ALL SELECT final_url, 'SITEMAP_URL_MISSING', 'low' FROM r WHERE ok AND NOT other AND NOT listed
UNION ALL SELECT final_url, 'ORPHAN_CANDIDATE', CASE WHEN listed THEN 'medium' ELSE 'low' END FROM r WHERE ok AND inc = 0 UNION ALL SELECT final_url, 'INTERNAL_LINK_INCOMING_FEW', 'low' FROM r WHERE ok AND inc = 1)""")
def architecture_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.architecture_issues(linked_pages(spark, sf_dir))


_SUM = lambda codes: f"count_if(list_has_any({_CODES}, {codes}))"


@query("site_summary", f"""SELECT lower({_u('final_url', 2)}) AS host, count(*) AS crawled_pages, {', '.join(f"CAST(sum(len(list_filter(issues, i -> i.severity = '{s}'))) AS BIGINT) AS issues_{s}" for s in ('high', 'medium', 'low'))},
{_SUM("['ROBOTS_NOINDEX']")} AS pages_noindex, {_SUM("['TITLE_MISSING']")} AS pages_missing_title, {_SUM("['META_DESCRIPTION_MISSING']")} AS pages_missing_description, CAST(sum(len(discovered_links)) AS BIGINT) AS internal_links_checked,
{_SUM("['INTERNAL_LINK_BROKEN']")} AS pages_broken_links, {_SUM("['INTERNAL_LINK_REDIRECTS', 'INTERNAL_LINK_REDIRECT_CHAIN']")} AS pages_redirecting_links, {_SUM("['INTERNAL_LINK_ANCHOR_EMPTY', 'INTERNAL_LINK_ANCHOR_GENERIC']")} AS pages_anchor_issues,
{_SUM("['INTERNAL_LINK_INCOMING_FEW']")} AS pages_few_incoming, {_SUM("['ORPHAN_CANDIDATE']")} AS orphan_candidates, {_SUM("['SITEMAP_URL_MISSING']")} AS pages_missing_from_sitemap, count_if(len(list_filter({_CODES}, c -> starts_with(c, 'HREFLANG_'))) > 0) AS pages_hreflang_issues FROM pages GROUP BY 1""")
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.site_summary(pages_of(spark, sf_dir).withColumn("host", url_host(F.col("final_url"))), ["host"])


_ISSUES = "(SELECT page_id, final_url, o, u[o] AS i FROM (SELECT page_id, final_url, issues AS u, unnest(generate_series(1, len(issues))) AS o FROM pages))"


@query("top_issues", f'SELECT i.code AS code, count(*) AS "count" FROM {_ISSUES} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5')
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.top_issues(sitewide.page_issues(pages_of(spark, sf_dir)))


@query("issue_catalog", f"SELECT i.code AS code, arg_min(i.severity, page_id * 1000 + o) AS severity, arg_min(i.message, page_id * 1000 + o) AS message, count(*) AS \"count\", count(DISTINCT final_url) AS n_urls FROM {_ISSUES} GROUP BY 1")
def issue_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.issue_catalog(sitewide.page_issues(pages_of(spark, sf_dir)))


@query("issue_urls", f"SELECT DISTINCT i.code AS code, final_url FROM {_ISSUES}")
def issue_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.issue_urls(sitewide.page_issues(pages_of(spark, sf_dir)))


@query("first_issue_per_code", f"SELECT final_url, i.code AS code, i.severity AS severity FROM {_ISSUES} QUALIFY row_number() OVER (PARTITION BY final_url, i.code ORDER BY page_id, o) = 1")
def first_issue_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.first_per_code(sitewide.page_issues(pages_of(spark, sf_dir))).select("final_url", "code", "severity")


@query("first_eligible_pages", f"SELECT final_url FROM pages WHERE status >= 200 AND status < 400 AND {_HTML} ORDER BY page_id LIMIT 10")
def first_eligible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.first_eligible(pages_of(spark, sf_dir), 10)


def traffic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Traffic made from the pages: search metrics for even ids, visits for multiples of three."""
    p = pages_of(spark, sf_dir)
    gsc = p.where("page_id % 2 = 0").groupBy(F.concat(match_url(F.col("final_url")), F.when(F.col("final_url").contains("?"), "&").otherwise("?"), F.lit("utm_source=x")).alias("url")).agg(F.max("title_length").alias("clicks"), F.max(F.col("page_id") % 97).alias("impressions"), F.lit(0.5).alias("ctr"), F.lit(1.0).alias("position"))
    ga4 = p.where("page_id % 3 = 0").groupBy(match_url(F.col("final_url")).alias("url")).agg(F.max("page_id").alias("sessions"), F.lit(0).alias("screen_page_views"), F.lit(0).alias("total_users"), F.lit(0.0).alias("engagement_rate"))
    return gsc, ga4


def _match(c: str) -> str:
    return f"(lower({_u(c, 1)}) || '://' || lower({_u(c, 2)}) || {_path(c)} || {_u(c, 4)})"


def _index(name: str, select: str, where: str) -> str:
    """A table of metrics by URL, and by the URL with its slash toggled where that is free."""
    other = f"CASE WHEN regexp_matches(key, '^[a-z]+://[^/]*/$') THEN NULL WHEN contains(key, '?') THEN NULL WHEN ends_with(key, '/') THEN left(key, length(key) - 1) ELSE key || '/' END"
    return f"{name}0 AS (SELECT {_match('final_url')} AS key, {select} FROM pages WHERE {where} GROUP BY 1), {name} AS (SELECT * FROM {name}0 UNION ALL SELECT {other} AS key, * EXCLUDE (key) FROM {name}0 WHERE {other} NOT IN (SELECT key FROM {name}0))"


_TRAFFIC = f"""WITH {_index('g', 'max(title_length) AS clicks, max(page_id % 97) AS impressions', 'page_id % 2 = 0')}, {_index('v', 'max(page_id) AS sessions', 'page_id % 3 = 0')},
m AS (SELECT p.*, coalesce(g.impressions, 0) AS impressions, coalesce(g.clicks, 0) AS clicks, coalesce(v.sessions, 0) AS sessions FROM pages p LEFT JOIN g ON g.key = {_match('p.final_url')} LEFT JOIN v ON v.key = {_match('p.final_url')})"""


@query("page_traffic", _TRAFFIC + " SELECT page_id, CAST(impressions AS DOUBLE) AS impressions, CAST(clicks AS DOUBLE) AS clicks, CAST(sessions AS DOUBLE) AS sessions FROM m")
def page_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment.with_traffic(pages_of(spark, sf_dir), *traffic(spark, sf_dir))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("page_id", zero("metrics.gsc.impressions").alias("impressions"), zero("metrics.gsc.clicks").alias("clicks"), zero("metrics.ga4.sessions").alias("sessions"))


@query("traffic_matches", _TRAFFIC.replace(", g AS", ", g AS", 1) + " SELECT CAST((SELECT count(*) FROM g0) AS BIGINT) AS total, count_if(m.page_id IS NOT NULL AND EXISTS (SELECT 1 FROM g WHERE g.key = " + _match("m.final_url") + ")) AS matched, greatest(0, (SELECT count(*) FROM g0) - count_if(EXISTS (SELECT 1 FROM g WHERE g.key = " + _match("m.final_url") + "))) AS unmatched FROM m")
def traffic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.match_counts(pages_of(spark, sf_dir), traffic(spark, sf_dir)[0]).select("total", "matched", "unmatched")


@query("priority_issues", _TRAFFIC + """, r AS (SELECT m.*, CASE WHEN impressions > 0 THEN 'gsc' WHEN sessions > 0 THEN 'ga4' END AS ranked_by, CASE WHEN impressions > 0 THEN impressions WHEN sessions > 0 THEN sessions END AS rank_value FROM m),
i AS (SELECT r.*, unnest(generate_series(1, len(issues))) AS o FROM r WHERE ranked_by IS NOT NULL)
SELECT issues[o].code AS code, issues[o].severity AS severity, final_url AS url, ranked_by, CAST(rank_value AS DOUBLE) AS rank_value, CAST(impressions AS DOUBLE) AS impressions, CAST(clicks AS DOUBLE) AS clicks FROM i WHERE issues[o].severity IN ('high', 'medium')
ORDER BY issues[o].severity = 'medium', rank_value DESC, page_id, o LIMIT 10""")
def priority_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitewide.priority_issues(enrichment.with_traffic(pages_of(spark, sf_dir), *traffic(spark, sf_dir)))


# ------------------------------------------------------------------ graph, near-duplicates, words


def supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, linked where one follows another among an order's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    edges = lines.select(F.col("l_suppkey").alias("src"), after.alias("dst")).where("src != dst").distinct()
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), edges


def _rank_sql(edges: str, vertices: str, before: str = "WITH ") -> str:
    """Twenty rounds of rank over ``edges`` (src, dst) and ``vertices`` (id), as r0 to r20."""
    sql = f"""{before}e AS MATERIALIZED ({edges}), v AS MATERIALIZED ({vertices}), g AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM v, n)"""
    for i in range(20):
        sql += f""", r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM g)) / n.n + 0.85::DOUBLE * coalesce(x.s, 0) AS r
FROM r{i} v CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(p.r / g.d) AS s FROM e JOIN g USING (src) JOIN r{i} p ON p.id = e.src GROUP BY e.dst) x ON x.dst = v.id)"""
    return sql


_GRAPH = _rank_sql("SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS dst FROM lineitem) WHERE src <> dst", "SELECT s_suppkey AS id FROM supplier")
_PAGE_EDGES = "SELECT p.page_id AS src, t.dst FROM (SELECT page_id, unnest(discovered_links) AS target FROM p) p JOIN (SELECT final_url, max(page_id) AS dst FROM p GROUP BY final_url) t ON t.final_url = p.target WHERE p.page_id <> t.dst"
_PAGE_RANKS = _rank_sql(_PAGE_EDGES, "SELECT page_id AS id FROM p", _LINKED + ", ")


@query("pagerank", _GRAPH + " SELECT id, round(r / (SELECT sum(r) FROM r20), 9) AS rank FROM r20")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.pagerank(*supply_graph(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


@query("page_ranks", _PAGE_RANKS + " SELECT id AS page_id, round(r / (SELECT sum(r) FROM r20), 9) AS rank FROM r20")
def page_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every page; some link nowhere, so their rank is spread."""
    return linkgraph.page_ranks(linked_pages(spark, sf_dir)).select("page_id", F.round("page_rank", 9).alias("rank"))


@query("top_pages", _PAGE_RANKS + " SELECT p.page_id, p.final_url FROM p JOIN r20 ON r20.id = p.page_id ORDER BY round(r20.r / (SELECT sum(r) FROM r20), 12) DESC, p.page_id LIMIT 10")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = linkgraph.page_ranks(linked_pages(spark, sf_dir)).withColumn("page_rank", F.round("page_rank", 12))
    return linkgraph.top_pages(ranked).select("page_id", "final_url")


@query("underlinked_pages", _PAGE_RANKS + """, w AS (SELECT p.page_id, p.final_url, coalesce(p.word_count, 0) AS wc, p.word_count, round(r20.r / (SELECT sum(r) FROM r20), 12) AS rank FROM p JOIN r20 ON r20.id = p.page_id)
SELECT page_id, final_url, word_count FROM w WHERE word_count > (SELECT median(wc) FROM w) AND rank <= (SELECT median(rank) FROM w) ORDER BY word_count DESC, page_id LIMIT 10""")
def underlinked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = linkgraph.page_ranks(linked_pages(spark, sf_dir)).withColumn("page_rank", F.round("page_rank", 12))
    return linkgraph.underlinked_pages(staged(ranked, "page-ranks")).select("page_id", "final_url", "word_count")


@query("link_edges", _LINKED + "SELECT p.page_id AS src, t.dst FROM (SELECT page_id, unnest(discovered_links) AS target FROM p) p JOIN (SELECT final_url, max(page_id) AS dst FROM p GROUP BY final_url) t ON t.final_url = p.target WHERE p.page_id <> t.dst")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.link_edges(linked_pages(spark, sf_dir))


@query("supplier_components", """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS dst FROM lineitem) WHERE src <> dst), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
c AS (SELECT DISTINCT a AS id, a AS r FROM u UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.id) SELECT id, min(r) AS component FROM c GROUP BY id""")
def supplier_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(supply_graph(spark, sf_dir)[1].toDF("a", "b"))


_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(body_text), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+'), t -> length(t) >= 2)"


@query("minhash_signatures", f"""WITH t AS (SELECT page_id, {_TOKENS} AS t FROM pages WHERE body_text IS NOT NULL), s AS (SELECT DISTINCT page_id, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT page_id, t, unnest(generate_series(1, len(t) - 4)) AS i FROM t WHERE len(t) >= 50)),
h AS (SELECT page_id, j, min(('0x' || left(md5('minhash-salt-' || j || '|' || g), 8))::BIGINT) AS v FROM s, (SELECT unnest(range(128)) AS j) GROUP BY page_id, j) SELECT page_id, list(v ORDER BY j) AS sig FROM h GROUP BY page_id""")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.signatures(pages_of(spark, sf_dir), "page_id", "body_text", "parity").select("page_id", "sig")


@query("near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(pages_of(spark, sf_dir))


_KW = ", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS))
_OCC = lambda c: f"CAST((length(lower(coalesce({c}, ''))) - length(replace(lower(coalesce({c}, '')), lower(keyword), ''))) / length(keyword) AS INTEGER)"
_MATCHES = f"(SELECT final_url, ord, keyword, {_OCC('title')} AS in_title, {_OCC('meta_description')} AS in_meta_description, {_OCC(chr(39).join(['array_to_string(h1s, ', ' ', ')']))} AS in_h1, {_OCC('body_text')} AS in_body FROM pages CROSS JOIN (VALUES {_KW}) k(ord, keyword))"


@query("keyword_matches", f"SELECT final_url, keyword, in_title, in_meta_description, in_h1, in_body, in_title + in_meta_description + in_h1 + in_body AS total FROM {_MATCHES}")
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keyword_matches(pages_of(spark, sf_dir), WORDS).drop("crawl_order", "ord")


@query("keyword_summary", f"SELECT keyword, count_if(in_title + in_meta_description + in_h1 + in_body > 0) AS pages, CAST(sum(in_title + in_meta_description + in_h1 + in_body) AS BIGINT) AS total, CAST(sum(in_title) AS BIGINT) AS in_title, CAST(sum(in_meta_description) AS BIGINT) AS in_meta_description, CAST(sum(in_h1) AS BIGINT) AS in_h1, CAST(sum(in_body) AS BIGINT) AS in_body FROM {_MATCHES} GROUP BY keyword")
def keyword_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keyword_summary(pages_of(spark, sf_dir), WORDS).drop("ord")


@query("keyword_urls", f"SELECT DISTINCT keyword, final_url FROM {_MATCHES} WHERE in_title + in_meta_description + in_h1 + in_body > 0")
def keyword_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keyword_urls(pages_of(spark, sf_dir), WORDS)


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TERM = lambda c, p: f"SELECT final_url, '{p}' AS place, unnest(list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9''\\-]+', ' ', 'g')), ' '), t -> length(t) >= 3 AND NOT list_contains({_STOP}, t))) AS term FROM pages"


_PLACED = " UNION ALL ".join(f"SELECT page_id, {i} AS place_no, generate_subscripts(l, 1) AS pos, unnest(l) AS term FROM (SELECT page_id, string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9''\\-]+', ' ', 'g')), ' ') AS l FROM pages)" for i, c in enumerate(("title", "meta_description", "array_to_string(h1s, ' ')", "body_text")))


@query("term_frequencies", "SELECT term, count(*) AS occurrences, count(DISTINCT final_url) AS pages, " + ", ".join(f"count_if(place = '{p}') AS in_{p}" for p in ("title", "meta_description", "h1", "body")) + " FROM (" + " UNION ALL ".join((_TERM("title", "title"), _TERM("meta_description", "meta_description"), _TERM("array_to_string(h1s, ' ')", "h1"), _TERM("body_text", "body"))) + ") GROUP BY term")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.term_frequencies(pages_of(spark, sf_dir)).drop("first")


@query("top_terms", f"SELECT term, count(*) AS occurrences FROM ({_PLACED}) WHERE length(term) >= 3 AND NOT list_contains({_STOP}, term) GROUP BY term ORDER BY 2 DESC, min((page_id, place_no, pos)) LIMIT 20")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.top_terms(pages_of(spark, sf_dir)).select("term", "occurrences")


@query("sitemap_sample", f"""WITH s AS (SELECT url, list_filter(string_split(lower({_path('url')}), '/'), x -> x <> '') AS g FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)),
u AS (SELECT url, CASE WHEN len(g) = 0 THEN '/' WHEN regexp_matches(g[1], '^[a-z]{{2}}(-[a-z]{{2}})?$') THEN left(g[1], 2) || '/' || coalesce(g[2], '(root)') ELSE g[1] END AS bucket FROM s),
b AS (SELECT bucket, count(*) AS n FROM u GROUP BY bucket), t AS (SELECT count(*) AS k, sum(n) AS total, least(100, sum(n)) - count(*) AS rest, sum(n) - count(*) AS spare FROM b),
w AS (SELECT bucket, n, least(n - 1, (rest * (n - 1)) // spare) AS whole, (rest * (n - 1)) % spare AS rem, rest FROM b, t),
q AS (SELECT bucket, n, CASE WHEN (SELECT k FROM t) > 100 THEN CAST(row_number() OVER (ORDER BY n DESC, bucket) <= 100 AS INTEGER) ELSE 1 + whole + CASE WHEN n > 1 AND row_number() OVER (ORDER BY n > 1 DESC, rem DESC, n DESC, bucket) <= rest - (SELECT sum(whole) FROM w) THEN 1 ELSE 0 END END AS quota FROM w),
i AS (SELECT url, bucket, row_number() OVER (PARTITION BY bucket ORDER BY url) - 1 AS i FROM u), p AS (SELECT bucket, n, quota, unnest(range(CAST(quota AS BIGINT))) AS s FROM q)
SELECT i.url, i.bucket FROM p JOIN i ON i.bucket = p.bucket AND i.i = CAST(floor((s + 0.5) * n / quota) AS BIGINT)""")
def sitemap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled_urls(pages_of(spark, sf_dir).select("url"), 100)


@query("schema_coverage", f"""SELECT count_if(regexp_matches({_path('final_url')}, '(?i)/(blog|posts?|news|articles?)(/|$)')) AS article_like, count_if(regexp_matches({_path('final_url')}, '(?i)/(blog|posts?|news|articles?)(/|$)') AND list_has_any(schema_types, ['Article', 'BlogPosting', 'NewsArticle'])) AS article_with_schema,
coalesce(bool_or(lower({_u('final_url', 2)}) = 'fernhollow-market.example' AND rtrim({_path('final_url')}, '/') = ''), false) AS home_crawled, false AS home_has_organization FROM pages""")
def schema_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.schema_coverage(pages_of(spark, sf_dir), SITE + "/")


_AGENT_ROBOTS = "User-agent: GPTBot\nDisallow: /\nUser-agent: CCBot\nAllow: /\nContent-Signal: search=yes, ai-train=disallow"


@query("agent_readiness", f"""WITH c AS (SELECT count(*) AS likes, count_if(list_has_any(schema_types, ['Article', 'BlogPosting', 'NewsArticle'])) AS typed FROM pages WHERE regexp_matches({_path('final_url')}, '(?i)/(blog|posts?|news|articles?)(/|$)')),
s AS (SELECT 85 AS discoverability, 85 AS content, 40 AS bot_access, 10 + CASE WHEN likes > 0 THEN CAST(floor(typed * 25.0 / likes + 0.5) AS INTEGER) ELSE 25 END AS capabilities FROM c)
SELECT unnest(['discoverability', 'content', 'bot_access', 'capabilities', 'total']) AS area, unnest([discoverability, content, bot_access, capabilities, CAST(floor((discoverability + content + bot_access + capabilities) / 4.0 + 0.5) AS INTEGER)]) AS score FROM s""")
def agent_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a site with two named agents, two signals, a full llms.txt, an API catalog and Web bot authentication."""
    cover = agents.schema_coverage(pages_of(spark, sf_dir), SITE + "/none").first().asDict() | {"home_has_organization": False}
    got = agents.readiness(_AGENT_ROBOTS, "# T\n## S\n[a](b)\n" + "x" * 200, cover, {"api-catalog": True, "web-bot-auth": True, "markdown": False}, llms_full=True)
    return spark.createDataFrame([(k, int(got[k])) for k in ("discoverability", "content", "bot_access", "capabilities", "total")], "area string, score int")


_ARTICLE = f"regexp_matches({_path('final_url')}, '(?i)/(blog|posts?|news|articles?)(/|$)')"
_TYPED = "coalesce(list_has_any(schema_types, ['Article', 'BlogPosting', 'NewsArticle']), false)"
_READY = f"""WITH s AS (SELECT lower({_u('final_url', 2)}) AS site, min(page_id) AS k, count_if({_ARTICLE}) AS likes, count_if({_ARTICLE} AND {_TYPED}) AS typed FROM pages WHERE final_url IS NOT NULL GROUP BY 1),
f AS (SELECT *, k % 3 > 0 AS robots, k % 3 = 2 AS named, k % 5 > 0 AS llms, k % 5 IN (1, 3, 4) AS h1, k % 5 IN (2, 3, 4) AS sections, k % 5 IN (2, 4) AS links, k % 5 = 4 AS large, k % 2 = 0 AS home, k % 4 = 0 AS org, CASE WHEN likes > 0 THEN CAST(floor(typed * 25.0 / likes + 0.5) AS INTEGER) ELSE 25 END AS typed_score FROM s),
r AS (SELECT site, likes, typed, named, llms, h1, sections, links, large, home, org, 50 * robots::INT + 35 * (k % 2 = 1)::INT + 15 * (k % 7 = 0)::INT AS discoverability, llms::INT * (30 + 10 * (h1::INT + sections::INT + links::INT + large::INT)) + 15 * (k % 7 = 1)::INT AS content,
  CASE WHEN named THEN 30 ELSE 0 END + 10 * (k % 11 = 0)::INT AS bot_access, 20 * (k % 2 = 0)::INT + 25 * org::INT + typed_score AS capabilities FROM f)
"""


def ready_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with files and coverage that follow from their least ``page_id``."""
    k = lambda n: F.col("k") % n
    path = url_path(F.col("final_url"))
    article = path.rlike(agents.ARTICLE_PATH)
    typed = F.coalesce(F.arrays_overlap("schema_types", F.array(*map(F.lit, agents.ARTICLE_TYPES))), F.lit(False))
    sites = pages_of(spark, sf_dir).where("final_url is not null").groupBy(url_host(F.col("final_url")).alias("site")).agg(F.min("page_id").alias("k"), F.count_if(article).alias("article_like"), F.count_if(article & typed).alias("article_with_schema"))
    heading, section, link = F.when(k(5).isin(1, 3, 4), "# T\n").otherwise(""), F.when(k(5).isin(2, 3, 4), " ## S\n").otherwise(""), F.when(k(5).isin(2, 4), '[a](b "c")').otherwise("")
    half = "".join(f"User-agent: {a}\nDisallow: /x\n" for a in agents.AI_AGENTS[:6]) + "Content-Signals: search=allow, ai-train=no, ai-input=TRUE\n"
    return sites.select(
        "site", F.when(k(3) == 1, "User-agent: *\nDisallow:").when(k(3) == 2, half).alias("robots_text"), F.when(k(5) > 0, F.concat(heading, section, link, F.when(k(5) == 4, "x" * 200).otherwise("text"))).alias("llms_text"),
        F.create_map(F.lit("api-catalog"), k(2) == 0, F.lit("mcp/server-card.json"), k(2) == 0, F.lit("web-bot-auth"), k(11) == 0).alias("probes"), (k(2) == 1).alias("sitemap"), (k(7) == 0).alias("link_header"), (k(7) == 1).alias("llms_full"),
        "article_like", "article_with_schema", (k(2) == 0).alias("home_crawled"), (k(4) == 0).alias("home_has_organization"),
    )


@query("site_readiness", _READY + " SELECT site, discoverability, content, least(100, bot_access + CASE WHEN named THEN 30 ELSE 0 END) AS bot_access, capabilities, CAST(floor((discoverability + content + least(100, bot_access + CASE WHEN named THEN 30 ELSE 0 END) + capabilities) / 4.0 + 0.5) AS INTEGER) AS total FROM r")
def site_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.site_readiness(ready_sites(spark, sf_dir)).drop("codes")


@query("site_agent_issues", _READY + """ SELECT site, unnest(list_filter([CASE WHEN NOT named THEN 'AGENT_NO_EXPLICIT_AI_POLICY' END, CASE WHEN llms AND NOT h1 THEN 'AGENT_LLMSTXT_NO_H1' END, CASE WHEN llms AND NOT sections THEN 'AGENT_LLMSTXT_NO_SECTIONS' END,
CASE WHEN llms AND NOT links THEN 'AGENT_LLMSTXT_NO_LINKS' END, CASE WHEN llms AND NOT large THEN 'AGENT_LLMSTXT_TOO_SMALL' END, CASE WHEN likes > 0 AND typed = 0 THEN 'AGENT_ARTICLES_NO_SCHEMA' END, CASE WHEN home AND NOT org THEN 'AGENT_HOMEPAGE_NO_ORG' END], x -> x IS NOT NULL)) AS code FROM r""")
def site_agent_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.site_readiness(ready_sites(spark, sf_dir)).select("site", F.explode("codes").alias("code"))


# ------------------------------------------------------------------ logs


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "log_hits")
    return hits.select("ip", F.date_format(F.col("received_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "method", "url", "status", "user_agent")


def bot_rows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return logs.bot_hits(hits_of(spark, sf_dir), SITE, bots=BOTS, **options)


_HITS = f"""WITH h AS (SELECT ip, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9_+.\\-]*://') THEN url WHEN starts_with(url, '/') THEN '{SITE}' || url ELSE '{SITE}/' || url END AS url, status,
CASE {' '.join(f"WHEN regexp_matches(user_agent, '(?i){p}') THEN '{n}'" for n, p in BOTS)} END AS bot FROM log_hits WHERE url <> ''), b AS (SELECT * FROM h WHERE bot IS NOT NULL)"""


@query("bot_hits_between", _HITS + " SELECT bot, count(*) AS hits FROM b WHERE timestamp >= '2026-01-01T00:00:00Z' AND timestamp < '2026-02-01T00:00:00Z' GROUP BY bot")
def bot_hits_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bot_rows(spark, sf_dir, since="2026-01-01T00:00:00Z", until="2026-02-01T00:00:00Z").groupBy("bot").agg(F.count(F.lit(1)).alias("hits"))


@query("log_urls", _HITS + """, s AS (SELECT url, status, count(*) AS n FROM b WHERE status IS NOT NULL GROUP BY url, status) SELECT url, count(*) AS hits, list_sort(list(DISTINCT bot)) AS bots, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
coalesce((SELECT string_agg(s.status || ':' || s.n, ',' ORDER BY s.status) FROM s WHERE s.url = b.url), '') AS statuses FROM b GROUP BY url""")
def log_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.url_aggregates(bot_rows(spark, sf_dir)).select("url", "hits", "bots", "first_seen", "last_seen", F.array_join(F.transform(F.array_sort(F.map_entries("status_counts")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("statuses"))


@query("log_bots", _HITS + " SELECT bot, count(*) AS hits, count(DISTINCT url) AS unique_urls, count(DISTINCT ip) AS unique_ips FROM b GROUP BY bot")
def log_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bot_aggregates(bot_rows(spark, sf_dir))


@query("log_window", _HITS + " SELECT min(timestamp) AS earliest, max(timestamp) AS latest, CAST(floor((epoch(max(timestamp)::TIMESTAMP) - epoch(min(timestamp)::TIMESTAMP)) / 3600 + 0.5) AS BIGINT) AS duration_hours FROM b")
def log_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.time_window(bot_rows(spark, sf_dir))


def dns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for the addresses in the log: a third genuine, a third with a foreign name, a third none."""
    last = F.regexp_extract("ip", r"(\d+)$", 1).try_cast("int")
    ips = hits_of(spark, sf_dir).select("ip").distinct().where(last.isNotNull() & (last % 3 < 2))
    name = F.when(last % 3 == 0, F.lit("crawl.otterbot.example")).otherwise(F.lit("host.else.example"))
    return ips.select("ip", F.array(name).alias("ptr"), F.array("ip").alias("forward"))


@query("log_verdicts", _HITS + r""" SELECT bot, verdict, count(*) AS hits FROM (SELECT bot, CASE WHEN bot <> 'otter' THEN 'verified' WHEN try_cast(regexp_extract(ip, '(\d+)$', 1) AS INTEGER) % 3 = 0 THEN 'verified' WHEN try_cast(regexp_extract(ip, '(\d+)$', 1) AS INTEGER) % 3 = 1 THEN 'spoofed' ELSE 'unverified' END AS verdict FROM b) GROUP BY bot, verdict""")
def log_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.verified_hits(bot_rows(spark, sf_dir), dns_of(spark, sf_dir), {"otter": (".otterbot.example",)}).groupBy("bot", "verdict").agg(F.count(F.lit(1)).alias("hits"))


def log_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the logged URLs of which every fifth is unknown, with status 200 where the first letters of its hash are low."""
    urls = logs.url_aggregates(bot_rows(spark, sf_dir)).select("url").where(F.length("url") % 5 != 0)
    return urls.select("url", F.col("url").alias("final_url"), F.when(F.length("url") % 2 == 0, 200).otherwise(404).alias("status"), F.lit(1).alias("crawl_order"))


_LOGGED = _HITS + ", a AS (SELECT url, count(*) AS hits, max(CASE WHEN status >= 400 THEN status END) AS worst, max(timestamp) AS last_seen FROM b GROUP BY url), k AS (SELECT url FROM a WHERE length(url) % 5 <> 0)"


@query("log_orphans", _LOGGED + " SELECT url, hits FROM a WHERE url NOT IN (SELECT url FROM k) ORDER BY hits DESC, url LIMIT 200")
def log_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.orphans(logs.url_aggregates(bot_rows(spark, sf_dir)), log_crawl(spark, sf_dir)).select("url", "hits")


@query("log_mismatches", _LOGGED + " SELECT a.url, a.worst AS worst_status, count(*) AS hits FROM a JOIN k USING (url) JOIN b ON b.url = a.url AND b.status = a.worst WHERE length(a.url) % 2 = 0 AND a.worst IS NOT NULL GROUP BY a.url, a.worst ORDER BY 3 DESC, 1 LIMIT 200")
def log_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.status_mismatches(logs.url_aggregates(bot_rows(spark, sf_dir)), log_crawl(spark, sf_dir)).select("url", "worst_status", "hits")


@query("log_stale", _LOGGED + """, r AS (SELECT url, length(url) AS page_rank FROM k ORDER BY length(url) DESC, url LIMIT 100) SELECT r.url, CAST(floor((epoch('2026-04-01'::TIMESTAMP) - epoch(a.last_seen::TIMESTAMP)) / 86400 + 0.5) AS BIGINT) AS days_since, a.hits FROM r JOIN a USING (url)
WHERE floor((epoch('2026-04-01'::TIMESTAMP) - epoch(a.last_seen::TIMESTAMP)) / 86400 + 0.5) > 30""")
def log_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = log_crawl(spark, sf_dir).select("url", F.length("url").cast("double").alias("page_rank"), F.col("url").alias("crawl_order"))
    return logs.stale_priorities(logs.url_aggregates(bot_rows(spark, sf_dir)), ranked, "2026-04-01").select("url", "days_since", "hits")


_COMBINED = "^(\\S+) \\S+ \\S+ \\[([^\\]]+)\\] \"(\\S+) (.*?) HTTP/[0-9.]+\" (\\d+) \\S+ \"[^\"]*\" \"([^\"]*)\"$"


_AT = f"strptime(left(regexp_extract(raw, '{_COMBINED}', 2), 20), '%d/%b/%Y:%H:%M:%S')"
_OFF = f"right(regexp_extract(raw, '{_COMBINED}', 2), 5)"


@query("parsed_combined", f"SELECT regexp_extract(raw, '{_COMBINED}', 1) AS ip, strftime({_AT}, '%Y-%m-%dT%H:%M:%S') || left({_OFF}, 3) || ':' || right({_OFF}, 2) AS timestamp, regexp_extract(raw, '{_COMBINED}', 3) AS method, regexp_extract(raw, '{_COMBINED}', 4) AS url, CAST(regexp_extract(raw, '{_COMBINED}', 5) AS INTEGER) AS status, regexp_extract(raw, '{_COMBINED}', 6) AS user_agent FROM log_lines WHERE regexp_matches(raw, '{_COMBINED}')")
def parsed_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_lines(table(spark, sf_dir, "log_lines"), "combined", "raw")


def _json_sql(layout: str) -> str:
    names = logs.LAYOUTS[layout]
    text = lambda n: f"CASE WHEN json_type(j, '$.{n}') = 'VARCHAR' THEN j->>'$.{n}' ELSE '' END"
    return f"SELECT {', '.join(f'{text(n)} AS {f}' for n, f in zip(names, logs.FIELDS) if f != 'status')}, TRY_CAST(regexp_extract(coalesce(j->>'$.{names[4]}', ''), '^\\s*([+-]?\\d+)', 1) AS INTEGER) AS status FROM (SELECT TRY_CAST(raw AS JSON) AS j FROM log_lines WHERE starts_with(raw, '{{')) WHERE json_type(j) = 'OBJECT'"


def _json_query(layout: str) -> None:
    query(f"parsed_{layout}", _json_sql(layout))(lambda spark, sf_dir: logs.parse_lines(table(spark, sf_dir, "log_lines"), layout, "raw"))


for _layout in logs.LAYOUTS:
    _json_query(_layout)


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream that ends with it."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if _is_dir(f"{sf_dir}/{name}.parquet") else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _stream_hours(spark: SparkSession, hits: DataFrame, name: str) -> DataFrame:
    """Hourly windows of a stream of hits under a watermark that covers the table's disorder, until the input ends."""
    out = f"{shared_dir(spark)}/{name}_{datetime.datetime.now().timestamp():.6f}".replace(".", "_")
    windows = streams.windowed_hits(hits, "1 hour", "3650 days")
    done = windows.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "bot", "hits")


@query("stream_event_hours", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS bot, count(*) AS hits FROM events GROUP BY 1, 2")
def stream_event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_hours(spark, _streamed(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("bot")), "event_hours")


_UTC = f"({_AT} - to_minutes(CAST(left({_OFF}, 1) || '1' AS INTEGER) * (60 * CAST({_OFF}[2:3] AS INTEGER) + CAST(right({_OFF}, 2) AS INTEGER))))"


@query("stream_bot_hours", f"""WITH l AS (SELECT time_bucket(INTERVAL 1 HOUR, {_UTC}) AS start, CASE {' '.join(f"WHEN regexp_matches(regexp_extract(raw, '{_COMBINED}', 6), '(?i){p}') THEN '{n}'" for n, p in BOTS)} END AS bot FROM log_lines WHERE regexp_matches(raw, '{_COMBINED}') AND regexp_extract(raw, '{_COMBINED}', 4) <> '')
SELECT start, bot, count(*) AS hits FROM l WHERE bot IS NOT NULL GROUP BY 1, 2""")
def stream_bot_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines as a stream: parsed, attributed to bots, counted by the hour."""
    lines = _streamed(spark, sf_dir, "log_lines").select(F.col("raw").alias("value"))
    return _stream_hours(spark, streams.stream_bot_hits(lines, "combined", SITE, BOTS), "bot_hours")


@query("stream_sessions", """WITH e AS (SELECT ts, event_type AS bot, CAST(user_id AS VARCHAR) AS ip, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY bot, ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", bot, ip, count(*) AS hits FROM g GROUP BY bot, ip, g""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits on a stream: events of one type and user without a pause of half an hour."""
    hits = _streamed(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("bot"), F.col("user_id").cast("string").alias("ip"))
    out = f"{shared_dir(spark)}/sessions_{datetime.datetime.now().timestamp():.6f}".replace(".", "_")
    done = streams.sessions(hits, "30 minutes", "3650 days").writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    done.awaitTermination()
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.parquet(out).select(plain("start"), plain("end"), "bot", "ip", "hits")


def _is_dir(path: str) -> bool:
    import os

    return os.path.isdir(path)


# ------------------------------------------------------------------ history and differences


def first_and_last(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last snapshot of every site, as pages of two crawls."""
    rows = table(spark, sf_dir, "crawl_history").select("host", "crawled_at", F.col("page_url").alias("final_url"), "status", "codes", F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("crawl_order"))
    ends = rows.groupBy("host").agg(F.min("crawled_at").alias("a"), F.max("crawled_at").alias("z"))
    rows = rows.join(ends, "host").withColumn("issues", F.transform(F.coalesce("codes", F.array().cast("array<string>")), lambda c: F.struct(c.alias("code"))))
    return rows.where("crawled_at = a"), rows.where("crawled_at = z")


_ENDS = "WITH x AS (SELECT host, min(crawled_at) AS a, max(crawled_at) AS z FROM crawl_history GROUP BY host), o AS (SELECT h.* FROM crawl_history h JOIN x ON h.host = x.host AND h.crawled_at = x.a), n AS (SELECT h.* FROM crawl_history h JOIN x ON h.host = x.host AND h.crawled_at = x.z)"


@query("diff_pages", _ENDS + " SELECT DISTINCT page_url AS url, 'added' AS change FROM n WHERE page_url NOT IN (SELECT page_url FROM o) UNION ALL SELECT DISTINCT page_url, 'removed' FROM o WHERE page_url NOT IN (SELECT page_url FROM n)")
def diff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.page_set_diff(*first_and_last(spark, sf_dir))


@query("diff_common", _ENDS + " SELECT count(*) AS common FROM (SELECT page_url FROM o INTERSECT SELECT page_url FROM n)")
def diff_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.common_pages(*first_and_last(spark, sf_dir)).agg(F.count(F.lit(1)).alias("common"))


@query("diff_issues", _ENDS + """, a AS (SELECT code, count(*) AS old_count FROM (SELECT unnest(codes) AS code FROM o) GROUP BY code), b AS (SELECT code, count(*) AS new_count FROM (SELECT unnest(codes) AS code FROM n) GROUP BY code)
SELECT coalesce(a.code, b.code) AS code, coalesce(old_count, 0) AS old_count, coalesce(new_count, 0) AS new_count, CASE WHEN old_count IS NULL THEN 'new' WHEN new_count IS NULL THEN 'resolved' WHEN new_count > old_count THEN 'increased' WHEN new_count < old_count THEN 'decreased' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.code = b.code""")
def diff_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.issue_deltas(*first_and_last(spark, sf_dir))


@query("diff_status", _ENDS + """, c AS (SELECT page_url AS url, arg_max_null(status, delivered_at) AS s FROM o GROUP BY 1), d AS (SELECT page_url AS url, arg_max_null(status, delivered_at) AS s FROM n GROUP BY 1) SELECT url, c.s AS old_status, d.s AS new_status FROM c JOIN d USING (url) WHERE c.s IS DISTINCT FROM d.s""")
def diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.status_changes(*first_and_last(spark, sf_dir))


@query("recent_crawls", "SELECT host, crawled_at, count(*) AS n FROM crawl_history JOIN (SELECT host, crawled_at FROM (SELECT DISTINCT host, crawled_at FROM crawl_history) QUALIFY row_number() OVER (PARTITION BY host ORDER BY crawled_at DESC) <= 2) USING (host, crawled_at) GROUP BY 1, 2")
def latest_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_crawls(table(spark, sf_dir, "crawl_history"), 2).groupBy("host", "crawled_at").agg(F.count(F.lit(1)).alias("n"))


@query("full_audit")
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages through the whole audit: issues by code."""
    return audit(captures(spark, sf_dir), SITE + "/").issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_matches", f"SELECT page_id, {_norm('final_url')} AS key FROM pages WHERE NOT ends_with({_path('final_url')}, '/') AND {_u('final_url', 4)} = ''")
def canonical_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(spark, sf_dir).select("page_id", match_url(F.concat("final_url", F.lit("?utm_medium=mail&gclid=7"))).alias("key"), url_path(F.col("final_url")).alias("path"), F.col("final_url").contains("?").alias("q")).where(~F.col("path").endswith("/") & ~F.col("q")).select("page_id", "key")


@query("summarized_links", r"""SELECT page_id, CASE WHEN len(d) = 0 THEN 'none' ELSE array_to_string(list_transform(d[1:3], v -> CASE WHEN length(v) <= 90 THEN v ELSE left(v, 89) || '…' END), ', ') || CASE WHEN len(d) > 3 THEN ', +' || (len(d) - 3) || ' more' ELSE '' END END AS summary
FROM (SELECT page_id, list_sort(list_distinct(list_transform(issues, i -> i.message))) AS d FROM pages)""")
def summarized_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = F.array_sort(F.array_distinct(F.transform("issues", lambda i: i["message"])))
    return pages_of(spark, sf_dir).select("page_id", summarized(messages).alias("summary"))
