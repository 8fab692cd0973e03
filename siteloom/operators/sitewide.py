"""Operators over all pages of a crawl: duplicates, links, hreflang, sitemap, summary, priorities.

``pages`` is the table of audit rows (one per fetched page). A site is what a call is given; to
audit many sites at once pass ``by`` columns that tell them apart, and every join, rank and count
is made within them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.text import duplicate_key, summarized
from siteloom.functions.url import primary_lang

By = Sequence[str]


def page_issues(pages: DataFrame, by: By = ()) -> DataFrame:
    """The long table of issues: ``by, final_url, crawl_order, ord, code, severity, message, recommendation``."""
    return pages.select(*by, "final_url", "crawl_order", F.posexplode("issues").alias("ord", "i")).select(*by, "final_url", "crawl_order", "ord", "i.*")


def first_per_code(issues: DataFrame, by: By = ()) -> DataFrame:
    """Of several issues of one code on one page, the first."""
    rank = F.row_number().over(Window.partitionBy(*by, "final_url", "code").orderBy("crawl_order", "ord"))
    return issues.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def has_code(*codes: str) -> Column:
    """Whether a page has one of the codes."""
    return F.arrays_overlap(F.transform(F.coalesce("issues", F.array().cast("array<struct<code:string,severity:string,message:string,recommendation:string>>")), lambda i: i["code"]), F.array(*map(F.lit, codes)))


def is_indexable() -> Column:
    """A fetched HTML page whose robots meta doesn't forbid indexing."""
    html = F.lower(F.coalesce("content_type", F.lit(""))).rlike("text/html|application/xhtml")
    return (F.col("status") >= 200) & (F.col("status") < 400) & html & ~has_code("ROBOTS_NOINDEX")


def _keyed(pages: DataFrame, column: str, by: By) -> DataFrame:
    return pages.where(F.col(column).isNotNull() & (F.col(column) != "")).select(*by, "final_url", "crawl_order", F.col(column).alias("value"), F.xxhash64(duplicate_key(F.col(column))).alias("key"))


def _groups(named: DataFrame, by: By) -> DataFrame:
    return named.groupBy(*by, "key").agg(F.min_by("value", "crawl_order").alias("value"), F.count(F.lit(1)).alias("count")).where("count > 1")


def duplicate_groups(pages: DataFrame, column: str, by: By = ()) -> DataFrame:
    """Values that several pages share: ``by, value, count``. The value is spelled as on the first page; ``duplicate_members`` has the pages."""
    return _groups(_keyed(pages, column, by), by).select(*by, "value", "count")


def duplicate_members(pages: DataFrame, column: str, by: By = ()) -> DataFrame:
    """``by, value, final_url``: every page of every group, one row each, so no group is held in one row or task."""
    named = _keyed(pages, column, by)
    return named.drop("value").join(_groups(named, by), [*by, "key"]).select(*by, "value", "final_url")


def duplicate_issues(pages: DataFrame, column: str, code: str, severity: str, by: By = ()) -> DataFrame:
    """One issue per page whose value others share: ``by, final_url, code, severity, group_size``.

    Group sizes come from an aggregation joined back by hash of the value, not from a window, so a
    value that a third of the pages share isn't sorted in one task.
    """
    named = pages.where(F.col(column).isNotNull() & (F.col(column) != "")).select(*by, "final_url", F.xxhash64(duplicate_key(F.col(column))).alias("key"))
    groups = named.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return named.join(groups, [*by, "key"]).select(*by, "final_url", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "group_size").distinct()


def page_lookup(pages: DataFrame, by: By = ()) -> DataFrame:
    """``by, key, page``: what a link target finds. The requested URL wins over the final one; of several pages with a key the last crawled."""
    html = F.array().cast("array<struct<lang:string,url:string>>")
    page = F.struct(
        "url", "final_url", F.coalesce(F.size("redirect_chain"), F.lit(0)).alias("hops"), has_code("HTTP_ERROR", "FETCH_FAILED").alias("broken"),
        F.coalesce("expected_locale", primary_lang(F.col("html_lang"))).alias("locale"), F.coalesce("hreflang", html).alias("hreflang"),
    )
    keys = F.array(F.struct(F.col("url").alias("key"), F.lit(1).alias("prio")), F.struct(F.col("final_url").alias("key"), F.lit(0).alias("prio")))
    # the struct is named before rows are doubled: a generator in its own select loses the names
    both = pages.select(*by, "crawl_order", keys.alias("keys"), page.alias("page")).select(*by, F.explode("keys").alias("k"), "crawl_order", "page").where("k.key is not null")
    return both.groupBy(*by, F.col("k.key").alias("key")).agg(F.max_by("page", F.struct("k.prio", "crawl_order")).alias("page"))


def resolved_links(pages: DataFrame, by: By = ()) -> DataFrame:
    """Links to pages of the crawl: ``by, src, target, page``."""
    links = pages.select(*by, F.col("final_url").alias("src"), F.col("crawl_order").alias("src_order"), F.explode("discovered_links").alias("target"))
    return links.join(page_lookup(pages, by).withColumnRenamed("key", "target"), [*by, "target"])


def link_issues(pages: DataFrame, by: By = ()) -> DataFrame:
    """Links to broken or redirecting pages: ``by, final_url, code, severity, targets, summary``."""
    links = resolved_links(pages, by)
    redirects = (F.col("page.url") == F.col("target")) & (F.col("page.final_url") != F.col("target"))
    code = F.when(F.col("page.broken"), "INTERNAL_LINK_BROKEN").when(redirects & (F.col("page.hops") > 1), "INTERNAL_LINK_REDIRECT_CHAIN").when(redirects, "INTERNAL_LINK_REDIRECTS")
    label = F.when(F.col("page.broken"), F.col("target")).otherwise(F.concat("target", F.lit(" -> "), "page.final_url"))
    found = links.select(*by, F.col("src").alias("final_url"), code.alias("code"), label.alias("label")).where("code is not null")
    per = found.groupBy(*by, "final_url", "code").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return per.select(*by, "final_url", "code", F.when(F.col("code") == "INTERNAL_LINK_REDIRECTS", "low").otherwise("medium").alias("severity"), F.size("labels").alias("targets"), summarized(F.col("labels")).alias("summary"))


def hreflang_issues(pages: DataFrame, by: By = ()) -> DataFrame:
    """Alternates that redirect, are of another language, or don't link back: ``by, final_url, code, severity, targets``."""
    source = F.coalesce("expected_locale", primary_lang(F.col("html_lang")))
    alternates = pages.select(*by, "final_url", source.alias("source"), F.explode("hreflang").alias("alt")).select(*by, "final_url", "source", "alt.lang", F.col("alt.url").alias("target")).where("lang != 'x-default'")
    found = alternates.join(page_lookup(pages, by).withColumnRenamed("key", "target"), [*by, "target"])
    redirect = (F.col("page.url") == F.col("target")) & (F.col("page.final_url") != F.col("target"))
    other = primary_lang(F.col("lang")) != F.col("page.locale")
    back = F.exists("page.hreflang", lambda c: (primary_lang(c["lang"]) == F.col("source")) & (c["url"] == F.col("final_url")))
    codes = F.array_compact(
        F.array(
            F.when(redirect, F.struct(F.lit("HREFLANG_TARGET_REDIRECTS").alias("code"), F.concat("lang", F.lit(": "), "target").alias("label"))),
            F.when(other, F.struct(F.lit("HREFLANG_TARGET_LOCALE_MISMATCH").alias("code"), F.concat("lang", F.lit(": "), "page.final_url").alias("label"))),
            F.when(F.col("source").isNotNull() & ~F.coalesce(back, F.lit(False)), F.struct(F.lit("HREFLANG_RETURN_MISSING").alias("code"), F.concat("lang", F.lit(": "), "page.final_url").alias("label"))),
        )
    )
    per = found.select(*by, "final_url", F.explode(codes).alias("c")).groupBy(*by, "final_url", F.col("c.code").alias("code")).agg(F.count_distinct("c.label").alias("targets"))
    return per.select(*by, "final_url", "code", F.when(F.col("code") == "HREFLANG_TARGET_LOCALE_MISMATCH", "medium").otherwise("low").alias("severity"), "targets")


def incoming_links(pages: DataFrame, by: By = ()) -> DataFrame:
    """``by, final_url, incoming``: links from other pages, redirects resolved; pages without are 0."""
    counts = resolved_links(pages, by).where(F.col("src") != F.col("page.final_url")).groupBy(*by, F.col("page.final_url").alias("final_url")).agg(F.count(F.lit(1)).alias("incoming"))
    return pages.select(*by, "final_url").distinct().join(counts, [*by, "final_url"], "left").na.fill(0, ["incoming"])


def in_sitemap(pages: DataFrame, sitemap: DataFrame, by: By = ()) -> DataFrame:
    """``pages`` with ``in_sitemap`` set from ``sitemap(by, url)``: its URL or its final URL is listed."""
    known = sitemap.select(*by, F.col("url").alias("_listed")).distinct()
    keys = pages.select(*by, "url", "final_url").distinct().withColumn("_listed", F.explode(F.array_distinct(F.array("url", "final_url"))))
    hit = keys.join(known, [*by, "_listed"], "left_semi").select(*by, "url", "final_url").distinct().withColumn("_in", F.lit(True))
    return pages.join(hit, [*by, "url", "final_url"], "left").withColumn("in_sitemap", F.coalesce("_in", F.lit(False))).drop("_in")


def architecture_issues(pages: DataFrame, start_url: str | None = None, sitemap_known: bool = True, sitemap_limited: bool = False, crawl_limited: bool = False, by: By = ()) -> DataFrame:
    """Sitemap and link-architecture issues from ``in_sitemap`` and the incoming links: ``by, final_url, code, severity``."""
    rows = pages.join(incoming_links(pages, by), [*by, "final_url"])
    listed = F.coalesce("in_sitemap", F.lit(False))
    other = F.col("canonical").isNotNull() & (F.col("canonical") != F.col("final_url"))
    start = F.lit(False) if start_url is None else (F.col("final_url") == start_url) | (F.col("url") == start_url)
    linkable = F.lit(not crawl_limited) & ~start & is_indexable()
    issue = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), severity.alias("severity")))
    codes = F.array_compact(
        F.array(
            issue(listed & other, "SITEMAP_CANONICAL_MISMATCH", F.lit("medium")),
            issue(F.lit(sitemap_known and not sitemap_limited) & is_indexable() & ~other & ~listed, "SITEMAP_URL_MISSING", F.lit("low")),
            issue(linkable & (F.col("incoming") == 0), "ORPHAN_CANDIDATE", F.when(listed, "medium").otherwise("low")),
            issue(linkable & (F.col("incoming") == 1), "INTERNAL_LINK_INCOMING_FEW", F.lit("low")),
        )
    )
    return rows.select(*by, "final_url", F.explode(codes).alias("c")).select(*by, "final_url", "c.*").distinct()


def severity_totals(issues: DataFrame, by: By = ()) -> DataFrame:
    return issues.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


def top_issues(issues: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent codes, ties by code."""
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "code").limit(n)


def _of_severity(severity: str) -> Column:
    return F.size(F.filter("issues", lambda i: i["severity"] == severity))


def site_summary(pages: DataFrame, by: By = ()) -> DataFrame:
    """The counters of a crawl, in one pass over its pages."""
    count = lambda cond, name: F.count_if(cond).alias(name)
    codes = F.transform("issues", lambda i: i["code"])
    return pages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("crawled_pages"),
        *[F.coalesce(F.sum(_of_severity(s)), F.lit(0)).cast("long").alias(f"issues_{s}") for s in ("high", "medium", "low")],
        count(has_code("ROBOTS_NOINDEX"), "pages_noindex"), count(has_code("TITLE_MISSING"), "pages_missing_title"), count(has_code("META_DESCRIPTION_MISSING"), "pages_missing_description"),
        F.coalesce(F.sum(F.when(F.col("discovered_links").isNotNull(), F.size("discovered_links"))), F.lit(0)).cast("long").alias("internal_links_checked"),
        count(has_code("INTERNAL_LINK_BROKEN"), "pages_broken_links"), count(has_code("INTERNAL_LINK_REDIRECTS", "INTERNAL_LINK_REDIRECT_CHAIN"), "pages_redirecting_links"),
        count(has_code("INTERNAL_LINK_ANCHOR_EMPTY", "INTERNAL_LINK_ANCHOR_GENERIC"), "pages_anchor_issues"), count(has_code("INTERNAL_LINK_INCOMING_FEW"), "pages_few_incoming"),
        count(has_code("ORPHAN_CANDIDATE"), "orphan_candidates"), count(has_code("SITEMAP_URL_MISSING"), "pages_missing_from_sitemap"), count(F.exists(codes, lambda c: c.startswith("HREFLANG_")), "pages_hreflang_issues"),
    )


def issue_catalog(issues: DataFrame) -> DataFrame:
    """Per code: severity and message of its first issue, its count, and on how many URLs; high severities first. ``issue_urls`` has the URLs."""
    first = F.struct("crawl_order", "ord")
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    codes = issues.groupBy("code").agg(F.min_by("severity", first).alias("severity"), F.min_by("message", first).alias("message"), F.count(F.lit(1)).alias("count"))
    urls = issue_urls(issues).groupBy("code").agg(F.count(F.lit(1)).alias("n_urls"))
    return codes.join(urls, "code").orderBy(rank, F.desc("count"), "code")


def issue_urls(issues: DataFrame) -> DataFrame:
    """``code, final_url``: the distinct URLs of each code, one row each."""
    return issues.select("code", "final_url").distinct()


def priority_issues(pages: DataFrame, limit: int = 10) -> DataFrame:
    """High and medium issues of pages with traffic, high first, then by impressions, or sessions where there are none.

    ``pages`` carries ``metrics`` as attached by ``enrichment.with_traffic``: ``gsc`` and ``ga4`` structs, each nullable.
    """
    gsc, ga4 = F.coalesce("metrics.gsc.impressions", F.lit(0)), F.coalesce("metrics.ga4.sessions", F.lit(0))
    ranked = pages.withColumn("ranked_by", F.when(gsc > 0, "gsc").when(ga4 > 0, "ga4")).withColumn("rank_value", F.when(gsc > 0, gsc).when(ga4 > 0, ga4)).where("ranked_by is not null")
    rows = ranked.select(
        "final_url", "crawl_order", "ranked_by", "rank_value", gsc.alias("impressions"), F.coalesce("metrics.gsc.clicks", F.lit(0)).alias("clicks"), F.posexplode("issues").alias("ord", "i")
    ).where(F.col("i.severity").isin("high", "medium"))
    return rows.orderBy(F.when(F.col("i.severity") == "high", 0).otherwise(1), F.desc("rank_value"), "crawl_order", "ord").limit(limit).select("i.code", "i.severity", F.col("final_url").alias("url"), "ranked_by", "rank_value", "impressions", "clicks")


def first_eligible(pages: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` fetched HTML pages in crawl order, whose speed is to be measured."""
    html = F.lower(F.coalesce("content_type", F.lit(""))).rlike("text/html|application/xhtml")
    return pages.where((F.col("status") >= 200) & (F.col("status") < 400) & html).orderBy("crawl_order").limit(n).select("final_url")
