"""Traffic metrics of other systems, joined to pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.url import match_url, toggled_slash, url_host


def _once(key: Column) -> Column:
    """A key computed once: a generator keeps the optimizer from repeating its expression in every filter and join that uses it."""
    return F.explode(F.array(key))


GSC_FIELDS = ("clicks", "impressions", "ctr", "position")
GA4_FIELDS = ("sessions", "screen_page_views", "total_users", "engagement_rate")


def traffic_index(traffic: DataFrame, fields: tuple[str, ...], ord_col: str | None = None) -> DataFrame:
    """``key, value``: each row under its canonical URL and, where that is free, with the trailing slash toggled.

    Of several rows with one canonical URL the last by ``ord_col`` counts (without it, the greatest);
    of several that toggle to one key the first. Missing metrics are 0.
    """
    value = F.struct(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in fields])
    order = F.col(ord_col) if ord_col else F.lit(0)
    rows = traffic.where("url is not null").select(_once(match_url(F.col("url"))).alias("key"), value.alias("value"), order.alias("ord"))
    exact = rows.groupBy("key").agg(F.max(F.struct("ord", "value")).alias("v"), F.min("ord").alias("first")).select("key", "v.value", "first")
    other = exact.select(_once(toggled_slash(F.col("key"))).alias("key"), "value", "first").where("key is not null")
    both = exact.select("key", "value", F.lit(0).alias("prio"), "first").unionByName(other.select("key", "value", F.lit(1).alias("prio"), "first"))
    return both.groupBy("key").agg(F.min_by("value", F.struct("prio", "first")).alias("value"))


def with_sources(pages: DataFrame, sources: Mapping[str, tuple[DataFrame | None, Sequence[str]]]) -> DataFrame:
    """``pages`` with a ``metrics`` struct that has a nullable struct per source, matched on the canonical final URL.

    ``sources`` maps a name to a table with ``url`` and metrics (None: the struct is null) and the names of its metrics.
    """
    out = pages.withColumn("_key", _once(match_url(F.col("final_url"))))
    parts = []
    for name, (table, fields) in sources.items():
        if table is None:
            parts.append(F.lit(None).cast("struct<" + ",".join(f"{f}:double" for f in fields) + ">").alias(name))
        else:
            out = out.join(traffic_index(table, tuple(fields)).select(F.col("key").alias("_key"), F.col("value").alias(f"_{name}")), "_key", "left")
            parts.append(F.col(f"_{name}").alias(name))
    return out.withColumn("metrics", F.struct(*parts)).drop("_key", *[f"_{name}" for name in sources])


def with_traffic(pages: DataFrame, gsc: DataFrame | None = None, ga4: DataFrame | None = None) -> DataFrame:
    """``with_sources`` for search traffic and analytics."""
    return with_sources(pages, {"gsc": (gsc, GSC_FIELDS), "ga4": (ga4, GA4_FIELDS)})


def loaded_sources(loaders: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame | None], list[tuple[str, str]]]:
    """The tables of several sources, and a row (source, message) for each that couldn't be had; its table is None, so the others still count."""
    tables: dict[str, DataFrame | None] = {}
    errors: list[tuple[str, str]] = []
    for name, load in loaders.items():
        try:
            tables[name] = load()
        except Exception as e:
            tables[name] = None
            errors.append((name, str(e).splitlines()[0] if str(e) else type(e).__name__))
    return tables, errors


def match_counts(pages: DataFrame, traffic: DataFrame, fields: tuple[str, ...] = GSC_FIELDS) -> DataFrame:
    """One row: ``total`` rows of traffic, ``matched`` pages, ``unmatched`` = the rest, at least 0."""
    matched = pages.select(_once(match_url(F.col("final_url"))).alias("key")).join(traffic_index(traffic, fields), "key", "left_semi").agg(F.count(F.lit(1)).alias("matched"))
    total = traffic.agg(F.count(F.lit(1)).alias("total"))
    one = matched.withColumn("_j", F.lit(1)).join(total.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return one.withColumn("unmatched", F.greatest(F.lit(0), F.col("total") - F.col("matched")))


def best_property(properties: DataFrame, origin: str) -> DataFrame:
    """The search property for an origin: verified, a domain property or prefix of it, the longest first."""
    host = origin.split("://", 1)[-1].split("/", 1)[0].split(":", 1)[0].lower().removeprefix("www.")
    site = F.lower("site_url")
    fits = ((site.startswith("sc-domain:") & (F.lit(host) == F.substring(site, 11, 300))) | ((F.lit(host).endswith(F.concat(F.lit("."), F.substring(site, 11, 300)))) & site.startswith("sc-domain:"))) | F.lit(origin.lower().rstrip("/") + "/").startswith(site)
    return properties.where((F.coalesce("permission", F.lit("")) != "siteUnverifiedUser") & fits).orderBy(F.desc(F.length("site_url")), "site_url").limit(1)


def matching_streams(streams: DataFrame, origin: str) -> DataFrame:
    """Analytics streams of a host: ``state`` is ok for one property, ambiguous for several, none without."""
    host = origin.split("://", 1)[-1].split("/", 1)[0].split(":", 1)[0].lower().removeprefix("www.")
    found = streams.where(F.regexp_replace(url_host(F.col("default_uri")), r"^www\.", "") == host).agg(F.count_distinct("property").alias("n"), F.min("property").alias("property"))
    return found.select(F.when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("state"), F.when(F.col("n") == 1, F.col("property")).alias("property"), "n")
