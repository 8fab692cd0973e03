"""Registered queries of the core: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import audit_queries
from siteloom.operators.loglines import log_entries, log_templates
from siteloom.operators.snapshots import snapshot_changes
from siteloom.operators.timestamps import estimate_zones, normalise_with_estimates
from siteloom.session import table

Query = Callable[[SparkSession, str], DataFrame]

def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "crawl_history")).select("host", "crawled_at", "page_url", "code", "delta")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(table(spark, sf_dir, "log_lines"))


def p6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates(table(spark, sf_dir, "log_lines"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_with_estimates(table(spark, sf_dir, "log_hits"), table(spark, sf_dir, "log_sources"))


def p7_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_zones(table(spark, sf_dir, "log_hits"), sources=table(spark, sf_dir, "log_sources"))


QUERIES: dict[str, Query] = {"p5_found": p5_found, "p6_found": p6_found, "p6_templates": p6_templates, "p7_found": p7_found, "p7_zones": p7_zones} | audit_queries.QUERIES

ORACLES: dict[str, str] = audit_queries.ORACLES | {
    "p5_found": r"""
WITH r AS (
  SELECT host, crawled_at, status, delivered_at,
         list_sort(list_distinct(coalesce(codes, []))) AS codes,
         regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['s', 'h', 'p', 'q']) AS u
  FROM crawl_history),
d AS (
  SELECT host, crawled_at,
         lower(u.s) || '://' || lower(u.h) || CASE WHEN rtrim(u.p, '/') = '' THEN '/' ELSE rtrim(u.p, '/') END || u.q AS page,
         status, codes, delivered_at FROM r),
l AS (
  SELECT * FROM d
  QUALIFY row_number() OVER (PARTITION BY host, crawled_at, page ORDER BY delivered_at DESC, status DESC NULLS LAST) = 1),
s AS (
  SELECT host, crawled_at, lag(crawled_at) OVER (PARTITION BY host ORDER BY crawled_at) AS before
  FROM (SELECT DISTINCT host, crawled_at FROM l)),
n AS (SELECT l.*, s.before FROM l JOIN s USING (host, crawled_at) WHERE s.before IS NOT NULL),
o AS (SELECT l.host, s.crawled_at, l.page, l.status, l.codes FROM l JOIN s ON l.host = s.host AND l.crawled_at = s.before),
b AS (
  SELECT coalesce(n.host, o.host) AS host, coalesce(n.crawled_at, o.crawled_at) AS crawled_at, coalesce(n.page, o.page) AS page_url,
         n.page AS np, o.page AS op, n.status AS ns, o.status AS os, n.codes AS nc, o.codes AS oc
  FROM n FULL JOIN o ON n.host = o.host AND n.crawled_at = o.crawled_at AND n.page = o.page)
SELECT host, crawled_at, page_url, '' AS code, CASE WHEN op IS NULL THEN 'added' WHEN np IS NULL THEN 'removed' ELSE 'changed' END AS delta
FROM b WHERE op IS NULL OR np IS NULL OR ns IS DISTINCT FROM os
UNION ALL
SELECT host, crawled_at, page_url, code, 'added' FROM (SELECT *, unnest(nc) AS code FROM b WHERE np IS NOT NULL AND op IS NOT NULL) WHERE NOT list_contains(oc, code)
UNION ALL
SELECT host, crawled_at, page_url, code, 'removed' FROM (SELECT *, unnest(oc) AS code FROM b WHERE np IS NOT NULL AND op IS NOT NULL) WHERE NOT list_contains(nc, code)
""",
}
