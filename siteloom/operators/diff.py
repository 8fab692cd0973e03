"""Differences of two crawls of a site, and the gate that fails a build on regressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("high", "medium", "low")


def page_set_diff(old: DataFrame, new: DataFrame, url: str = "final_url") -> DataFrame:
    """``url, change``: added or removed."""
    a, b = old.select(F.col(url).alias("url")).distinct(), new.select(F.col(url).alias("url")).distinct()
    return b.join(a, "url", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "url", "left_anti").withColumn("change", F.lit("removed")))


def common_pages(old: DataFrame, new: DataFrame, url: str = "final_url") -> DataFrame:
    return old.select(F.col(url).alias("url")).intersect(new.select(F.col(url).alias("url")))


def issue_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """``code, old_count, new_count, change`` over page issues: new, resolved, increased, decreased or unchanged."""
    count = lambda pages, name: pages.select(F.explode("issues.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias(name))
    both = count(old, "old_count").join(count(new, "new_count"), "code", "full_outer").na.fill(0, ["old_count", "new_count"])
    change = F.when(F.col("old_count") == 0, "new").when(F.col("new_count") == 0, "resolved").when(F.col("new_count") > F.col("old_count"), "increased").when(F.col("new_count") < F.col("old_count"), "decreased").otherwise("unchanged")
    return both.withColumn("change", change)


def status_changes(old: DataFrame, new: DataFrame, url: str = "final_url") -> DataFrame:
    """``url, old_status, new_status`` of pages in both whose status differs. Of several rows of a page the last crawled counts."""
    last = lambda pages, name: pages.groupBy(F.col(url).alias("url")).agg(F.max_by("status", "crawl_order").alias(name))
    return last(old, "old_status").join(last(new, "new_status"), "url").where(~F.col("old_status").eqNullSafe(F.col("new_status")))


def severity_delta(old_totals: DataFrame, new_totals: DataFrame) -> dict[str, int]:
    """New minus old issue totals by severity; each input is one row of ``high, medium, low``."""
    a, b = old_totals.first(), new_totals.first()
    return {s: int((b[s] or 0) - (a[s] or 0)) for s in SEVERITIES}


@dataclass(frozen=True)
class FailOn:
    should_fail: bool
    reason: str
    delta: int


def evaluate_fail_on(delta: dict[str, int] | None, severity: str) -> FailOn:
    """Fails if there are more issues of a severity than in the previous crawl; never without one."""
    if delta is None:
        return FailOn(False, "There is no earlier crawl to compare with.", 0)
    n = delta[severity]
    return FailOn(n > 0, f"{n} more issues of severity {severity} than in the previous crawl." if n > 0 else f"No regression at severity {severity}.", n)


def diff_reports(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """All parts of a comparison of two crawls' pages."""
    return {"pages": page_set_diff(old, new), "common": common_pages(old, new), "issues": issue_deltas(old, new), "status": status_changes(old, new)}
