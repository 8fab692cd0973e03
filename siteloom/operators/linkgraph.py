"""Link equity: PageRank over the crawled pages, and pages that deserve more links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siteloom.session import staged

# Fixed values.
DAMPING, ITERATIONS, TOP = 0.85, 20, 10


def link_edges(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``src, dst`` between rows of ``pages``: a link counts if it names the final URL of another row.

    Of several rows with one final URL the last crawled is linked to; redirects aren't followed.
    """
    last = pages.groupBy(F.col("final_url").alias("target")).agg(F.max_by(key, "crawl_order").alias("dst"))
    links = pages.select(F.col(key).alias("src"), F.explode(F.array_distinct("discovered_links")).alias("target"))
    return links.join(last, "target").where("src != dst").select("src", "dst")


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """``id, rank`` after a fixed number of power iterations; ranks sum to 1.

    ``vertices(id)`` are distinct, ``edges(src, dst)`` run between them. Rank of vertices without
    out-edges is spread evenly. Edges are written once with their source's out-degree; each iteration is one
    job: a join, an aggregation, and the ranks written to the shared folder, so lineage never
    grows; the sum of dangling rank is observed while they are written. No vertices give no rows.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = staged(edges.join(degree, "src"), "edges")
    nodes = vertices.select("id").join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("degree").isNull().alias("dangling"))
    seen = Observation()
    nodes = staged(nodes.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("dangling").alias("loose")), "vertices")
    n = seen.get["n"]
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank")).limit(0)
    ranks, loose, total = nodes.select("id", "dangling", F.lit(1.0 / n).alias("rank")), seen.get["loose"] / n, 1.0
    for _ in range(iterations):
        base = (1.0 - damping) / n + damping * loose / n
        given = weighted.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        fresh = nodes.join(given, "id", "left").select("id", "dangling", (base + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        # both sums are taken while the ranks are written: a round is one job
        seen = Observation()
        ranks = staged(fresh.observe(seen, F.sum("rank").alias("total"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("loose")), "ranks")
        total, loose = seen.get["total"], seen.get["loose"]
    return ranks.select("id", (F.col("rank") / total).alias("rank"))


def page_ranks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, final_url, word_count, crawl_order, page_rank`` of every row of ``pages``."""
    ranks = pagerank(pages.select(F.col(key).alias("id")), link_edges(pages, key))
    return pages.select(key, "final_url", "word_count", "crawl_order").join(ranks.select(F.col("id").alias(key), F.col("rank").alias("page_rank")), key)


def top_pages(ranked: DataFrame, n: int = TOP) -> DataFrame:
    return ranked.orderBy(F.desc("page_rank"), "crawl_order").limit(n)


def exact_median(rows: DataFrame, column: str) -> float | None:
    """The median of a column, without holding its values in one buffer: bracketed by approximate quantiles, then counted exactly
    over the distinct values inside the bracket, which are read in order up to the middle. Nulls don't count."""
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n, marks = known.agg(F.count(F.lit(1)), F.percentile_approx("x", [0.495, 0.505], 1000)).first()
    if not n:
        return None
    low, high = marks
    below = known.where(F.col("x") < low).count()
    first, last = (n - 1) // 2, n // 2
    inside = known.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    if below > first or below + (inside.agg(F.sum("k")).first()[0] or 0) <= last:
        below, inside = 0, known.groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    seen, found = below, []
    for r in inside.orderBy("x").toLocalIterator():
        seen += r["k"]
        while len(found) < 2 and seen > (first, last)[len(found)]:
            found.append(r["x"])
        if len(found) == 2:
            break
    return sum(found) / 2


def underlinked_pages(ranked: DataFrame, n: int = TOP) -> DataFrame:
    """Pages with more words than the median and at most the median rank, most words first. The medians are exact."""
    words, rank = exact_median(ranked.withColumn("word_count", F.coalesce("word_count", F.lit(0))), "word_count"), exact_median(ranked, "page_rank")
    if words is None or rank is None:
        return ranked.limit(0)
    return ranked.where((F.col("word_count") > words) & (F.col("page_rank") <= rank)).orderBy(F.desc("word_count"), "crawl_order").limit(n)


def link_graph(pages: DataFrame, key: str = "page_id") -> dict[str, DataFrame]:
    """All of the report: ``ranks``, ``top``, ``underlinked`` (empty without edges)."""
    ranked = staged(page_ranks(pages, key), "page-ranks")
    linked = not link_edges(pages, key).isEmpty()
    return {"ranks": ranked, "top": top_pages(ranked), "underlinked": underlinked_pages(ranked) if linked else ranked.limit(0)}
