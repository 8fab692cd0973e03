"""A sample of a sitemap that represents its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.url import bucket_key

#: Leading characters of a URL by which a bucket is split for numbering.
HEAD = 60


def bucket_quotas(sizes: list[tuple[str, int]], sample: int) -> dict[str, int]:
    """How many of each bucket's URLs are taken: one each, then by largest remainder of the rest's share.

    With fewer than one per bucket the largest buckets are served. Leftovers go round by
    remainder, then size, then name.
    """
    order = sorted(sizes, key=lambda b: (-b[1], b[0]))
    if sample < len(order):
        return {k: 1 for k, _ in order[: max(0, sample)]}
    quota = {k: 1 for k, _ in order}
    rest = min(sample, sum(n for _, n in order)) - len(order)
    spare = sum(n - 1 for _, n in order)
    if rest <= 0 or spare <= 0:
        return quota
    shares = {k: divmod(rest * (n - 1), spare) for k, n in order if n > 1}
    size = dict(order)
    for k, (whole, _) in shares.items():
        quota[k] += min(size[k] - 1, whole)
    left = rest - sum(q - 1 for q in quota.values())
    ranked = sorted(shares, key=lambda k: (-shares[k][1], -size[k], k))
    while left > 0:
        open_ = [k for k in ranked if quota[k] < size[k]][:left]
        if not open_:
            break
        for k in open_:
            quota[k] += 1
        left -= len(open_)
    return quota


def sampled_urls(urls: DataFrame, sample: int) -> DataFrame:
    """``url, bucket`` of at most ``sample`` distinct URLs: buckets by language and first segment, evenly spaced inside.

    Buckets are counted and numbered in Spark; the driver sees at most one bucket more than URLs are wanted.
    Without more URLs than wanted, all are taken.
    """
    rows = urls.select("url").where("url is not null").distinct().withColumn("bucket", bucket_key(F.col("url")))
    counted = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most ``sample`` buckets can get a place, the largest; more never reach the driver
    largest = [(r["bucket"], r["n"]) for r in counted.orderBy(F.desc("n"), "bucket").limit(sample + 1).collect()]
    if len(largest) <= sample and sum(n for _, n in largest) <= sample:
        return rows.select("url", "bucket")
    quota = bucket_quotas(largest, sample)
    if not quota:
        return rows.limit(0).select("url", "bucket")
    plan = urls.sparkSession.createDataFrame([(k, int(quota[k]), int(n)) for k, n in largest if quota.get(k)], "bucket string, quota int, size int")
    # numbered in two levels, so a hot bucket isn't sorted in one task: by the URL's head, then inside
    head = F.substring("url", 1, HEAD)
    placed = rows.join(plan, "bucket").withColumn("head", head)
    before = Window.partitionBy("bucket").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("bucket", "head").agg(F.count(F.lit(1)).alias("n")).select("bucket", "head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("bucket", "head").orderBy("url")) - 1
    placed = placed.withColumn("number", number).join(starts, ["bucket", "head"]).withColumn("i", F.col("start") + F.col("number"))
    # the i-th of n is taken if some slot s of q has floor((s + 1/2) n / q) = i
    slot = F.ceil((F.col("i") * F.col("quota")) / F.col("size") - 0.5)
    hit = F.floor((F.greatest(slot, F.lit(0)) + 0.5) * F.col("size") / F.col("quota")) == F.col("i")
    return placed.where(hit & (F.greatest(slot, F.lit(0)) < F.col("quota"))).select("url", "bucket")
