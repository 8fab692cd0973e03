"""Connected components of an undirected graph given by pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.session import staged


def connected_components(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``id, component`` of every id in ``pairs(a, b)``; the component is its least id.

    Each round links every vertex to the least of its neighbours and then its larger neighbours
    to that (a large and a small star), which converges in a logarithmic number of rounds. Rounds are written to the shared
    folder; the driver only learns whether anything changed.
    """
    edges = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    mark = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large.where("u != v"), "cc-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = staged(small, "cc-small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark = now
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return ids.join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
