"""Records of several sources in target shares of the total size.

Systematic sampling: within a source the records' expected copies are summed up in order, one
random offset is added, and a record is used once per integer its sum passes. A source of
rate r thus uses each record floor(r) or ceil(r) times. Records are ordered by size, so the
sizes of the used ones follow the source's, and the reached shares the wanted ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Records of a source that are numbered in one task.
BLOCK_RECORDS = 100_000
#: Classes of size per doubling, and the seed of the offsets.
CLASSES, SEED = 4, 42


def rates(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[list[dict], float]:
    """Per wanted source its share, cap, size and rate, and the total size.

    The total is ``total_tokens``, or the most that the caps allow, as no source can give more
    than its size times its cap. Sources without records are left out and the shares of the others
    keep their proportions. The driver receives one row per row of ``targets``, a table of settings.
    """
    wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.greatest(F.lit(1), F.coalesce("max_repeats", F.lit(1)))).alias("cap"))
    sizes = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))
    rows = [r.asDict() for r in wanted.join(sizes, "source").collect()]
    scale = sum(r["share"] for r in rows)
    most = min((r["tokens"] * r["cap"] * scale / r["share"] for r in rows), default=0.0)
    total = most if total_tokens is None else min(most, float(total_tokens))
    for r in rows:
        r["rate"] = min(float(r["cap"]), r["share"] / scale * total / r["tokens"])
    return rows, total


def mixed(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """``doc_id, source, tokens, uses`` of the chosen records.

    ``counts`` holds ``doc_id, source, tokens`` (ids unique). Numbers within a source come from the
    counts of its blocks (size class and hash), added up in a table of one row per block, and from
    numbering inside blocks, so a hot source is never ordered in one task. Records of no wanted source,
    or without source, aren't used; empty tables give an empty result.
    """
    rows, _ = rates(counts, targets, total_tokens)
    spark = counts.sparkSession
    plan = F.broadcast(spark.createDataFrame([(r["source"], float(r["rate"])) for r in rows], "source string, rate double"))
    chunks = max([1, *[-(-r["records"] // block_records) for r in rows]])
    placed = counts.join(plan, "source").select(
        "doc_id", "source", "tokens", "rate", F.floor(F.log2("tokens") * CLASSES).cast("int").alias("class"), F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")
    )
    block = ["source", "class", "chunk"]
    order = Window.partitionBy("source").orderBy("class", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).select(*block, F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy(*block).orderBy("tokens", "doc_id"))
    ranked = placed.withColumn("number", number).join(starts, block).select("doc_id", "source", "tokens", "rate", (F.col("start") + F.col("number")).alias("i"))
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    uses = F.floor(F.col("rate") * F.col("i") + offset) - F.floor(F.col("rate") * (F.col("i") - 1) + offset)
    return ranked.select("doc_id", "source", "tokens", uses.cast("int").alias("uses")).where("uses > 0")


def reached_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per wanted source ``target_share, records, uses, used_tokens, actual_share``; a source without records has 0."""
    per = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("uses").alias("uses"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(per, "source", "left").na.fill(0, ["records", "uses", "used_tokens"])
    total = Window.partitionBy(F.lit(1))
    return both.withColumn("actual_share", F.col("used_tokens") / F.sum("used_tokens").over(total))
