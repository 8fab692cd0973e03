"""Texts into containers of fixed capacity with little space unused.

Sum-of-squares packing: containers are known only by their fill level, kept in an array of
counts; each item goes where the sum of the squared counts of partly filled levels becomes
least. Items arrive in hash order, in shards of bounded size that are packed side by side; a shard
leaves a few containers partly filled, so the waste beyond one sequence is bounded too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one capacity that one task packs.
SHARD_ITEMS = 25_000


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, numbered from 0 in order of opening. Sizes are 1 to ``capacity``.

    Of equally good levels the fullest is taken; a new container is opened only if that is better
    than any open level. Containers of one level are filled last opened first.
    """
    counts = np.zeros(capacity + 1, np.int64)
    at_level: dict[int, list[int]] = {}
    out, opened = [], 0
    for size in sizes:
        best, level = 2 * int(counts[size]) + 1 if size < capacity else 0, 0
        if size < capacity:
            here = counts[1 : capacity - size + 1]
            change = 2 * (counts[1 + size : capacity + 1] - here) + 2
            change[-1] = 1 - 2 * here[-1]
            change[here == 0] = best + 1
            back = int(np.argmin(change[::-1]))
            if change[len(change) - 1 - back] <= best:
                level = len(change) - back
        if level:
            counts[level] -= 1
            container = at_level[level].pop()
        else:
            container = opened
            opened += 1
        out.append(container)
        if level + size < capacity:
            counts[level + size] += 1
            at_level.setdefault(level + size, []).append(container)
    return out


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by([("rank", "ascending"), ("doc_id", "ascending"), ("part_no", "ascending")])
    capacity = table.column("capacity_tokens")[0].as_py()
    shard = table.column("shard")[0].as_py()
    placed = sum_of_squares(table.column("tokens").to_pylist(), capacity)
    ids = pa.array([f"s{shard}-{n}" for n in placed], pa.string())
    return pa.table({"container_kind": table.column("container_kind"), "container_id": ids, **{c: table.column(c) for c in ("doc_id", "part_no", "token_start", "tokens")}})


def packed(counts: DataFrame, containers: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``container_kind, container_id, doc_id, part_no, token_start, tokens``, for every kind of container.

    ``counts`` holds ``doc_id, tokens`` (positive, ids unique); ``containers`` is a small table of
    ``container_kind, capacity_tokens``. Only a text longer than the capacity is cut: into full
    containers of its own and a rest that is packed like any item. Rows of ``containers`` with a null or
    non-positive capacity are left out, repeated kinds count once with the least capacity;
    empty tables give an empty result.
    """
    kinds = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens")).collect()
    schema = "container_kind string, container_id string, doc_id bigint, part_no int, token_start int, tokens int"
    spark = counts.sparkSession
    if not kinds:
        return spark.createDataFrame([], schema)
    shards = max(1, -(-counts.count() // shard_items))
    options = F.explode(F.array(*[F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(int(r["capacity_tokens"])).alias("capacity_tokens")) for r in kinds]))
    each = counts.select("doc_id", F.col("tokens").cast("int").alias("tokens"), options.alias("k")).select("doc_id", "tokens", "k.*")
    full = F.floor(F.col("tokens") / F.col("capacity_tokens")).cast("int")
    whole = (
        each.where(F.col("tokens") >= F.col("capacity_tokens"))
        .select("container_kind", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("part_no"))
        .select("container_kind", F.concat(F.lit("d"), "doc_id", F.lit("-"), "part_no").alias("container_id"), "doc_id", "part_no", (F.col("part_no") * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").alias("tokens"))
    )
    rank = F.xxhash64("doc_id")
    rest = each.select(
        "container_kind", "capacity_tokens", "doc_id", full.alias("part_no"), (full * F.col("capacity_tokens")).alias("token_start"), (F.col("tokens") - full * F.col("capacity_tokens")).alias("tokens"),
        rank.alias("rank"), F.pmod(F.shiftright(rank, 17), F.lit(shards)).cast("int").alias("shard"),
    ).where("tokens > 0")
    return rest.groupBy("container_kind", "shard").applyInArrow(_pack, schema).unionByName(whole)


def container_fill(parts: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: ``containers, records, tokens, fill`` (share of the opened capacity in use)."""
    capacity = containers.groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    per = parts.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"))
    opened = per.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    records = parts.where("part_no = 0 or token_start = 0").groupBy("container_kind").agg(F.count(F.lit(1)).alias("records"))
    return opened.join(records, "container_kind").join(capacity, "container_kind").select("container_kind", "containers", "records", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
