"""What changed between consecutive full snapshots of a table.

Snapshots are compared by content-defined chunks. The rows of a snapshot are sorted by key
and cut into chunks wherever the hash of a key meets a condition, so the cuts depend on the
keys alone and an insertion moves no cut but its own. A chunk becomes one row, with its digest and
its rows as an array; chunks whose digest is the same in the previous snapshot are discarded, and only
the rows of the other chunks are taken apart, joined and classified.

One shuffle, by site and bucket of keys, serves every step: removing second deliveries, cutting,
comparing a chunk with the same chunk of the neighbouring snapshots, and joining rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key starts a chunk if its hash is 0 modulo this: the mean number of rows in a chunk.
CHUNK_ROWS = 16
#: Rows of one site, all snapshots together, that one task handles; larger sites are split by key hash.
SITE_ROWS = 500_000

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*?)/*(\?[^#]*)?(?:#.*)?$"
_MARK = "\u0001"


def page_key(url: Column) -> Column:
    """One spelling of a page URL: scheme and host in lower case, no fragment, no trailing
    slash except for the root. What isn't an absolute URL only loses fragment and slashes."""
    part = F.split(F.regexp_replace(url, _URL, f"$1{_MARK}$2{_MARK}$3{_MARK}$4"), _MARK)
    get = lambda i: F.element_at(part, i)
    whole = F.concat(F.lower(get(1)), F.lit("://"), F.lower(get(2)), F.when(get(3) == "", F.lit("/")).otherwise(get(3)), get(4))
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "(?<=.)/+$", "")
    return F.when(F.size(part) == 4, whole).otherwise(bare)


def _snapshots(pages: DataFrame, site_rows: int) -> DataFrame:
    """``host, crawled_at, before, after, buckets``: every snapshot, its neighbours, and into how many buckets of keys its site is split."""
    by_site = Window.partitionBy("host")
    order = by_site.orderBy("crawled_at")
    buckets = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.sum("n").over(by_site) / site_rows)))).cast("int")
    sizes = pages.groupBy("host", "crawled_at").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("host", "crawled_at", F.lag("crawled_at").over(order).alias("before"), F.lead("crawled_at").over(order).alias("after"), buckets.alias("buckets"))


def placed_rows(history: DataFrame, site_rows: int = SITE_ROWS) -> DataFrame:
    """``host, bucket, crawled_at, page, v, before, after``, shuffled by site and bucket.

    ``v`` holds delivery, status and codes. Besides the pages there is one row with a null page per snapshot and bucket,
    which brings the neighbouring snapshots to where the rows are. The table of split sites has at most one row
    per ``site_rows`` rows of input and is joined without a hint.
    """
    pages = history.where(F.col("host").isNotNull() & F.col("crawled_at").isNotNull() & F.col("page_url").isNotNull())
    snaps = _snapshots(pages, site_rows)
    codes = F.array_sort(F.array_distinct(F.filter(F.coalesce("codes", F.array().cast("array<string>")), lambda c: c.isNotNull())))
    value = F.struct(F.col("delivered_at").alias("at"), F.col("status").alias("status"), codes.alias("codes"))
    split = snaps.where("buckets > 1").select("host", "buckets").distinct()
    rows = pages.select("host", "crawled_at", page_key(F.col("page_url")).alias("page"), value.alias("v")).join(split, "host", "left")
    bucket = F.pmod(F.shiftright(F.xxhash64("page"), 20), F.coalesce("buckets", F.lit(1))).cast("int")
    rows = rows.select("host", bucket.alias("bucket"), "crawled_at", "page", "v", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    marks = snaps.select("host", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "crawled_at", F.lit(None).cast("string").alias("page"), F.lit(None).cast(rows.schema["v"].dataType).alias("v"), F.col("before").cast("string"), F.col("after").cast("string"))
    return rows.withColumn("crawled_at", F.col("crawled_at").cast("string")).unionByName(marks.withColumn("crawled_at", F.col("crawled_at").cast("string"))).repartition("host", "bucket")


def chunks(placed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per chunk: ``host, bucket, crawled_at, chunk, before, after``, a digest ``n, x, s`` that doesn't depend on
    the order of rows, and ``rows``, an array of page, status and codes.

    Of several rows of a page in one snapshot the one delivered last counts; rows delivered at the same time are ordered by
    status and sorted codes, so that a tie has a defined result. A chunk is named by the key it starts with.
    """
    once = placed.groupBy("host", "bucket", "crawled_at", "page").agg(F.max("v").alias("v"), F.max("before").alias("before"), F.max("after").alias("after"))
    within = Window.partitionBy("host", "bucket", "crawled_at").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.when(F.pmod(F.xxhash64("page"), F.lit(chunk_rows)) == 0, F.col("page"))
    # the row of the snapshot itself comes first, as its page is null
    marked = once.withColumns({"before": F.first("before").over(within), "after": F.first("after").over(within), "chunk": F.coalesce(F.last(cut, ignorenulls=True).over(within), F.lit(""))})
    rows = marked.where("page is not null").select("host", "bucket", "crawled_at", "chunk", "before", "after", "page", F.col("v.status").alias("status"), F.col("v.codes").alias("codes"))
    content = (F.col("page"), F.col("status"), F.concat_ws(_MARK, "codes"), F.col("status").isNull())
    return rows.groupBy("host", "bucket", "chunk", "crawled_at").agg(
        F.first("before").alias("before"), F.first("after").alias("after"),
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*content)).alias("x"), F.sum(F.hash(*content).cast("long")).alias("s"),
        F.collect_list(F.struct("page", "status", "codes")).alias("rows"),
    )


def snapshot_changes(history: DataFrame, chunk_rows: int = CHUNK_ROWS, site_rows: int = SITE_ROWS) -> DataFrame:
    """Pages and codes added, removed or changed since the previous snapshot of the site.

    Input: ``host, crawled_at, page_url, status, codes, delivered_at`` (further columns are ignored). Output:
    ``host, crawled_at, page_url, code, delta``, and for status changes ``old_status`` and ``new_status``.
    The first snapshot of a site gives nothing; a null status is a value; null codes are an empty set and null elements are
    dropped; rows without host, crawled_at or page_url are no page of a snapshot; an empty table gives an empty
    result.
    """
    order = Window.partitionBy("host", "bucket", "chunk").orderBy("crawled_at")
    digest = F.struct("n", "x", "s")
    same = lambda shift, neighbour: F.coalesce((shift("crawled_at").over(order) == F.col(neighbour)) & (shift(digest).over(order) == digest), F.lit(False))
    seen = chunks(placed_rows(history, site_rows), chunk_rows).withColumns({"same_before": same(F.lag, "before"), "same_after": same(F.lead, "after")})
    # a chunk without a match is new in its snapshot, and old in the next one
    sides = F.array_compact(
        F.array(
            F.when(F.col("before").isNotNull() & ~F.col("same_before"), F.struct(F.col("crawled_at").alias("at"), F.lit(True).alias("is_new"))),
            F.when(F.col("after").isNotNull() & ~F.col("same_after"), F.struct(F.col("after").alias("at"), F.lit(False).alias("is_new"))),
        )
    )
    parts = seen.select("host", "bucket", "rows", F.explode(sides).alias("side")).select("host", "bucket", "side.at", "side.is_new", F.explode("rows").alias("r"))
    state = F.struct("r.status", "r.codes")
    both = (
        parts.groupBy("host", "bucket", "at", F.col("r.page").alias("page"))
        .agg(F.max(F.when(F.col("is_new"), state)).alias("new"), F.max(F.when(~F.col("is_new"), state)).alias("old"))
    )
    event = lambda code, delta: F.struct(code.alias("code"), F.lit(delta).alias("delta"))
    page_event = F.when(F.col("old").isNull(), F.array(event(F.lit(""), "added"))).when(F.col("new").isNull(), F.array(event(F.lit(""), "removed")))
    kept = F.concat(
        F.when(~F.col("new.status").eqNullSafe(F.col("old.status")), F.array(event(F.lit(""), "changed"))).otherwise(F.array().cast("array<struct<code:string,delta:string>>")),
        F.transform(F.array_except("new.codes", "old.codes"), lambda c: event(c, "added")),
        F.transform(F.array_except("old.codes", "new.codes"), lambda c: event(c, "removed")),
    )
    return both.select("host", "at", "page", F.col("old.status").alias("old_status"), F.col("new.status").alias("new_status"), F.explode(F.coalesce(page_event, kept)).alias("e")).select(
        "host", F.col("at").alias("crawled_at"), F.col("page").alias("page_url"), "e.code", "e.delta", "old_status", "new_status"
    )
