"""Log lines of mixed layouts, some over several lines, into entries with fields."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.loglayout import (
    AGENT_KEYS,
    BANNER,
    COMPONENT_KEYS,
    LEVEL_KEYS,
    STAMP_KEYS,
    STATUS_KEYS,
    URL_KEYS,
    LineParser,
    TemplateTree,
    head_tokens,
    level_of,
    member,
    mined_plans,
    stamp_at,
)
from siteloom.session import staged

#: Lines of a file that are ordered in one task; longer files are split at multiples of this.
BLOCK_LINES = 20_000

_PARSED = "log_file string, line_no int, kind int, stamp string, log_level string, component string, url string, status int, user_agent string"
#: Kinds of lines. An opening brace alone starts an entry whose fields stand on later lines.
SKIP, HEAD, OPEN, MORE = 0, 1, 2, 3

_MEMBER_OF = {k: i for i, keys in enumerate((STAMP_KEYS, LEVEL_KEYS, COMPONENT_KEYS, URL_KEYS, STATUS_KEYS, AGENT_KEYS)) for k in keys}


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, ...], int] = {}
    for batch in batches:
        for raw in batch.column("raw").to_pylist():
            if raw and raw[0] not in " \t{}" and not BANNER.match(raw):
                masks = tuple(t[0] for t in head_tokens(raw.rstrip("\r\n")))
                counts[masks] = counts.get(masks, 0) + 1
    kept = [(list(masks), n) for masks, n in counts.items() if stamp_at(masks) is not None]
    yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in kept], pa.list_(pa.string())), pa.array([n for _, n in kept], pa.int64())], names=["masks", "n"])


def _parse(batches: Iterator[pa.RecordBatch], mined: dict[tuple[str, ...], dict[str, int]] | None = None) -> Iterator[pa.RecordBatch]:
    parser = LineParser(mined)
    none = (None,) * 6
    for batch in batches:
        kinds, cols = [], ([], [], [], [], [], [])
        for raw in batch.column("raw").to_pylist():
            line = raw or ""
            if not line.strip() or BANNER.match(line):
                kind, fields = SKIP, none
            else:
                found = parser.fields(line)
                if found is not None:
                    kind, fields = (OPEN, none) if line.strip() == "{" else (HEAD, found)
                else:
                    kind, fields = MORE, none
                    if (line[0] in " \t") and (pair := member(line)) and pair[0] in _MEMBER_OF:
                        at, value = _MEMBER_OF[pair[0]], pair[1]
                        if at == 1:
                            value = level_of(value)
                        elif at == 4:
                            value = int(value) if value.isdigit() else -1
                        elif at > 1 and value == "-":
                            value = ""
                        fields = none[:at] + (value,) + none[at + 1 :]
            kinds.append(kind)
            for column, value in zip(cols, fields):
                column.append(value)
        text, number = pa.string(), pa.int32()
        yield pa.RecordBatch.from_arrays(
            [batch.column("log_file"), batch.column("line_no"), pa.array(kinds, number)] + [pa.array(c, number if i == 4 else text) for i, c in enumerate(cols)],
            names=["log_file", "line_no", "kind", "stamp", "log_level", "component", "url", "status", "user_agent"],
        )


def log_entries(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per entry: ``log_file, line_no, n_lines, stamp, log_level, component, url, status, user_agent``.

    Input: ``log_file, line_no, raw`` (further columns are ignored). The distinct masked heads that hold a
    stamp are counted first; the driver merges them to templates and maps each template's positions to
    fields. Heads are masks of at most ``HEAD_TOKENS`` tokens that end before free text, so their number
    depends on layouts, not on lines. Lines are parsed where they are read; only narrow rows are shuffled, once, by (file, block), to order them and drop second
    shipments. Lines at a block's start that continue an entry of an earlier block are added to
    it by tables of at most one row per block, so a hot file is never ordered in one task. Defined cases: lines without
    file or number are left out; of several lines with the same number the first by content
    counts; null and blank lines, banners and lines before a file's first entry belong to none;
    absent fields are '' and -1.
    """
    named = lines.where("log_file is not null and line_no is not null")
    heads = named.select("raw").mapInArrow(_heads, "masks array<string>, n bigint").groupBy("masks").agg(F.sum("n").alias("n")).collect()
    mined = mined_plans((tuple(r["masks"]), r["n"]) for r in heads)
    parsed = (
        named.select("log_file", F.col("line_no").cast("int").alias("line_no"), "raw")
        .mapInArrow(partial(_parse, mined=mined), _PARSED)
        .where(F.col("kind") != SKIP)
        .withColumn("block", F.floor(F.col("line_no") / block_lines).cast("int"))
    )
    rest = ["kind", "stamp", "log_level", "component", "url", "status", "user_agent"]
    once = parsed.repartition("log_file", "block").groupBy("log_file", "block", "line_no").agg(F.min(F.struct(*rest)).alias("v")).select("log_file", "block", "line_no", "v.*")
    starts = F.when(F.col("kind").isin(HEAD, OPEN), F.col("line_no"))
    within = Window.partitionBy("log_file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    headed = once.withColumn("head", F.last(starts, ignorenulls=True).over(within))
    own = lambda c: F.max(F.when(F.col("line_no") == F.col("head"), F.col(c)))
    inner = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.col("kind") == MORE), F.struct("line_no", c)))[c]
    fields = ["stamp", "log_level", "component", "url", "status", "user_agent"]
    # one row per entry and block; both sides of the join below read it, so it is written once
    parts = staged(
        headed.groupBy("log_file", "block", "head").agg(
            F.count(F.lit(1)).cast("int").alias("n_lines"), own("kind").alias("_kind"), *[own(c).alias(c) for c in fields], *[inner(c).alias(f"in_{c}") for c in fields]
        ),
        "log-entries",
    )
    before = Window.partitionBy("log_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("log_file", "block").agg(F.max("head").alias("last_head")).withColumn("carried", F.last("last_head", ignorenulls=True).over(before))
    inner_fields = [f"in_{c}" for c in fields]
    tails = (
        parts.where("head is null")
        .select("log_file", "block", F.col("n_lines").alias("tail_lines"), *[F.col(c).alias(f"tail_{c}") for c in inner_fields])
        .join(blocks.where("carried is not null").select("log_file", "block", F.col("carried").alias("head")), ["log_file", "block"])
        .groupBy("log_file", "head")
        .agg(F.sum("tail_lines").cast("int").alias("tail_lines"), *[F.min(F.when(F.col(f"tail_{c}").isNotNull(), F.struct("block", f"tail_{c}")))[f"tail_{c}"].alias(f"tail_{c}") for c in inner_fields])
    )
    whole = parts.where("head is not null").join(tails, ["log_file", "head"], "left")
    pick = lambda c: F.coalesce(F.when(F.col("_kind") == OPEN, F.coalesce(f"in_{c}", f"tail_in_{c}")).otherwise(F.col(c)), F.lit(-1 if c == "status" else "")).alias(c)
    return whole.select("log_file", F.col("head").alias("line_no"), (F.col("n_lines") + F.coalesce("tail_lines", F.lit(0))).cast("int").alias("n_lines"), *[pick(c) for c in fields])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = TemplateTree()
    for batch in batches:
        for raw in batch.column("raw").to_pylist():
            line = (raw or "").rstrip()
            if line and not BANNER.match(line) and line[0] not in " \t#}":
                tree.add(tuple(t[0] for t in head_tokens(line)), 1, line[:120])
    found = list(tree.templates())
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in found], pa.list_(pa.string())), pa.array([n for _, n, _ in found], pa.int64()), pa.array([e for _, _, e in found], pa.string())], names=["masks", "n", "example"])


def _merge(table: pa.Table) -> pa.Table:
    tree = TemplateTree()
    for masks, n, example in sorted(zip(*(table.column(c).to_pylist() for c in ("masks", "n", "example")))):
        tree.add(tuple(masks), n, example)
    found = list(tree.templates())
    return pa.table({"template": pa.array(["".join(t).strip() for t, _, _ in found], pa.string()), "n_lines": pa.array([n for _, n, _ in found], pa.int64()), "example": pa.array([e for _, _, e in found], pa.string())})


def log_templates(lines: DataFrame) -> DataFrame:
    """The templates of line heads: ``template, n_lines, example``.

    Each task keeps a tree of its own and gives its templates; templates of the same route
    (token count and leading tokens) are then merged per route. Both sides hold templates, whose number
    is bounded by the layouts, never lines.
    """
    local = lines.select("raw").mapInArrow(_mine, "masks array<string>, n bigint, example string")
    pooled = local.groupBy("masks").agg(F.sum("n").alias("n"), F.min("example").alias("example"))
    route = F.concat_ws(",", F.size("masks"), F.slice("masks", 1, TemplateTree().depth))
    return pooled.withColumn("route", route).groupBy("route").applyInArrow(_merge, "template string, n_lines bigint, example string")
