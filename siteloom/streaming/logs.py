"""The log path on streams: the same parsing and attribution, with windowed and exact aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteloom.operators.logs import BOTS, bot_hits, parse_lines


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of a folder of log files, as they arrive."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def stream_bot_hits(lines: DataFrame, layout: str, site: str | None = None, bots: Sequence[tuple[str, str]] = BOTS) -> DataFrame:
    """Attributed hits of a stream of lines, with event time ``at``."""
    return bot_hits(parse_lines(lines, layout), site, bots=bots).withColumn("at", F.try_to_timestamp("timestamp"))


def windowed_hits(hits: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Hits per bot and time window; rows later than ``late`` are dropped and state is freed. Stateless but for one counter per bot and open window."""
    frame = F.window("at", width, slide) if slide else F.window("at", width)
    return hits.where("at is not null").withWatermark("at", late).groupBy(frame.alias("w"), "bot").agg(F.count(F.lit(1)).alias("hits")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "bot", "hits")


def sessions(hits: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Visits: hits of one bot and address without a pause longer than ``gap``."""
    return hits.where("at is not null").withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "bot", "ip").agg(F.count(F.lit(1)).alias("hits")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "bot", "ip", "hits")


def once_per_hit(hits: DataFrame, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """A stream without second deliveries within the watermark."""
    return hits.withWatermark("at", late).dropDuplicatesWithinWatermark(list(keys))


def write_hits(hits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append attributed hits to a table partitioned by bot. All that there is now is processed, then the
    query ends; exact distinct counts are then made over the table in batch."""
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("bot").outputMode("append").trigger(availableNow=True).start()
