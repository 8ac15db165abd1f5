"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agora.functions.text import clean_url


def counts_per_window(rows: DataFrame, width: str = "1 day", late: str = "1 day", ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per window of time and key; rows later than ``late`` are left out."""
    out = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("_w.start").alias("bucket"), *keys, "n")


def latest_votes(rows: DataFrame, unit: str, participant: str, position: str, ts: str, order: str) -> DataFrame:
    """Each participant's last vote on a unit, updated as votes arrive."""
    return rows.groupBy(unit, participant).agg(F.max_by(position, F.struct(ts, order)).alias(position), F.max(ts).alias(ts))


def last_seen(pings: DataFrame, key: str, url: str, ts: str) -> DataFrame:
    """When each page of each key was seen last, links cleaned."""
    return pings.groupBy(key, clean_url(F.col(url)).alias(url)).agg(F.max(ts).alias("last_ping_at"))


def first_per_window(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows without repeats of their keys that arrive within ``late``."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_once(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Works off what there is now, batch by batch, through ``step``, and stops: for a scheduler outside."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
