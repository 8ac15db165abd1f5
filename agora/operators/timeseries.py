"""Cumulative series: a spine of buckets, counts per bucket, running sums. Never a join on inequality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_interval(interval: str) -> tuple[int, str]:
    """"2 days" -> (2, "day"); the unit is the second word."""
    number, unit = interval.split()
    return int(number), unit.lower().rstrip("s")


def _spine(rows: DataFrame, ts: str, interval: str) -> tuple[DataFrame, Column, str, int]:
    n, unit = parse_interval(interval)
    bucket = F.date_trunc(unit, F.col(ts))
    ends = rows.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    spine = ends.select(F.explode(F.expr(f"sequence(lo, hi + interval {n - 1} {unit}, interval {n} {unit})")).alias("bucket"))
    return spine, bucket, unit, n


def _fold(rows: DataFrame, spine: DataFrame, at: Column) -> DataFrame:
    """Counts of rows at or before each bucket of the spine: as many rows as there are buckets are in the window."""
    counts = rows.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    both = counts.select("bucket", "n", F.lit(False).alias("spine")).unionByName(spine.select("bucket", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("spine")))
    running = F.sum("n").over(Window.orderBy("bucket").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("total", running).filter("spine").select("bucket", "total")


def cumulative_counts(rows: DataFrame, interval: str = "1 day", ts: str = "ts") -> DataFrame:
    """(bucket, total): rows up to each bucket, from the first bucket by steps of the interval to the first at or after the last."""
    spine, bucket, _, _ = _spine(rows, ts, interval)
    return _fold(rows, spine, bucket)


def cumulative_distinct(rows: DataFrame, who: str, interval: str = "1 day", ts: str = "ts") -> DataFrame:
    """(bucket, total): distinct ``who`` up to each bucket, by the bucket that each first appears in."""
    spine, bucket, _, _ = _spine(rows, ts, interval)
    first = rows.filter(F.col(who).isNotNull()).groupBy(who).agg(F.min(bucket).alias("_first"))
    return _fold(first, spine, F.col("_first"))


def counts_per(rows: DataFrame, unit: str = "day", ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(F.date_trunc(unit, F.col(ts)).alias("bucket"), *keys).agg(F.count("*").alias("n"))
