"""Reports over several child tables, pages of results, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_of_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A parent's numbers of children of several kinds, each counted before it is joined, so that kinds don't multiply."""
    out = parents
    for name, (child, on) in children.items():
        n = child.groupBy(F.col(on).alias(key)).agg(F.count("*").alias(name))
        out = out.join(n, key, "left").fillna(0, [name])
    return out


def page(rows: DataFrame, order: list[Column], first: int, after: int | None = None) -> DataFrame:
    """Rows after a place in a total order, with ``place`` (from 0), ``cursor``, ``has_previous`` and ``has_next``.

    Cursors are URL-safe base64 of "Cursor:<place>" without padding. One row more than the page tells whether it is the
    last, so only the page is sorted out, not the table.
    """
    start = 0 if after is None else after + 1
    some = rows.orderBy(*order).offset(start).limit(first + 1)
    placed = some.withColumn("place", F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1))
    more = F.max("place").over(Window.partitionBy()) >= start + first
    return placed.withColumns({"has_previous": F.lit(start > 0), "has_next": more, "cursor": cursor(F.col("place"))}).filter(F.col("place") < start + first)


def cursor(place: Column) -> Column:
    raw = F.base64(F.concat(F.lit("Cursor:"), place.cast("string")).cast("binary"))
    return F.translate(F.rtrim(raw, F.lit("=")), "+/", "-_")


def place_of(text: Column) -> Column:
    return F.regexp_extract(F.unbase64(F.translate(text, "-_", "+/")).cast("string"), "^Cursor:([0-9]+)$", 1).try_cast("int")


def histogram(rows: DataFrame, value: str, bounds: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative counts at or below each bound, as of a monitoring histogram: le, n."""
    sums = [F.count(F.when(F.col(value) <= b, 1)).alias(str(i)) for i, b in enumerate(bounds)]
    wide = rows.groupBy(*keys).agg(*sums)
    return wide.select(*keys, F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)))).alias("_h")).select(*keys, "_h.*")


def latest_per(rows: DataFrame, keys: tuple[str, ...], ts: str, tie: str) -> DataFrame:
    """The last row of each key: what DISTINCT ON says elsewhere."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def guide_report(races: DataFrame, candidates: DataFrame, submissions: DataFrame) -> DataFrame:
    """Every candidate of every race with the latest submission (``last_at``, null for none) and their number.

    ``races``: race; ``candidates``: race, candidate; ``submissions``: candidate, at. Submissions are summed before they are joined.
    """
    last = submissions.groupBy("candidate").agg(F.max("at").alias("last_at"), F.count("*").alias("n_submissions"))
    return races.join(candidates, "race").join(last, "candidate", "left").fillna(0, ["n_submissions"])


def write_csv(report: DataFrame, path: str) -> None:
    """A report as CSV with a header, one file per partition; quotes within values are doubled."""
    report.write.mode("overwrite").csv(path, header=True, escape='"')
