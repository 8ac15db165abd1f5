"""Line dedup by site-relative frequency: lines that too many of a site's pages hold are boilerplate and go.

DataFrame functions only. A line's count is the number of pages of the site that hold it at all. Pages are read twice:
once for the counts, which are summed before they are shuffled, and once to drop lines. What travels to the pages is
one list of line hashes per site; a site can't have more such lines than its pages have lines on average, divided by
the ratio, so a list doesn't grow with the site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, Workspace

#: A line is boilerplate if over this share of a site's pages hold it, and so many pages at least: what one page alone
#: holds is never boilerplate.
RATIO, MIN_PAGES = 0.05, 2


def host_of(url: Column) -> Column:
    """The host of a url in lower case, null where there is none."""
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def site_of(pages: DataFrame) -> Column:
    """A page's site: the host of its url where the table has urls, its source where it has not."""
    ways = [host_of(F.col("url").cast("string"))] if "url" in pages.columns else []
    ways += [F.col("source").cast("string")] if "source" in pages.columns else []
    return F.coalesce(*ways) if ways else F.lit(None).cast("string")


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def boilerplate(pages: DataFrame, ws: Workspace, *, site: Column | None = None, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per site with boilerplate: site (a struct, so that null sites meet), lines (the hashes of its boilerplate)."""
    lines = F.array_distinct(F.transform(F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n"), lambda x: x.rlike(WORD)), _key))
    # a page counts itself as the line null
    held = pages.select(F.struct((site_of(pages) if site is None else site).alias("name")).alias("site"), F.explode(F.concat(lines, F.array(F.lit(None).cast("bigint")))).alias("line"))
    counts = held.groupBy("site", "line").agg(F.count("*").alias("n"))
    counts = ws.keep(counts.filter(F.col("line").isNull() | (F.col("n") >= min_pages)), "line-counts")
    totals = counts.filter(F.col("line").isNull()).select("site", F.col("n").alias("total"))
    over = counts.filter(F.col("line").isNotNull()).join(totals, "site").filter(F.col("n") > ratio * F.col("total"))
    return ws.keep(over.groupBy("site").agg(F.array_sort(F.collect_list("line")).alias("lines")), "boilerplate")


def cleaned(pages: DataFrame, ws: Workspace, *, site: Column | None = None, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: row (a struct of all its columns), text without boilerplate, n_lines (before) and n_dropped."""
    hot = boilerplate(pages, ws, site=site, text=text, ratio=ratio, min_pages=min_pages)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.struct((site_of(pages) if site is None else site).alias("name")).alias("site"))
    rows = rows.join(hot, "site", "left")
    split = F.split(F.col("row").getField(text).cast("string"), "\n")
    kept = F.when(F.col("lines").isNull(), split).otherwise(F.filter(split, lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("lines"), _key(x)))))
    rows = rows.select("row", split.alias("all"), kept.alias("kept"))
    n = F.coalesce(F.when(F.col("all").isNotNull(), F.size("all")), F.lit(1)).cast("bigint")
    dropped = F.coalesce(F.when(F.col("all").isNotNull(), F.size("all") - F.size("kept")), F.lit(0)).cast("bigint")
    return rows.select("row", F.array_join("kept", "\n").alias("text"), n.alias("n_lines"), dropped.alias("n_dropped"))


def drop_lines(pages: DataFrame, ws: Workspace, *, site: Column | None = None, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages with all their columns, boilerplate lines gone from ``text``.

    A line is what stands between line feeds, compared without white space around it, however long. Lines without a word
    are never boilerplate, nor is a line that one page alone holds; on sites of under ``min_pages / ratio`` pages
    ``min_pages`` pages are enough. A null text stays null and an empty one empty; both count as pages. A page that loses
    every line stays, with an empty text. The site is the host of ``url`` or the ``source`` (or what the caller says); pages without
    one are a site of their own. Repeated rows are pages each. Columns of any name stay as they are. An empty table gives none.
    """
    out = cleaned(pages, ws, site=site, text=text, ratio=ratio, min_pages=min_pages)
    return out.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in pages.columns))
