"""Mixing sources to target weights by pivotal rounding of copy numbers.

Every document of a source is to be taken target / source size times. The whole part is taken for sure; the fractions
are rounded in pairs: words move at random from one document of a pair to the other until one of them is at 0 or 1,
so the words taken stay the same and each fraction is kept in expectation. Blocks of a source's documents are rounded
side by side, each leaves at most one fraction, and those are rounded in a tree of ever fewer blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, mix

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK_ROWS, FAN_IN = 4000, 256
#: Tables of sources up to this many rows are broadcast.
SMALL = 20_000
#: Equal rows that one task writes at most.
GROUP_ROWS = 100_000


def size_of(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def numbered(frame: DataFrame, ws: Workspace, order: Column, name: str) -> DataFrame:
    """``frame`` with its rows' places in an order, from 0, by range partitions: one number per partition goes through the driver."""
    n = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    parts = ws.keep(frame.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums, total = {}, 0
    for r in sorted(parts.groupBy("_p").count().collect()):
        sums[r["_p"]], total = total, total + r["count"]
    before = F.lit(0)
    if sums:
        before = F.element_at(F.create_map(*[F.lit(x) for kv in sums.items() for x in kv]), F.col("_p"))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return parts.withColumn(name, (nth + before).cast("bigint")).drop("_p")


def targets(sized: DataFrame, ws: Workspace, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: source, n_rows, source_size, number (by code point, null last), target.

    Targets share ``share`` times all words by weight; where one would pass ``most`` times its source's words it stops
    there and the rest is shared again. Each round is one sum over the sources.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    per = numbered(per, ws, F.col("source").asc_nulls_last(), "number")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    per = ws.keep(per.withColumn("weight", weight), "sources")
    top = most * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > top if capped >= 0 else F.lit(False)
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, top)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.sum(F.when(over, 1)).alias("n")).first()
        if (r["n"] or 0) == capped or not r["w"]:
            break
        capped, level = r["n"] or 0, (share * r["all"] - (r["held"] or 0.0)) / r["w"]
    return per.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), top)).drop("weight")


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(p: np.ndarray, words: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Rounds fractions in turn, the words that they stand for kept: all but one at most become 0 or 1."""
    p, w, u = p.tolist(), words.tolist(), coin.tolist()
    held = -1
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        up = min((1.0 - a) * w[held], b * w[i])
        down = min(a * w[held], (1.0 - b) * w[i])
        if u[i] * (up + down) < down:
            first_ends = (1.0 - a) * w[held] <= b * w[i]
            a, b = (1.0, b - up / w[i]) if first_ends else (a + up / w[held], 0.0)
        else:
            first_ends = a * w[held] <= (1.0 - b) * w[i]
            a, b = (0.0, b + down / w[i]) if first_ends else (a - down / w[held], 1.0)
        a, b = (round(x) if abs(x - round(x)) < 1e-12 else x for x in (a, b))
        p[held], p[i] = a, b
        held = held if 0.0 < a < 1.0 else i if 0.0 < b < 1.0 else -1
    return np.array(p, np.float64)


def _round(level: int, last: bool):
    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "coin", "doc_id"], ascending=[False, True, True], kind="stable")  # small ones last: what remains is small
        coin = _unit(mix(rows["coin"].to_numpy(np.int64).view(np.uint64) + np.uint64(level + 1)))
        p = pivot(rows["p"].to_numpy(np.float64), rows["size"].to_numpy(np.float64), coin)
        if last:  # what is left of a source
            p = np.where((p > 0) & (p < 1), (coin < p).astype(np.float64), p)
        return rows.assign(p=p)

    return of_block


def _keys(doc_id: Column, source: Column, text: Column) -> list[Column]:
    """What tells rows apart: id, source, size and a hash of the text. Rows that agree in all four can stand for each other."""
    return [doc_id.cast("string").alias("doc_id"), source.cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(text.cast("string")).alias("hash")]


def taken(docs: DataFrame, ws: Workspace, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per group of equal rows (``_keys``): these keys, doc_id in its own type as ``id``, ``m`` rows, source_size, target, and ``total``, the copies of all its rows together.

    A group is rounded as one: the whole part of m * rate is taken for sure, so rows of one id, however many, are one
    row here and no block grows with them.
    """
    named = F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text").alias("t"))
    groups = docs.select(named.alias("r")).select(F.col("r.d").alias("id"), *_keys(F.col("r.d"), F.col("r.s"), F.col("r.t"))).groupBy("id", "doc_id", "source", "size", "hash")
    sized = ws.keep(groups.agg(F.count("*").alias("m")), "sizes")
    per = ws.keep(targets(sized.select("source", (F.col("size") * F.col("m")).alias("size")), ws, weights, share, most).withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK_ROWS)), "targets")
    n, blocks = per.agg(F.count("*"), F.max("blocks")).first()
    # null sources, in a struct, meet by equality
    side = per.select(F.struct(F.col("source")).alias("_of"), "source_size", "target", "number", "blocks")
    side = F.broadcast(side) if n <= SMALL else side
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    coin = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit("")), "size", "hash", F.lit("copies"))
    rows = sized.withColumn("_of", F.struct(F.col("source"))).join(side, "_of").drop("_of")
    rows = rows.withColumn("rate", rate * F.col("m")).withColumn("whole", F.floor("rate")).withColumn("coin", coin).withColumn("p", F.col("rate") - F.col("whole"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise((F.pmod("coin", F.lit(1 << 20)) < F.col("p") * (1 << 20)).cast("double")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("coin"), F.col("blocks"))).drop("rate", "blocks")
    done, level = None, 0
    blocks = blocks or 1
    while True:
        last = blocks <= 1
        rounded = ws.keep(rows.groupBy("number", "block").applyInPandas(_round(level, last), rows.schema), f"level-{level}")
        settled = rounded if last else rounded.filter("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
        rows = rounded.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN_IN))
    return done.select("id", "doc_id", "source", "size", "hash", "m", "source_size", "target", (F.col("whole") + F.col("p")).cast("bigint").alias("total"))


def copies(docs: DataFrame, ws: Workspace, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies.

    A null text has size 0; documents without words are rounded on their own. Null sources are one source, the last.
    Repeated rows each get a row; rows that agree in id, source and text are rounded together, and the first ones of them
    are taken once more than the others. Reruns agree: chance comes from a hash of doc_id, size and text. No other column
    is read, whatever its name. Very long texts are counted whole. An empty table gives no rows.
    """
    groups = taken(docs, ws, weights, share, most)
    # a group of very many rows is told apart in parts first, so that no task writes it alone
    parts = F.when(F.col("m") > GROUP_ROWS, F.sequence(F.lit(0), F.col("m") - 1, F.lit(GROUP_ROWS))).otherwise(F.array(F.lit(0).cast("bigint")))
    large = groups.filter(F.col("m") > GROUP_ROWS).withColumn("_a", F.explode(parts)).repartition(F.col("_a"), F.col("hash"))
    both = groups.filter(F.col("m") <= GROUP_ROWS).withColumn("_a", F.lit(0).cast("bigint")).unionByName(large)
    rows = both.withColumn("_i", F.explode(F.sequence(F.col("_a"), F.least(F.col("_a") + GROUP_ROWS, F.col("m")) - 1)))
    each = F.floor(F.col("total") / F.col("m")) + (F.col("_i") < F.pmod("total", "m")).cast("bigint")
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", each.cast("int").alias("copies"))


def mix_documents(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """``docs``, every row as often as the mix takes it, all columns as they are, whatever their names.

    Texts are shuffled once, to meet their number of copies. Null texts, null sources and repeated rows are as in
    ``copies``; an empty table gives none.
    """
    row = lambda c: F.col("row").getField(c)
    key = lambda cols: F.struct(*cols).alias("key")
    groups = ws.keep(taken(docs, ws, **options).select(key(map(F.col, ("doc_id", "source", "size", "hash"))), "m", "total"), "taken")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", key(_keys(row("doc_id"), row("source"), row("text"))))
    out = rows.join(groups.filter("m = 1 and total > 0"), "key").select("row", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))))
    repeated = groups.filter("m > 1 and total > 0")
    if not repeated.isEmpty():
        # rows of a group are numbered within the parts of the input that they stand in, and the parts' numbers are added up
        some = ws.keep(rows.join(repeated, "key").withColumn("part", F.spark_partition_id()), "repeated")
        before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = some.groupBy("key", "part").count().select("key", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        nth = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.lit(0))) - 1 + F.col("before")
        numbered_rows = some.join(starts, ["key", "part"]).withColumn("nth", nth)
        each = (F.floor(F.col("total") / F.col("m")) + (F.col("nth") < F.pmod("total", "m")).cast("bigint")).cast("int")
        more = numbered_rows.withColumn("n", each).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
        out = out.unionByName(more)
    return out.select(*(row(c).alias(c) for c in docs.columns))
