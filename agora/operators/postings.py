"""A positional index of texts in fields of different weight, and ranks of texts for queries from it.

The index is a table (term, id, hits); a query's few terms are joined with it, so texts without any of them are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions.stems import stem

from .search import STOP_WORDS, tokens

#: Weights of the four classes of fields, positions kept of a word, the last position, and how nearness of two words fades.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
POSITIONS, LAST = 256, 16_383
FAR, FAINT, ALL = 100, 1e-30, 1.64493406685


def query_terms(query: str) -> list[str]:
    """The different words of a query in order, without stop words."""
    return [w for w in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())) if w not in STOP_WORDS]


def index(rows: DataFrame, id: str, fields: dict[str, str], english: bool = False) -> DataFrame:
    """Postings (term, id, hits): per text the places (position from 1, weight) where a term stands, fields one after another.

    ``fields``: columns and their classes, A to D. Stop words are not terms, but their places count; a null field has no words.
    ``english``: terms are the words' stems.
    """

    def of_field(column: str, weight: float) -> Column:
        return F.transform(tokens(F.coalesce(F.col(column), F.lit(""))), lambda w: F.struct(w.alias("term"), F.lit(weight).alias("weight")))

    marked = F.flatten(F.array(*(of_field(c, WEIGHTS[k]) for c, k in fields.items())))
    each = rows.select(F.col(id).alias("id"), F.posexplode(marked).alias("p", "h")).filter(~F.col("h.term").isin(list(STOP_WORDS)))
    place = F.struct(F.least(F.col("p") + 1, F.lit(LAST)).alias("position"), F.col("h.weight").alias("weight"))
    # a text's own words meet in one group; of very many places of one word the first stay, as the format has it
    first = lambda hits: F.slice(F.array_sort(hits), 1, POSITIONS)
    words = each.groupBy("id", F.col("h.term").alias("term")).agg(first(F.collect_list(place)).alias("hits"))
    return words.groupBy("id", stem(F.col("term")).alias("term")).agg(first(F.flatten(F.collect_list("hits"))).alias("hits")) if english else words


def stems_of(spark: SparkSession, terms: list[str]) -> list[str]:
    """The different stems of a query's terms, in order."""
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, i int").select("i", stem(F.col("term")).alias("term")).orderBy("i")
    return list(dict.fromkeys(r["term"] for r in rows.collect()))


def matches(postings: DataFrame, terms: list[str], every: bool = True) -> DataFrame:
    """(id, hits): per text with all of the terms, or any, an array of their hits in order of the terms, null for one that it lacks."""
    asked = postings.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, i int")
    met = postings.join(F.broadcast(asked), "term").groupBy("id").agg(*(F.max(F.when(F.col("i") == i, F.col("hits"))).alias(f"_{i}") for i in range(len(terms))), F.count("*").alias("_n"))
    return (met.filter(F.col("_n") == len(terms)) if every else met).select("id", F.array(*(f"_{i}" for i in range(len(terms)))).alias("hits"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rank_any(hits: Column) -> Column:
    """The rank for terms of which any may be met: later places of a term weigh less by the square of their number, its heaviest stands first."""

    def one(places: Column) -> Column:
        shares = F.transform(places, lambda h, j: h["weight"] / ((j + 1) * (j + 1)))
        top = F.array_max(F.transform(places, lambda h, j: F.struct(h["weight"].alias("w"), (-j).alias("j"))))
        return (top["w"] + _sum(shares) - top["w"] / ((1 - top["j"]) * (1 - top["j"]))) / ALL

    return _sum(F.transform(hits, lambda p: F.when(p.isNotNull(), one(p)).otherwise(0.0))) / F.size(hits)


def rank_all(hits: Column) -> Column:
    """The rank for terms that are all met: pairs of places of different terms count by weight and nearness, as chances that add up to below 1."""
    fade = lambda d: F.when(d > FAR, FAINT).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    apart = lambda a, b: F.when(a == b, F.lit(LAST)).otherwise(F.abs(a - b))
    near = lambda x, y: F.sqrt(x["weight"] * y["weight"] * fade(apart(x["position"], y["position"])))
    none = lambda p, q: F.aggregate(p, F.lit(1.0), lambda a, x: F.aggregate(q, a, lambda b, y: b * (1 - near(x, y))))
    by_first = F.transform(hits, lambda p, i: F.aggregate(F.slice(hits, i + 2, F.size(hits)), F.lit(1.0), lambda a, q: a * none(p, q)))
    return F.when(F.size(hits) < 2, rank_any(hits)).otherwise(1 - F.aggregate(by_first, F.lit(1.0), lambda a, x: a * x))


def cover_density(hits: Column, normal: bool = True) -> Column:
    """How often and how closely the terms stand together: each shortest stretch with all of them adds its mean weight over one more than
    the other words in it. ``normal``: x / (x + 1)."""
    n = F.size(hits)
    flat = F.array_sort(F.flatten(F.transform(hits, lambda p, i: F.transform(p, lambda h: F.struct(h["position"].alias("p"), i.alias("i"), h["weight"].alias("w"))))))
    nowhere = F.transform(hits, lambda p, i: F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("w")))
    start = F.struct(nowhere.alias("last"), F.lit(0).alias("begun"), F.lit(0.0).alias("sum"))

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda x, i: F.when(i == h["i"], F.struct(h["p"].alias("p"), h["w"].alias("w"))).otherwise(x))
        begin = F.array_min(F.transform(last, lambda x: x["p"]))
        inverse = _sum(F.transform(last, lambda x: 1.0 / F.when(x["p"] == 0, 1.0).otherwise(x["w"])))
        noise = F.greatest(h["p"] - begin - (n - 1), F.lit(0))
        closed = (begin > 0) & (begin > s["begun"])
        return F.struct(last.alias("last"), F.when(closed, begin).otherwise(s["begun"]).alias("begun"), (s["sum"] + F.when(closed, n / inverse / (1 + noise)).otherwise(0.0)).alias("sum"))

    total = F.aggregate(flat, start, step, lambda s: s["sum"])
    return total / (total + 1) if normal else total
