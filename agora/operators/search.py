"""Text search: query words over an inverted index, fuzzy matches by shared trigrams, common words, related texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import once, overlap, trigrams

#: English words that say little.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "not", "of", "on", "or", "our", "she", "so", "that", "the", "their", "them", "there", "they", "this", "to", "was", "we", "were", "which", "who", "will", "with", "you")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def websearch(text: Column, query: str) -> Column:
    """Whether a text answers a query: words must all be there, "phrases" in order, ``-word`` must not, ``or`` joins alternatives.

    An empty or null query lets every text pass; a null text never answers one that isn't empty.
    """
    parts = re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query or "")
    groups: list[list[Column]] = []
    joined = False
    words = tokens(F.coalesce(text, F.lit("")))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    for minus, phrase, word in parts:
        if not minus and word.lower() == "or":
            joined = bool(groups)
            continue
        wanted = re.findall(r"[^\W_]+", (phrase or word).lower())
        if not wanted:
            continue
        test = line.contains(f" {' '.join(wanted)} ") if len(wanted) > 1 else F.array_contains(words, wanted[0])
        test = ~test if minus else test
        if joined:
            groups[-1].append(test)
        else:
            groups.append([test])
        joined = False
    out = F.lit(True)
    for alternatives in groups:
        one = alternatives[0]
        for x in alternatives[1:]:
            one = one | x
        out = out & one
    return out if not groups else out & text.isNotNull()


def rank(text: Column, words: list[str]) -> Column:
    """How often a text holds any of the words, lowered to below 1; null for never, so that it sorts last.

    Words are compared as they stand, without stemming.
    """
    n = F.size(F.filter(tokens(F.coalesce(text, F.lit(""))), lambda w: w.isin(words)))
    return F.when(n > 0, n / (n + 1))


def by_popularity(rows: DataFrame, ranks: list[str], popularity: str, tie: str, limit: int = 20) -> DataFrame:
    """Search results by their ranks (ascending, null last), then the most popular first, null last."""
    return rows.orderBy(*(F.asc_nulls_last(r) for r in ranks), F.desc_nulls_last(popularity), tie).limit(limit)


def query_grams(query: str) -> list[str]:
    """The trigrams of a query's words in order, as ``trigrams`` makes them."""
    return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", query.lower()) for i in range(len(w) + 1)]


def word_similarity(text: Column, query: str) -> Column:
    """The greatest share of trigrams in common between a text and any run of the query's trigrams."""
    return F.coalesce(once(trigrams(text), lambda have: best_run(have, query_grams(query))), F.lit(0.0))


def best_run(have: Column, grams: list[str]) -> Column:
    """``word_similarity`` from a text's trigrams. Only runs that begin and end with a trigram in common can be the best."""
    if not grams:
        return F.lit(0.0)
    asked, n = F.array(*map(F.lit, grams)), len(grams)
    hits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(have, F.get(asked, i)))

    def best(t: Column) -> Column:
        share = lambda a, b, j: (j + 1) / (t["n"] + (b - a + 1) - (j + 1))
        return F.array_max(F.transform(t["hits"], lambda a, i: F.array_max(F.transform(F.slice(t["hits"], i + 1, F.lit(n)), lambda b, j: share(a, b, j)))))

    return F.coalesce(once(F.struct(hits.alias("hits"), F.size(have).alias("n")), best), F.lit(0.0))


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float) -> DataFrame:
    """Pairs of distinct texts whose trigrams overlap by more than ``threshold``: left text, right text, similarity.

    Pairs come from an equi-join on trigrams, the rarest ones that a pair above the threshold must share (a prefix by
    frequency), never from a cross join; texts are made distinct first.
    """
    a = left.select(F.col(left_on).alias("_a")).filter("_a is not null").distinct().withColumn("_ga", trigrams(F.col("_a"))).filter(F.size("_ga") > 0)
    b = right.select(F.col(right_on).alias("_b")).filter("_b is not null").distinct().withColumn("_gb", trigrams(F.col("_b"))).filter(F.size("_gb") > 0)
    counts = a.select(F.explode("_ga").alias("g")).unionByName(b.select(F.explode("_gb").alias("g"))).groupBy("g").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame, text: str, grams: str) -> DataFrame:
        rows = side.select(text, grams, F.explode(grams).alias("g")).join(counts, "g")
        nth = F.row_number().over(Window.partitionBy(text).orderBy("df", "g"))
        keep = F.size(grams) - F.ceil(F.size(grams) * F.lit(threshold)) + 1
        return rows.withColumn("_n", nth).filter(F.col("_n") <= keep).select(text, grams, "g")

    pairs = prefix(a, "_a", "_ga").join(prefix(b, "_b", "_gb"), "g").dropDuplicates(["_a", "_b"])
    return pairs.withColumn("similarity", overlap(F.col("_ga"), F.col("_gb"))).filter(F.col("similarity") > threshold).select(F.col("_a").alias("left_text"), F.col("_b").alias("right_text"), "similarity")


def common_words(rows: DataFrame, text: str, limit: int = 10, least: int = 2) -> DataFrame:
    """Words of most texts, stop words left out: word, n_texts (``least`` or more), ties by word."""
    words = rows.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).filter(~F.col("word").isin(list(STOP_WORDS)))
    return words.groupBy("word").agg(F.count("*").alias("n_texts")).filter(F.col("n_texts") >= least).orderBy(F.desc("n_texts"), "word").limit(limit)


def edit_search(rows: DataFrame, column: str, query: str, most: int) -> DataFrame:
    return rows.withColumn("distance", F.levenshtein(F.col(column), F.lit(query), most)).filter(F.col("distance") >= 0)


def nickname_search(rows: DataFrame, column: str, query: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that hold the query or the query with a name changed for its nickname, or back."""
    variants = {query}
    for name, nick in pairs:
        for a, b in ((name, nick), (nick, name)):
            variants.add(re.sub(rf"(?i)\b{re.escape(a)}\b", b, query))
    test = F.lit(False)
    for v in sorted(variants):
        test = test | F.lower(column).contains(v.lower())
    return rows.filter(test)


def related(rows: DataFrame, text: str, query: str, votes: Column, least: float = 0.1, limit: int = 5, tie: str = "id") -> DataFrame:
    """Texts like a query, best first: those whose score is above ``least``.

    Looked at are texts with a similarity over 0.1, with the query in them, or with one of its words. The score is 0.4 of
    the similarity, 0.4 of the words' ``rank`` and 0.2 of what ``word_similarity`` leaves to 1, raised by the logarithm
    of the votes.
    """
    words, grams = sorted({w for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP_WORDS}), query_grams(query)
    low = F.lower(F.col(text))
    mine = F.array(*map(F.lit, dict.fromkeys(grams))).cast("array<string>")

    def score(t: Column) -> Column:
        looked_at = (t["alike"] > 0.1) | low.contains(query.lower()) | (t["rank"] > 0)
        return F.when(looked_at, (0.4 * t["alike"] + 0.4 * t["rank"] + 0.2 * (1 - best_run(t["have"], grams))) * (1 + F.ln(F.greatest(votes, F.lit(1)).cast("double"))))

    found = F.coalesce(rank(F.col(text), words), F.lit(0.0))
    told = once(trigrams(low), lambda have: once(F.struct(have.alias("have"), overlap(have, mine).alias("alike"), found.alias("rank")), score))
    # exploded, as a filter on a plain column would compute the score a second time
    return rows.withColumn("score", F.explode(F.array(told))).filter(F.col("score") > least).orderBy(F.desc("score"), tie).limit(limit)
