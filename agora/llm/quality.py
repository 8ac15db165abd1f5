"""Quality rules: a decision list learned from labelled statistics, all in DataFrame functions.

Statistics of whole texts are native expressions. Sequential covering learns the list: a rule grows, condition by
condition, by information gain on two thirds of the labelled rows, is pruned on the last third, and the rows that it
covers leave. Each step is one aggregation to a histogram of at most features x bins rows; the list comes out as one
ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, Workspace, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Base rule: fewer words than this, or more than this share of words in repeated windows.
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
#: Labelled documents that a list is learned from, at most about so many: their ids and labels are broadcast (12 bytes each).
LABELLED_ROWS = 500_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_distinct_words")
#: What conditions are about: ratios of the counts, so that they hold for texts of any length.
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "line_words", "distinct_rate")


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of eight words that the text has twice or more."""
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            ranked,
            lambda s: F.filter(
                F.transform(s, lambda e, k: F.when((F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"])),
                lambda x: x.isNotNull(),
            ),
        )
        return F.aggregate(
            F.sort_array(places),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def statistics(text: Column) -> Column:
    """A struct of ``COUNTS`` (bigint) over a whole text; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _repeat_words(w).alias("repeat")),
    )
    parts = F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        without(SPACE + "+").alias("chars"),
        without(f"[^{SYMBOLS}]+").alias("symbols"),
        without("[^\\p{Lu}]+").alias("upper"),
        without("[^!?;:.,]+").alias("marks"),
    )
    values = lambda p: (p["w"]["n"], p["chars"], p["symbols"], p["l"]["dup"], p["w"]["repeat"], p["upper"], p["marks"], p["l"]["all"], p["w"]["distinct"])
    return let(parts, lambda p: F.struct(*(v.cast("bigint").alias(k) for k, v in zip(COUNTS, values(p), strict=True))))


def features(s: Column) -> dict[str, Column]:
    """The features of a struct of statistics; rates of an empty text are 0."""
    rate = lambda a, b: F.when(s[b] > 0, s[a].cast("double") / s[b]).otherwise(F.lit(0.0))
    values = (
        s["n_words"].cast("double"),
        rate("word_chars", "n_words"),
        rate("n_symbols", "n_words"),
        rate("n_dup_lines", "n_lines"),
        rate("n_repeat_words", "n_words"),
        rate("n_upper", "word_chars"),
        rate("n_marks", "n_words"),
        rate("n_words", "n_lines"),
        rate("n_distinct_words", "n_words"),
    )
    return dict(zip(FEATURES, values, strict=True))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction that rejects a text; what no rule takes is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def keeps(self, s: Column) -> Column:
        """The list as one ordered conditional expression over a struct of statistics."""
        have = features(s)
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & ((have[c.feature] > c.threshold) if c.above else (have[c.feature] <= c.threshold))
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the thresholds lie below a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < value))


def _steps(n_bins: int) -> list[float]:
    """Quantiles for thresholds, closer together in the tails, where junk lies."""
    tail = [0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08]
    body = [i / n_bins for i in range(2, n_bins - 1)]
    return sorted({*tail, *body, *(1 - q for q in tail)})


def fit(labelled: DataFrame, ws: Workspace, *, stats: str = "stats", label: str = "bad", fold_by: str = "doc_id", max_rules: int = 10, max_conditions: int = 3, min_precision: float = 0.9, min_rows: int = 5, n_bins: int = 20) -> DecisionList:
    """Learns a list from rows with a struct of statistics and a boolean label (true: to be rejected; null rows are left out).

    A rule stays if ``min_precision`` of the rows that it takes are bad, on the rows it grew on and on those it was
    pruned on together, and ``min_rows`` of them at least. Without rows, or without rows of both labels, the list is empty.
    """
    have = features(F.col(stats))
    flat = labelled.filter(F.col(label).isNotNull()).select(
        *(v.alias(k) for k, v in have.items()), F.col(label).cast("int").alias("_bad"), (F.pmod(F.xxhash64(F.col(fold_by)), F.lit(3)) == 0).alias("_prune")
    )
    flat = ws.keep(flat, "labelled")
    cuts_row = flat.agg(*(F.percentile_approx(k, _steps(n_bins), 10_000).alias(k) for k in FEATURES), F.sum("_bad").alias("_bad"), F.count("*").alias("_n")).first()
    if not cuts_row["_n"] or not cuts_row["_bad"] or cuts_row["_bad"] == cuts_row["_n"]:
        return DecisionList()
    cuts = {k: sorted({*cuts_row[k]}) for k in FEATURES}
    binned = [_bin(F.col(k), cuts[k]).alias(k) for k in FEATURES]
    rows = ws.keep(flat.select(*binned, "_bad", "_prune").groupBy(*FEATURES, "_prune").agg(F.sum("_bad").alias("bad"), (F.count("*") - F.sum("_bad")).alias("good")), "binned")

    def holds(rule: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for k, above, b in rule:
            out = out & ((F.col(k) > b) if above else (F.col(k) <= b))
        return out

    def histogram(left: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        """Bad and good rows by feature and bin: at most features x bins rows, whatever the table's size."""
        out: dict[str, dict[int, tuple[int, int]]] = {k: {} for k in FEATURES}
        pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("b")) for k in FEATURES))).alias("p")
        for r in left.select(pairs, "bad", "good").groupBy("p.k", "p.b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
            out[r["k"]][r["b"]] = (r["bad"], r["good"])
        return out

    found: list[list[tuple[str, bool, int]]] = []
    left = rows
    for _ in range(max_rules):
        rule: list[tuple[str, bool, int]] = []
        here = left.filter(~F.col("_prune"))
        for _ in range(max_conditions):
            bins = histogram(here)
            bad, good = map(sum, zip(*bins["n_words"].values(), strict=True)) if bins["n_words"] else (0, 0)
            if not bad or not good:
                break
            best = None
            for k in FEATURES:
                p = n = 0
                for b in sorted(bins[k]):
                    p, n = p + bins[k][b][0], n + bins[k][b][1]
                    if b >= len(cuts[k]):
                        continue
                    for above, x, y in ((False, p, n), (True, bad - p, good - n)):
                        if x >= min_rows:
                            gain = x * (math.log2(x / (x + y)) - math.log2(bad / (bad + good)))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, k, above, b)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1:])
            here = here.filter(holds(rule[-1:]))
        if not rule:
            break
        counts = left.agg(
            *(F.sum(F.when(holds(rule[:i]) & (F.col("_prune") == fold), F.col(side))).alias(f"{side}_{i}_{fold}") for i in range(1, len(rule) + 1) for fold in (True, False) for side in ("bad", "good"))
        ).first()
        worth = {}
        for i in range(1, len(rule) + 1):
            p, n = (counts[f"{side}_{i}_True"] or 0 for side in ("bad", "good"))
            worth[i] = (p - n) / (p + n) if p + n else -1.0
        size = max(worth, key=lambda i: (worth[i], -i))
        p, n = (sum(counts[f"{side}_{size}_{fold}"] or 0 for fold in (True, False)) for side in ("bad", "good"))
        if p < min_rows or p < min_precision * (p + n):
            size = len(rule)
            p, n = (sum(counts[f"{side}_{size}_{fold}"] or 0 for fold in (True, False)) for side in ("bad", "good"))
            if p < min_rows or p < min_precision * (p + n):
                break
        found.append(rule[:size])
        left = left.filter(~holds(rule[:size]))
    ws.drop(flat, rows)
    return DecisionList([[Condition(k, above, float(cuts[k][b])) for k, above, b in rule] for rule in found])


def measured(docs: DataFrame, ws: Workspace) -> DataFrame:
    """A written table of doc_id and ``stats``, a row per document: texts are gone through once, for learning and verdicts alike."""
    return ws.keep(docs.select("doc_id", statistics(F.col("text").cast("string")).alias("stats")), "statistics")


def known(labels: DataFrame, ws: Workspace, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id and ``bad`` of about ``rows`` labelled documents, by a hash of doc_id; of all, if there are no more. Small enough to broadcast."""
    all_of = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("bad")).distinct()
    all_of = ws.keep(all_of, "labels")
    n = all_of.count()
    share = min(1 << 30, (rows << 30) // max(n, 1))
    return F.broadcast(all_of.filter(F.pmod(F.xxhash64("doc_id", F.lit("known")), F.lit(1 << 30)) < share))


def learn(stats: DataFrame, labels: DataFrame, ws: Workspace, *, rows: int = LABELLED_ROWS, **options) -> DecisionList:
    """Learns from the statistics (doc_id, stats) of documents that ``labels`` (doc_id, quality: 0 is bad) cover.

    Null labels don't count, and a document with labels of both kinds counts once for each. Beyond ``rows`` labelled
    documents about so many of them are learned from. Without labels or documents the list is empty.
    """
    return fit(stats.join(known(labels, ws, rows), "doc_id"), ws, **options)


def learn_from_texts(docs: DataFrame, labels: DataFrame, ws: Workspace, *, rows: int = LABELLED_ROWS, **options) -> DecisionList:
    """``learn`` for where no table of statistics is wanted: only the labelled texts are gone through, and no text is shuffled."""
    texts = docs.select("doc_id", "text").join(known(labels, ws, rows), "doc_id")
    return fit(texts.select("doc_id", statistics(F.col("text").cast("string")).alias("stats"), "bad"), ws, **options)


def verdicts(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Per row of ``measured``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and fails. Repeated rows each get a row; very long texts are measured whole. No
    other column is read, whatever its name. An empty table gives no rows.
    """
    s = F.col("stats")
    return stats.select("doc_id", *(s[k].alias(k) for k in COUNTS[:5]), base_failed(s).alias("base_failed"), (~base_failed(s) & rules.keeps(s)).alias("kept"))


def filter_documents(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that neither the base rule nor the list rejects, with all their columns, whatever their names.

    Null and empty texts go. Repeated rows are judged each. An empty table gives none.
    """
    return docs.filter(let(statistics(F.col("text").cast("string")), lambda s: ~base_failed(s) & rules.keeps(s)))
