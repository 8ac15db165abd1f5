"""Toxicity by weak supervision.

Voters are words (lexicon) and beginnings of words (patterns) whose rate in a text passes a threshold; they are mined on
a bounded sample of labelled rows. A generative label model, fitted over all rows that aren't held out, estimates by
expectation maximisation how often each voter fires on toxic and on clean texts, and from the same posteriors how
correlated voters are within a class: voters that say the same share their weight. A known label is one voter more. The
posteriors are the labels of a linear classifier on the voters' rates, fitted by Newton steps whose sums Spark adds up
over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Workspace, chunks, mix, text_bytes

#: Labelled rows that voters are mined on, of each label at most; candidates among which voters are chosen; voters at most.
#: These bound the model's size, as any classifier has a number of features; no row is left out for them.
SAMPLE_PER_LABEL, CANDIDATES, VOTERS = 4000, 1000, 96
#: Voters in one long of a mask; groups in which partitions' sums are added up.
_WORD, _SUMS = 62, 64
PREFIXES = (4, 5, 6, 7, 8)
#: A voter fires above one of these rates (occurrences a word).
RATES = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05)
ROUNDS, TURNS, STEPS, LABEL_ACCURACY = 12, 3, 8, 0.98
#: Voters that correlate by more than this within a class share their weight.
ALIKE = 0.2
#: How much the rates that voters were mined with count in the label model, beside 1 for what all rows say. Without them the
#: two classes that explain the votes best need not be toxic and clean.
ANCHOR = 1.0
#: What a row without a label weighs in the classifier, beside 1 for one with a label. This and ANCHOR were chosen by folds
#: within the rows that may be learned from, by log-loss on a fold whose labels were hidden from all steps.
UNLABELLED = 0.03

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginnings, the text that each belongs to, and the texts' numbers of words."""
    body, at = text_bytes(pc.utf8_lower(texts))
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    inside = _LETTER[body]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:n]]))
    last = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:n], [True]])) + 1
    up, down = common._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(common._BYTE[body] * up[:n], out=total[1:])
    owner = np.searchsorted(at, first, side="right") - 1
    hashes, owners = [mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))], [owner]
    for k in PREFIXES:
        longer = last - first > k
        a = first[longer]
        hashes.append(mix((total[a + k] - total[a]) * down[a] + np.uint64(k << 32)))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(owner, minlength=len(at) - 1)


def _counts(texts: pa.Array, wanted: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each wanted hash (sorted) occurs in each text, and the texts' numbers of words."""
    hashes, owners, n_words = features_of(texts)
    some = gate[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
    hashes, owners = hashes[some], owners[some]
    at = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
    hit = wanted[at] == hashes if len(wanted) else np.zeros(0, bool)
    cells = np.bincount(owners[hit] * max(len(wanted), 1) + at[hit], minlength=len(n_words) * len(wanted))
    return cells.reshape(len(n_words), len(wanted)), n_words


def _gate(wanted: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    return out


@dataclass
class Model:
    """Voters (sorted hashes) with their thresholds, what the label model found, and the classifier's weights."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    on_toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    on_clean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shared: np.ndarray = field(default_factory=lambda: np.ones(0))
    prior: float = 0.0
    weights: np.ndarray | None = None


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _gain(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """How much (log-likelihood ratio) firing on ``a`` of ``na`` toxic and ``b`` of ``nb`` clean texts tells; 0 if it fires more on clean ones."""
    p = (a + b) / (na + nb)
    part = lambda k, n: k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / np.maximum(n * (1 - p), 1e-9))
    return np.where(a * nb > b * na, part(a, na) + part(b, nb), 0.0)


def mine(docs: DataFrame, labels: DataFrame, ws: Workspace) -> Model:
    """Voters from a sample of the labelled rows (doc_id, toxic: 0 or 1) that aren't held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = None
    for value in (0, 1):
        one = known.filter(F.col("toxic") == value).orderBy(order, "doc_id").limit(SAMPLE_PER_LABEL)
        sample = one if sample is None else sample.unionByName(one)
    # one text per doc_id, so at most 2 * SAMPLE_PER_LABEL rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ws.keep(sample, "sample")), "doc_id")
    sample = ws.keep(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).select("toxic", "text"), "sampled-texts")

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                toxic = b.column("toxic").to_numpy(zero_copy_only=False)
                hashes, owners, _ = features_of(b.column("text"))
                order = np.lexsort((owners, hashes))
                h, o = hashes[order], owners[order]
                if not len(h):
                    continue
                fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
                h, bad = h[fresh], toxic[o[fresh]]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                n = np.diff(np.concatenate([start, [len(h)]]))
                bad = np.add.reduceat(bad.astype(np.int64), start)
                yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(bad), pa.array(n - bad)], ["h", "bad", "good"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    na, nb = sizes.get(1, 0), sizes.get(0, 0)
    if na < 2 or nb < 2:
        return Model()
    found = sample.mapInArrow(holders, "h bigint, bad bigint, good bigint").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = F.col("bad") / na / ((F.col("good") + 0.5) / nb)
    worth = F.col("bad") * F.log(ratio)
    top = found.filter((F.col("bad") >= max(3, na * 0.004)) & (ratio > 2)).orderBy(worth.desc(), "h").limit(CANDIDATES).select("h").collect()
    wanted = np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))
    if not len(wanted):
        return Model()
    gate = _gate(wanted)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                cells, n = _counts(b.column("text"), wanted, gate)
                rates = [r.astype(np.float32).tobytes() for r in cells / np.maximum(n, 1)[:, None]]
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rates, pa.binary())], ["toxic", "rates"])

    seen = sample.mapInArrow(matrix, "toxic int, rates binary").toArrow()  # bounded as the sample is
    toxic = seen.column("toxic").to_numpy().astype(bool)
    rates = np.frombuffer(b"".join(seen.column("rates").to_pylist()), np.float32).reshape(len(toxic), len(wanted))
    gains = np.stack([_gain((rates[toxic] > r).sum(0), (rates[~toxic] > r).sum(0), na, nb) for r in RATES])
    best = gains.argmax(0)
    fires = rates > np.array(RATES)[best]
    order = np.lexsort((wanted, -gains.max(0)))
    spread = fires.std(0) + 1e-9
    centred = (fires - fires.mean(0)) / spread
    chosen: list[int] = []
    for i in order.tolist():
        if gains[best[i], i] <= 4 or len(chosen) == VOTERS:
            break
        if not chosen or (centred[:, chosen] * centred[:, [i]]).mean(0).max() < 0.85:
            chosen.append(i)
    pick = np.sort(np.array(chosen, np.int64))
    smooth = lambda f: np.clip((f.sum(0) + 0.5) / (len(f) + 1), 1e-4, 1 - 1e-4)
    return Model(wanted[pick], np.array(RATES)[best[pick]], smooth(fires[toxic][:, pick]), smooth(fires[~toxic][:, pick]), np.ones(len(pick)), 0.0)


def votes(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, mask (longs of 62 bits, a bit for each voter that fires), rates (of each voter, a word)."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    gate, k = _gate(model.hashes), len(model.hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = -(-k // _WORD)
        place = np.zeros((k, words), np.int64)
        place[np.arange(k), np.arange(k) // _WORD] = np.left_shift(np.int64(1), np.arange(k, dtype=np.int64) % _WORD)
        for whole in batches:
            for b in chunks(whole, "text"):
                cells, n = _counts(b.column("text"), model.hashes, gate)
                rates = cells / np.maximum(n, 1)[:, None]
                mask = (rates > model.rates).astype(np.int64) @ place
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1))) for m in (mask, rates.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *lists], ["doc_id", "held_out", "mask", "rates"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, held_out boolean, mask array<bigint>, rates array<float>")


def _bits(mask: pa.Array, k: int) -> np.ndarray:
    """Which of ``k`` voters fire, by masks of one long each or of lists of longs."""
    longs = mask.flatten() if pa.types.is_list(mask.type) else mask
    words = longs.to_numpy(zero_copy_only=False).reshape(len(mask), -1)
    at = np.arange(k, dtype=np.int64)
    return ((words[:, at // _WORD] >> at % _WORD) & 1).astype(np.float64)


def _upper(m: np.ndarray) -> np.ndarray:
    """The upper half of a symmetric matrix, which is all that is summed up."""
    return m[np.triu_indices(len(m))]


def _whole(half: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = half
    return m + np.triu(m, 1).T


def posterior(model: Model, fires: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How likely each row is toxic. label: 1, 0, or -1 (not known)."""
    on = np.log(model.on_toxic / model.on_clean) * model.shared
    off = np.log((1 - model.on_toxic) / (1 - model.on_clean)) * model.shared
    z = np.log(model.prior / (1 - model.prior)) + fires @ on + (1 - fires) @ off
    say = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    return 1 / (1 + np.exp(-np.clip(z + np.where(label < 0, 0.0, np.where(label > 0, say, -say)), -30, 30)))


def _summed(frame: DataFrame, step, size: int) -> np.ndarray:
    """The sum over all batches of ``step(batch)``, a vector of ``size``: one vector a partition, added up in ``_SUMS`` groups
    by Spark, and those here."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += step(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % _SUMS]), pa.array([total.tobytes()])], ["g", "x"])

    def add(vectors: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in vectors.column("x"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"x": [total.tobytes()]})

    sums = frame.mapInArrow(part, "g bigint, x binary").groupBy("g").applyInArrow(add, "x binary").collect()
    return sum((np.frombuffer(r["x"], np.float64) for r in sums), np.zeros(size))


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def fit_label_model(model: Model, patterns: DataFrame, anchor: float = 0.0) -> Model:
    """Firing rates in each class, the prior, and correlations, from ``patterns`` (mask, label, n).

    The rates and the prior that ``model`` comes with hold as if ``anchor`` times as many rows had shown them.
    Correlations and expectation maximisation take turns: voters that say the same first share their weight, by the
    posteriors so far, so that they don't pull the classes to themselves, and are looked at again by better posteriors.
    """
    k = len(model.hashes)
    mined = (model.on_toxic, model.on_clean, model.prior)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        fires, n = _bits(b.column("mask"), k), _column(b, "n").astype(float)
        g = posterior(model, fires, _column(b, "label"))
        return np.concatenate([[(g * n).sum(), n.sum()], (g * n) @ fires, n @ fires])

    def pairs(b: pa.RecordBatch) -> np.ndarray:
        fires, n = _bits(b.column("mask"), k), _column(b, "n").astype(float)
        g = posterior(model, fires, _column(b, "label"))
        sides = [g * n, (1 - g) * n]
        return np.concatenate([x for w in sides for x in ([w.sum()], w @ fires, _upper((fires * w[:, None]).T @ fires))])

    for _ in range(TURNS):
        load = np.zeros((k, k))
        for side in _summed(patterns, pairs, 2 * (1 + k + k * (k + 1) // 2)).reshape(2, -1):
            n = max(side[0], 1.0)
            rate = np.clip(side[1 : 1 + k] / n, 1e-4, 1 - 1e-4)
            spread = np.sqrt(rate * (1 - rate))
            load = np.maximum(load, (_whole(side[1 + k :], k) / n - np.outer(rate, rate)) / np.outer(spread, spread))
        np.fill_diagonal(load, 0)
        model.shared = 1 / (1 + np.where(load > ALIKE, load, 0).sum(1))
        for _ in range(ROUNDS // TURNS):
            s = _summed(patterns, moments, 2 + 2 * k)
            toxic, rows = s[0], s[1]
            if not rows:
                return model
            held = [anchor * rows * share for share in (mined[2], 1 - mined[2])]
            model.prior = float(np.clip((toxic + held[0]) / (rows + sum(held)), 1e-4, 0.5))
            model.on_toxic = np.clip((s[2 : 2 + k] + held[0] * mined[0] + 0.1) / (toxic + held[0] + 1), 1e-4, 1 - 1e-4)
            model.on_clean = np.clip((s[2 + k :] - s[2 : 2 + k] + held[1] * mined[1] + 0.1) / (rows - toxic + held[1] + 1), 1e-5, 1 - 1e-4)
    return model


def _inputs(rates: np.ndarray, model: Model) -> np.ndarray:
    return np.hstack([np.ones((len(rates), 1)), rates > model.rates.astype(np.float32), np.log1p(1000 * rates)])


def fit_classifier(model: Model, rows: DataFrame, ridge: float = 2.0) -> Model:
    """Logistic regression of the posteriors on the voters and their rates, over all of ``rows`` (mask, label, rates)."""
    k = len(model.hashes)
    size = 1 + 2 * k
    model.weights = np.zeros(size)

    def step(b: pa.RecordBatch) -> np.ndarray:
        x = _inputs(b.column("rates").flatten().to_numpy().reshape(b.num_rows, k), model)
        y = posterior(model, _bits(b.column("mask"), k), _column(b, "label"))
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
        w = np.where(_column(b, "label") < 0, UNLABELLED, 1.0)
        return np.concatenate([_upper((x * (w * p * (1 - p))[:, None]).T @ x), x.T @ (w * (y - p))])

    for _ in range(STEPS):
        half = size * (size + 1) // 2
        s = _summed(rows, step, half + size)
        hold = np.full(size, ridge)
        hold[0] = 1e-3
        move = np.linalg.solve(_whole(s[:half], size) + np.diag(hold), s[half:] - hold * model.weights)
        model.weights = model.weights + move
        if np.abs(move).max() < 1e-3:
            break
    return model


def toxicity(docs: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    ``labels`` (doc_id, toxic) are learned from only where crc32 of doc_id as text isn't divisible by 5; null labels
    don't count, and of several labels the greatest does. Null and empty texts get the score of a text in which no voter
    fires. A null doc_id counts as the empty text and is held out. Without labels of both kinds there are no voters and
    every score is 0. Of repeated rows the greatest text is learned from, and each gets a row; no other column is read.
    Very long texts count like others, by rates a word; an empty table gives no rows.
    """
    model = mine(docs, labels, ws)
    if not len(model.hashes):
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    cast = ws.keep(votes(docs, model), "votes")
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    seen = cast.filter("not held_out").join(known, "doc_id", "left").select("mask", "rates", F.coalesce("label", F.lit(-1)).alias("label"))
    seen = ws.keep(seen, "seen")
    patterns = ws.keep(seen.groupBy("mask", "label").agg(F.count("*").alias("n")), "patterns")
    share = known.agg(F.avg("label")).first()[0]
    model.prior = float(np.clip(share or 0.1, 1e-3, 0.5))
    model = fit_classifier(fit_label_model(model, patterns, ANCHOR), seen)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.hashes)
        for b in batches:
            x = _inputs(b.column("rates").flatten().to_numpy().reshape(b.num_rows, k), model)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return cast.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
