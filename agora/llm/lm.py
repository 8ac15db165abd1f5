"""Scores of a bigram model whose counts lie in a log-frequency Bloom filter.

An n-gram's count is quantised to a level, and one event for each level up to it goes into the filter; probing level after
level until one is absent gives the count back. Held are pairs of words, words, and how many different words follow a word.
Probabilities interpolate pairs and words after Witten and Bell. Pairs are counted in segments; each segment counts, and sets its part
of the filter's bits, in a task. A filter of bounded size is broadcast; beyond that the probes travel to the segments and the levels back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, chunks, mix, release, word_hashes

#: Of documents whose crc32 of the id leaves this remainder, nothing is learned.
FOLDS, HELD_OUT = 10, 0
ADDED = 0.1
#: Levels rise by this factor; bits of the filter for each event.
BASE, BITS = 1.3, 12
#: Tokens a segment counts, about; words with over an eighth of that many, 65,536 at most, are spread over all segments.
SEGMENT_TOKENS, COMMON_WORDS = 1_000_000, 65_536
#: Words whose exact counts are sent to the tasks (16 bytes each): all if they are so many, else those that are over a share
#: of 1 / WORDS of all tokens, so fewer; the rest is joined. Filters of up to so many bytes are sent to the tasks.
WORDS, FILTER_BYTES = 4_000_000, 192_000_000
#: Pairs counted together before they are shuffled; bytes of probes a task holds at once (filters that are not broadcast).
FLUSH, PROBE_BYTES = 1_500_000, 16_000_000
#: Probes of several chunks that are looked up at once.
TOGETHER = 200_000
#: A segment's bits are rows of so many bytes, small enough for the JVM's heap not to keep a region of its own for each.
PIECE_BYTES = 1 << 18

#: Marks before the first and after the last word; kinds of counts: of pairs, of words, of different words after a word.
BEGIN, END = mix(np.array([(1 << 50) + 1, (1 << 50) + 2], np.uint64))
PAIR, WORD, AFTER = range(3)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(0xFFFFFFFF)
_STEPS = mix(np.arange(3 * 256, dtype=np.uint64) + np.uint64(1 << 45)).reshape(3, 256)
LEVELS = np.unique(np.ceil(BASE ** np.arange(160)).astype(np.int64))  # the least count of each level


def held_out(id: Column) -> Column:
    """Whether nothing is learned from a document; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text between BEGIN and END, and the places of these marks."""
    words, at, _ = word_hashes(texts, True)
    n = np.arange(len(at) - 1)
    begin, end = at[:-1] + 2 * n, at[1:] + 2 * n + 1
    out, inside = np.empty(len(words) + 2 * len(n), np.uint64), np.ones(len(words) + 2 * len(n), bool)
    inside[begin] = inside[end] = False
    out[inside], out[begin], out[end] = words, BEGIN, END
    return out, begin, end


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def _spread(hashes: np.ndarray, n: int) -> np.ndarray:
    """A number under ``n`` for each hash, by its upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    return key[first], np.add.reduceat(n, first) if len(key) else n


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of the right word 32 bits count."""
    return mix(left * _PAIR + (right & _LOW))


@dataclass
class Layout:
    """Where counts lie: words and their pairs in one segment, but pairs of common words in any, and common words in the last."""

    segments: int
    common: np.ndarray  # sorted

    def is_common(self, words: np.ndarray) -> np.ndarray:
        return self.common[np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)] == words

    def of_words(self, words: np.ndarray) -> np.ndarray:
        return np.where(self.is_common(words), self.segments, _spread(mix(words), self.segments))

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return _spread(np.where(self.is_common(left), pair_key(left, right), mix(left)), self.segments)


def _events(keys: np.ndarray, kind: int, levels: np.ndarray) -> np.ndarray:
    """A hash for each key and each level up to its own."""
    each = np.repeat(keys, levels)
    level = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels)
    return mix(each + _STEPS[kind, level + 1])


def _mask(events: np.ndarray) -> np.ndarray:
    one, six = np.uint64(1), np.uint64(63)
    return one << (events & six) | one << (events >> np.uint64(6) & six) | one << (events >> np.uint64(12) & six) | one << (events >> np.uint64(18) & six)


def bits_of(events: np.ndarray) -> np.ndarray:
    """A Bloom filter of 64-bit blocks: each event sets four bits of one block."""
    out = np.zeros(max(1, -(-len(events) * BITS // 64)), np.uint64)
    np.bitwise_or.at(out, _spread(events, len(out)), _mask(events))
    return out


@dataclass
class Filter:
    """Segments of the filter end to end, those at hand."""

    bits: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, parts: dict[int, np.ndarray], segments: int) -> Filter:
        size = np.array([len(parts.get(i, ())) for i in range(segments + 1)], np.int64)
        bits = [parts[i] for i in range(segments + 1) if i in parts]
        return cls(np.concatenate(bits) if bits else np.zeros(0, np.uint64), np.cumsum(size) - size, size)

    def levels(self, segments: np.ndarray, keys: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Probes level after level until one is absent."""
        out = np.zeros(len(keys), np.uint8)
        live = np.flatnonzero(self.size[segments] > 0)
        for level in range(1, len(LEVELS) + 1):
            if not len(live):
                break
            events = mix(keys[live] + _STEPS[kinds[live], level])
            of = segments[live]
            block = self.bits[self.start[of] + ((events >> np.uint64(32)) * self.size[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)]
            mask = _mask(events)
            live = live[block & mask == mask]
            out[live] = level
        return out


@dataclass
class Model:
    layout: Layout
    tokens: int
    vocabulary: int
    value: np.ndarray  # per kind and level the mean count, of level 0 none

    def asks(self, texts: pa.Array) -> Asked:
        seq, begin, end = sequences(texts)
        words, of = np.unique(seq, return_inverse=True)
        left = np.ones(len(seq), bool)
        left[end] = False
        at = np.flatnonzero(left)
        pairs, of_pair = np.unique(of[at] * len(words) + of[at + 1], return_inverse=True)
        a, b = pairs // max(len(words), 1), pairs % max(len(words), 1)
        home = self.layout.of_words(words)
        segments = np.concatenate([self.layout.of_pairs(words[a], words[b]), home, home])
        keys = np.concatenate([pair_key(words[a], words[b]), words, words])
        kinds = np.repeat(np.arange(3), [len(pairs), len(words), len(words)])
        return Asked(segments, keys, kinds, words, of, a, b, of_pair, begin, end)

    def scores(self, asked: Asked, levels: np.ndarray) -> np.ndarray:
        """log10 of each text's probability."""
        n, w = len(asked.a), len(asked.words)
        pair, word, after = self.value[PAIR, levels[:n]], self.value[WORD, levels[n : n + w]], self.value[AFTER, levels[n + w :]]
        alone = (word + ADDED) / (self.tokens + ADDED * (self.vocabulary + 1))
        seen, follow = word[asked.a], after[asked.a]
        below = np.where(seen > 0, follow + (follow == 0), 1.0)
        p = (np.minimum(pair, seen) + below * alone[asked.b]) / (seen + below)
        logs = np.log10(np.minimum(p, 1.0))[asked.of_pair]
        return np.add.reduceat(logs, asked.begin - np.arange(len(asked.begin))) if len(asked.begin) else np.zeros(0)


@dataclass
class Asked:
    """What some texts ask the filter, each different thing once, and how the answers make up the texts."""

    segments: np.ndarray
    keys: np.ndarray
    kinds: np.ndarray
    words: np.ndarray
    of: np.ndarray
    a: np.ndarray
    b: np.ndarray
    of_pair: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def word_counts(docs: DataFrame, ws: Workspace) -> DataFrame:
    """word (a hash) and n of the documents learned from, END among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for whole in batches:
            for batch in chunks(whole, "text"):
                seq, begin, _ = sequences(batch.column("text"))
                held.append(np.delete(seq, begin))
                size += len(seq)
                if size > FLUSH:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()
            held = []
        release()

    return ws.keep(docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")


def _cut_pairs(docs: DataFrame, layout: Layout) -> DataFrame:
    """segment, and the pairs counted for it: left (8 bytes each), right (4), n (4)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            left, right = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            left, right, n = _counted(left, right, np.ones(len(left), np.int64))
            segments = layout.of_pairs(left, right)
            order = np.argsort(segments, kind="stable")
            segments, left, right, n = segments[order], left[order].astype("<u8"), right[order].astype("<u4"), n[order].astype("<u4")
            first = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
            edges = [*first.tolist(), len(segments)]
            parts = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (left, right, n)]
            return pa.RecordBatch.from_arrays([pa.array(segments[first]), *(pa.array(p, pa.binary()) for p in parts)], ["segment", "left", "right", "n"])

        for whole in batches:
            for batch in chunks(whole, "text"):
                seq, _, end = sequences(batch.column("text"))
                inside = np.ones(len(seq), bool)
                inside[end] = False
                at = np.flatnonzero(inside)
                held.append((seq[at], seq[at + 1] & _LOW))
                size += len(at)
                if size > FLUSH:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()
            held = []
        release()

    return docs.select("text").mapInArrow(count, "segment bigint, left binary, right binary, n binary")


def _counted(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs as one with their counts' sum, in order of the left word."""
    order = np.lexsort((right.astype(np.uint32), left))
    left, right, n = left[order], right[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else order
    return left[first], right[first], np.add.reduceat(n, first) if len(first) else n


def _pieces(bits: np.ndarray) -> list[bytes]:
    whole = bits.astype("<u8").tobytes()
    return [whole[i : i + PIECE_BYTES] for i in range(0, len(whole), PIECE_BYTES)]


def _census(levels: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Per kind and level: how many, and the sum of their counts."""
    out = np.zeros((3, len(LEVELS) + 1, 2), np.int64)
    for kind, (level, n) in enumerate(zip(levels, counts, strict=True)):
        out[kind, :, 0] = np.bincount(level, minlength=len(LEVELS) + 1)
        out[kind, :, 1] = np.bincount(level, n, minlength=len(LEVELS) + 1)
    return out


def counted_segments(docs: DataFrame, layout: Layout, ws: Workspace) -> DataFrame:
    """Per segment its bits in pieces, with the first of which come a census of its levels, and the common words of its pairs with how many
    different words follow each there."""

    def build(table: pa.Table) -> pa.Table:
        out = counted(table)
        release()
        return out

    def counted(table: pa.Table) -> pa.Table:
        blobs = [b"".join(table.column(c).to_pylist()) for c in ("left", "right", "n")]
        left, right, n = (np.frombuffer(x, t) for x, t in zip(blobs, ("<u8", "<u4", "<u4"), strict=True))
        left, right, n = _counted(left, right.astype(np.uint64), n.astype(np.int64))
        first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        words, total, after = left[first], np.add.reduceat(n, first), np.diff(np.append(first, len(left)))
        common = layout.is_common(words)
        own = (n, total[~common], after[~common])
        levels = [level_of(x) for x in own]
        events = np.concatenate([_events(k, kind, level) for kind, (k, level) in enumerate(zip((pair_key(left, right), words[~common], words[~common]), levels, strict=True))])
        pieces = _pieces(bits_of(events))
        first_alone = lambda held: pa.array([held, *[None] * (len(pieces) - 1)], pa.list_(pa.int64()))
        return pa.table(
            {
                "segment": pa.array([table.column("segment")[0].as_py()] * len(pieces), pa.int64()),
                "piece": pa.array(range(len(pieces)), pa.int64()),
                "bits": pa.array(pieces, pa.binary()),
                "census": first_alone(_census(levels, list(own)).ravel()),
                "common": first_alone(words[common].view(np.int64)),
                "after": first_alone(after[common]),
            }
        )

    pairs = _cut_pairs(docs, layout)
    return ws.keep(pairs.groupBy("segment").applyInArrow(build, "segment bigint, piece bigint, bits binary, census array<bigint>, common array<bigint>, after array<bigint>"), "segments")


def train(docs: DataFrame, words: DataFrame, ws: Workspace) -> tuple[Model, DataFrame]:
    """The model and its filter (segment, piece, bits), learned from ``docs``; words: their ``word_counts``."""
    told = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary = told
    least = max(SEGMENT_TOKENS // 8, tokens // COMMON_WORDS)
    marks = [int(BEGIN.view(np.int64)), int(END.view(np.int64))]
    top = words.filter((F.col("n") > least) | (F.col("word") == marks[1])).toArrow()  # COMMON_WORDS at most, and END
    counts = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    counts = {marks[0]: counts.get(marks[1], 0), marks[1]: 0} | counts
    layout = Layout(max(1, -(-tokens // SEGMENT_TOKENS)), np.sort(np.array(list(counts), np.int64).view(np.uint64)))
    segments = counted_segments(docs, layout, ws)
    census = np.zeros(3 * (len(LEVELS) + 1) * 2)
    for r in segments.select(F.posexplode("census")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        census[r["pos"]] = r["n"]
    after = segments.select(F.explode(F.arrays_zip("common", "after")).alias("c")).groupBy("c.common").agg(F.sum("c.after").alias("n")).collect()
    follow = {r["common"]: r["n"] for r in after}
    common = layout.common.view(np.int64).tolist()
    own = [np.array([counts[w] for w in common]), np.array([follow.get(w, 0) for w in common])]
    levels = [np.zeros(0, np.int64), *(level_of(x) for x in own)]
    census = census.reshape(3, -1, 2) + _census(levels, [np.zeros(0, np.int64), *own])
    mean = census[:, :, 1] / np.maximum(census[:, :, 0], 1)
    value = np.where(census[:, :, 0] > 0, mean, np.concatenate([[0], LEVELS])[None, :])
    value[:, 0] = 0
    bits = bits_of(np.concatenate([_events(layout.common, kind, levels[kind]) for kind in (WORD, AFTER)]))
    last = ws.spark.createDataFrame([(layout.segments, i, bytearray(b)) for i, b in enumerate(_pieces(bits))], "segment bigint, piece bigint, bits binary")
    return Model(layout, tokens, vocabulary, value), segments.select("segment", "piece", "bits").unionByName(last)


def _fill(rows: DataFrame, held: np.ndarray) -> None:
    """Rows of a bounded table of longs, fetched as bytes a batch at a time, so that the driver holds them once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy() for c in b.columns]).tobytes()], pa.binary())], ["b"])

    at = 0
    for row in rows.mapInArrow(pack, "b binary").toLocalIterator():
        part = np.frombuffer(row["b"], np.int64).reshape(len(held), -1)
        held[:, at : at + part.shape[1]] = part
        at += part.shape[1]


def _whole_filter(bits: DataFrame, segments: int) -> Filter:
    """The segments of a bounded filter in one array, fetched piece by piece."""
    size = np.zeros(segments + 1, np.int64)
    for r in bits.groupBy("segment").agg((F.sum(F.length("bits")) / 8).cast("bigint").alias("n")).collect():
        size[r["segment"]] = r["n"]
    start = np.cumsum(size) - size
    whole = np.zeros(int(size.sum()), np.uint64)
    for r in bits.toLocalIterator():
        part, at = np.frombuffer(r["bits"], "<u8"), start[r["segment"]] + r["piece"] * PIECE_BYTES // 8
        whole[at : at + len(part)] = part
    return Filter(whole, start, size)


def log_scores(docs: DataFrame, model: Model, bits: DataFrame, exact: DataFrame, ws: Workspace, filter_bytes: int = FILTER_BYTES, broadcast_words: int = WORDS) -> DataFrame:
    """row, doc_id, n_tokens, n_known, base_score, score. exact: the ``word_counts``."""
    near = exact if model.vocabulary <= broadcast_words else exact.filter(F.col("n") * broadcast_words > model.tokens)
    held = np.empty((2, near.count()), np.int64)  # at most ``broadcast_words``
    _fill(near.select("word", "n"), held)
    held = held[:, np.argsort(held[0].view(np.uint64))]
    narrow = np.uint32 if not held.size or held[1].max() < 1 << 32 else np.int64
    whole = ws.spark.sparkContext.broadcast((held[0].view(np.uint64), held[1].astype(narrow)))
    del held
    joined = model.vocabulary > broadcast_words
    below = model.tokens + ADDED * (model.vocabulary + 1)

    def base(asked: Asked) -> list[pa.Array]:
        """n_tokens, n_known, base_score, and the words whose counts are not at hand (all of those add log10 of ADDED for now)."""
        known, n = whole.value
        at = np.minimum(np.searchsorted(known, asked.words), max(len(known) - 1, 0))
        there = known[at] == asked.words if len(known) else np.zeros(len(asked.words), bool)
        count = np.where(there, n[at], 0) if len(known) else np.zeros(len(asked.words))
        texts = len(asked.begin)
        owner = np.repeat(np.arange(texts), asked.end - asked.begin + 1)
        token = np.ones(len(asked.of), bool)
        token[asked.begin] = False
        of, owner = asked.of[token], owner[token]
        size = np.bincount(owner, minlength=texts)
        out = [pa.array(size), pa.array(np.bincount(owner, there[of], minlength=texts).astype(np.int64)), pa.array(np.bincount(owner, np.log10((count + ADDED) / below)[of], minlength=texts))]
        if joined:
            far = ~there[of]
            key, times = np.unique(owner[far] * len(there) + of[far], return_counts=True)
            at = np.searchsorted(key // max(len(there), 1), np.arange(texts + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(asked.words[key % max(len(there), 1)].view(np.int64)), pa.array(times)], ["word", "times"])))
        return out

    names = ["row", "doc_id", "n_tokens", "n_known", "base_score", *(["far"] if joined else []), "score"]
    kinds = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base_score double, " + ("far array<struct<word: bigint, times: bigint>>, " if joined else "") + "score double"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = bits.agg(F.sum(F.length("bits"))).first()[0]
    if size <= filter_bytes:
        shared = ws.spark.sparkContext.broadcast(_whole_filter(bits, model.layout.segments))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            row = TaskContext.get().partitionId() << 33
            for many in batches:
                for b in chunks(many, "text"):
                    asked = model.asks(b.column("text"))
                    scores = model.scores(asked, shared.value.levels(asked.segments, asked.keys, asked.kinds))
                    rows = pa.array(np.arange(row, row + b.num_rows))
                    row += b.num_rows
                    yield pa.RecordBatch.from_arrays([rows, b.column("doc_id"), *base(asked), pa.array(scores)], names)

        out = texts.mapInArrow(score, kinds)
    else:
        shared = None
        out = _scored_by_segments(texts, model, bits, base, names, kinds, ws)
    out = ws.keep(out, "scored")
    for sent in (whole, shared):  # else they stay, on every executor, until the driver collects its garbage
        if sent:
            sent.destroy()
    if not joined:
        return out
    far = out.select("row", F.explode("far").alias("f")).select("row", "f.word", "f.times")  # a word here is at most a small share of all tokens
    more = far.join(exact, "word").groupBy("row").agg(F.sum("times").alias("_k"), F.sum(F.col("times") * (F.log10(F.col("n") + ADDED) - F.log10(F.lit(ADDED)))).alias("_s"))
    out = out.drop("far").join(more, "row", "left")
    return out.withColumn("n_known", F.col("n_known") + F.coalesce("_k", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("_s", F.lit(0.0))).drop("_k", "_s")


def _scored_by_segments(texts: DataFrame, model: Model, bits: DataFrame, base, names: list[str], kinds: str, ws: Workspace) -> DataFrame:
    """As with a broadcast filter, for filters of any size: what each chunk of texts asks goes to the segments, the levels come back to the chunk.

    Texts stay a row each beside their chunk's number, so that no row that Spark shuffles or sorts has the size of a chunk or a filter.
    """

    def asks(texts: pa.Array) -> tuple[Asked, np.ndarray, list[int]]:
        """What a chunk asks, in order of segments, and where each segment's part begins."""
        asked = model.asks(texts)
        order = np.argsort(asked.segments, kind="stable")
        first = np.flatnonzero(np.diff(asked.segments[order], prepend=-1))
        return asked, order, [*first.tolist(), len(order)]

    own, probe = {"row": pa.int64(), "doc_id": pa.int64(), "text": pa.string()}, {"segment": pa.int64(), "keys": pa.binary(), "kinds": pa.binary()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for many in batches:
            for b in chunks(many, "text"):
                chunk, n = row, b.num_rows
                row += n
                texts = [pa.array(np.arange(chunk, row)), b.column("doc_id"), b.column("text").cast(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), *texts, *(pa.nulls(n, t) for t in probe.values())], ["chunk", *own, *probe])
                asked, order, edges = asks(b.column("text"))
                parts = [order[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
                told = [[int(asked.segments[p[0]]) for p in parts], [asked.keys[p].astype("<u8").tobytes() for p in parts], [asked.kinds[p].astype(np.uint8).tobytes() for p in parts]]
                rest = [*(pa.nulls(len(parts), t) for t in own.values()), *(pa.array(x, t) for x, t in zip(told, probe.values(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), chunk)), *rest], ["chunk", *own, *probe])
        release()

    both = ws.keep(texts.mapInArrow(ask, "chunk bigint, row bigint, doc_id bigint, text string, segment bigint, keys binary, kinds binary"), "asked")
    held, probes = both.filter("row is not null").select("chunk", *own), both.filter("segment is not null").select("chunk", *probe)
    # a segment with many probes is copied, and its probes are dealt out to the copies
    copies = probes.groupBy("segment").agg(F.ceil(F.sum(F.length("kinds")) * 8 / PROBE_BYTES).alias("copies"))
    filters = bits.join(copies, "segment").select("segment", "piece", "bits", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    dealt = probes.join(copies, "segment").withColumn("copy", F.pmod(F.xxhash64("chunk"), F.col("copies"))).drop("copies")

    def answers(own: pa.Table, probes: pa.Table) -> pa.Table:
        pieces = own.sort_by("piece").column("bits").to_pylist()
        filter = Filter.of({0: np.frombuffer(b"".join(pieces), "<u8")} if pieces else {}, 0)
        asked, of, levels, first = probes.column("keys").to_pylist(), probes.column("kinds").to_pylist(), [], 0
        ends = np.cumsum([0, *map(len, of)])
        while first < len(of):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOGETHER, side="right")) - 1)
            keys, kind = np.frombuffer(b"".join(asked[first:last]), "<u8"), np.frombuffer(b"".join(of[first:last]), np.uint8)
            told = filter.levels(np.zeros(len(keys), np.int64), keys, kind)
            levels += [x.tobytes() for x in np.split(told, ends[first + 1 : last] - ends[first])]
            first = last
        return pa.table({"chunk": probes.column("chunk"), "segment": probes.column("segment"), "levels": pa.array(levels, pa.binary())})

    levels = ws.keep(filters.groupBy("segment", "copy").cogroup(dealt.groupBy("segment", "copy")).applyInArrow(answers, "chunk bigint, segment bigint, levels binary"), "levels")

    def tell(chunk: pa.Table, levels: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("row").combine_chunks()
        asked, order, edges = asks(chunk.column("text").combine_chunks())
        told = dict(zip(levels.column("segment").to_pylist(), levels.column("levels").to_pylist(), strict=True))
        found = np.zeros(len(order), np.uint8)
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            found[order[x:y]] = np.frombuffer(told[int(asked.segments[order[x]])], np.uint8)
        return pa.table([chunk.column("row"), chunk.column("doc_id"), *base(asked), pa.array(model.scores(asked, found))], names=names)

    return held.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(tell, kinds)


def score_documents(docs: DataFrame, ws: Workspace, filter_bytes: int = FILTER_BYTES, broadcast_words: int = WORDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end. Null ids are held out, repeated rows are documents each (and count each),
    only doc_id and text are read. An empty table gives no rows; where nothing is learned, every token has probability 1.
    Words are told apart by 64 bits, and of a pair's second word 32 bits count. Texts are worked on in chunks, a longer
    text in one.
    """
    learned = docs.filter(~held_out(F.col("doc_id")))
    words = word_counts(learned, ws)
    model, bits = train(learned, words, ws)
    out = log_scores(docs, model, bits, words, ws, filter_bytes, broadcast_words)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
