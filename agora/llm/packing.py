"""Best-fit packing of token sequences after Martello and Toth's dominance reduction.

A packing depends on how many pieces there are of each length, and there are at most as many lengths as a sequence has
places. So the plan is made on that histogram, bounded whatever the corpus' size: sets of pieces that provably
dominate all others are fixed, the rest is put best-fit decreasing, many alike sequences at a time. Spark counts the
pieces, ranks them within their lengths and looks each one's place up in the plan.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, chunks

LIMIT, END = 2048, 0
#: Plans of up to so many rows (48 bytes each) are sent to the tasks; longer ones (other limits) are joined.
PLAN_ROWS = 500_000

#: Bytes of a worker's store of words, with about 180 bytes a word besides its letters and ids; longer words aren't kept.
_CACHE_BYTES, _WORD_BYTES, _CACHE_CHARS = 110_000_000, 180, 40
#: Bytes of texts encoded together.
_ENCODE_BYTES = 500_000
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Token ids of a text, word by word, with a bounded store of words already seen.

    White space always ends a token of the vocabularies meant here, so a text's ids are those of its words in turn;
    ``by_word=False`` encodes whole texts, for vocabularies where that doesn't hold.
    """

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.held = 0
        special = [k for k, v in self.tokenizer.get_added_tokens_decoder().items() if v.special]
        self.mark = special[0] if special and by_word else None
        self.between = f" {self.tokenizer.id_to_token(self.mark)} " if self.mark is not None else None

        self.plain = self._of_letters(path) if by_word else None

    def _of_letters(self, path: str):
        """The same model behind a plain splitter, right for words of small letters, whose last tokens the vocabulary marks."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        ends = self.tokenizer.model.end_of_word_suffix if hasattr(self.tokenizer.model, "end_of_word_suffix") else None
        if not ends:
            return None
        other = Tokenizer.from_file(path)
        other.normalizer = normalizers.NFC()
        other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = other.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(ends)]] = True
        return other

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of many words from one call: a special token stands between them."""
        plain = [w for w in words if "<|" not in w]
        found = {w: self._whole(w) for w in words if "<|" in w}
        for a in range(0, len(plain), 20_000):
            part = plain[a : a + 20_000]
            ids = np.array(self.tokenizer.encode(self.between.join(part), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            found.update(zip(part, _split(ids, cut, cut + 1), strict=True) if len(cut) == len(part) - 1 else ((w, self._whole(w)) for w in part))
        return found

    def _learn_small(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words in small letters, with marks of the end of a sentence or not: letters and marks are apart for the vocabulary."""
        if self.plain is None:
            return self._learn(words)
        alone, marked, others = [], {}, []
        for w in words:
            if w.isalpha():
                alone.append(w)
            elif (core := w.rstrip(_MARKS)).isalpha():
                marked[w] = core
            else:
                others.append(w)
        new = list({*alone, *(c for c in marked.values() if c not in self.known)})
        fresh = {}
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.last[ids])[:-1] + 1
            fresh.update(zip(part, _split(ids, cut, cut), strict=True) if len(cut) == len(part) - 1 else ((w, self._whole(w)) for w in part))
        tails = {w[len(c) :] for w, c in marked.items()}
        tails = {t: self.known[t] if t in self.known else self._whole(t) for t in tails}
        for w, c in marked.items():
            fresh[w] = (fresh[c] if c in fresh else self.known[c]) + tails[w[len(c) :]]
        return fresh | self._learn(others) if others else fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.mark is None:
            return [self._whole(t) for t in texts]
        split, ids, new = [], [], [set(), set()]
        get = self.known.get
        for t in texts:
            small = _NOT_LATIN.search(t) is None
            words = _words(t.lower() if small else t)
            have = list(map(get, words))
            if None in have:
                new[small].update(w for w, v in zip(words, have, strict=True) if v is None)
            split.append(words)
            ids.append(have)
        fresh = (self._learn(list(new[0])) if new[0] else {}) | (self._learn_small(list(new[1])) if new[1] else {})
        out = [b"".join(have if None not in have else [fresh[w] if v is None else v for w, v in zip(words, have, strict=True)]) for words, have in zip(split, ids, strict=True)]
        self._store(fresh, split)
        return out

    def _store(self, fresh: dict[str, bytes], split: list[list[str]]) -> None:
        """Keeps new words; a full store starts again with the words that the texts at hand repeat."""
        fresh = {w: v for w, v in fresh.items() if len(w) <= _CACHE_CHARS}
        self.held += sum(map(len, fresh)) + sum(map(len, fresh.values())) + _WORD_BYTES * len(fresh)
        if self.held > _CACHE_BYTES:
            often = [w for w, n in Counter(chain.from_iterable(split)).items() if n > 1 and len(w) <= _CACHE_CHARS]
            known, self.known = self.known, {}
            self.known.update((w, known.get(w) or fresh[w]) for w in often if w in known or w in fresh)
            self.held = sum(len(w) + len(v) for w, v in self.known.items()) + _WORD_BYTES * len(self.known)
            return
        self.known.update(fresh)


def _split(ids: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> list[bytes]:
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip([0, *(starts * 4).tolist()], [*(ends * 4).tolist(), len(raw)], strict=True)]


#: Beyond these letters, lower case is left to the tokenizer.
_NOT_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]")
_MARKS = ".,!?;:"


def _words(text: str) -> list[str]:
    return text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, ws: Workspace, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and for ranks ``_part`` and ``_nth``, its number among the pieces of its length in its part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for whole in batches:
            for batch in chunks(whole, "text", _ENCODE_BYTES):
                row, piece, start, length, crc, nth = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                    ids += end
                    for p, a in enumerate(range(0, len(ids), 4 * limit)):
                        one = ids[a : a + 4 * limit]
                        n = len(one) // 4
                        row.append(i)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(n)
                        crc.append(zlib.crc32(one))
                        nth.append(int(seen[n]))
                        seen[n] += 1
                arrays = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                arrays += [pa.array(x, pa.int64()) for x in (start, length, crc, [part] * len(row), nth)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _part bigint, _nth bigint")
    return ws.keep(found, "pieces")


def reduce_by_dominance(left: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fixes sequences that some best packing has, takes their pieces out of ``left`` (length: number) and returns (how many, [(length, pieces of it)]).

    For a piece j and the longest k that fits with it: j alone if there is none; {j, k} if they fill a sequence, or if
    no third piece fits, or if at most two more fit and no two of them are longer together than k.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                own = left[j]
                others = sorted(x for x, n in left.items() if x != j or n > 1)
                at = bisect_right(others, limit - j)
                if not at:
                    fixed.append((own, [(j, 1)]))
                    del left[j]
                    changed = True
                    break
                k = others[at - 1]
                if not (j + k == limit or _pair_dominates(left, others[:at], j, k, limit)):
                    break
                n = own // 2 if j == k else min(own, left[k])
                fixed.append((n, [(j, 2)] if j == k else [(j, 1), (k, 1)]))
                for x, m in ((j, 2 * n),) if j == k else ((j, n), (k, n)):
                    left[x] -= m
                    if not left[x]:
                        del left[x]
                changed = True
    return fixed


def _pair_dominates(left: dict[int, int], fitting: list[int], j: int, k: int, limit: int) -> bool:
    room = limit - j
    count = lambda x: left[x] - (x == j)
    smallest: list[int] = []
    for x in fitting:
        smallest += [x] * min(3 - len(smallest), count(x))
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or sum(smallest[:2]) > room:
        return True
    if len(smallest) == 3 and sum(smallest) <= room:
        return False
    most, b = 0, len(fitting) - 1
    for a, x in enumerate(fitting):
        while b >= 0 and x + fitting[b] > room:
            b -= 1
        c = b
        if c == a and count(x) < 2:
            c -= 1
        if c >= 0:
            most = max(most, x + fitting[c])
    return most <= k


def best_fit(left: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram: each piece goes where least room stays. Alike sequences are filled together."""
    rooms: dict[int, list[tuple[int, tuple]]] = {}
    order: list[int] = []

    def put(room: int, n: int, held: tuple) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((n, held))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect_left(order, size)
            if at == len(order):
                q = limit // size
                if n // q:
                    put(limit - q * size, n // q, ((size, q),))
                if n % q:
                    put(limit - n % q * size, 1, ((size, n % q),))
                break
            room = order[at]
            m, held = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            q = room // size
            full = min(m, n // q)
            if full:
                put(room - q * size, full, (*held, (size, q)))
                n, m = n - full * q, m - full
            if m and n:
                put(room - n * size, 1, (*held, (size, n)))
                n, m = 0, m - 1
            if m:
                put(room, m, held)
    return [(n, list(held)) for lists in rooms.values() for n, held in lists]


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, pieces a sequence, first sequence, offset): which ranks go where."""
    left = {k: n for k, n in counts.items() if n}
    kinds = reduce_by_dominance(left, limit) + best_fit(left, limit)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, held in kinds:
        offset = 0
        for size, q in held:
            a = used.get(size, 0)
            rows.append((size, a, a + n * q, q, sequence, offset))
            used[size] = a + n * q
            offset += q * size
        sequence += n
    return rows


def pack(docs: DataFrame, ws: Workspace, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are documents each; null ids are kept. Only doc_id and text
    are read. An empty table gives no rows. Which of several pieces of one length goes where is arbitrary but fixed by
    the table of pieces, which is written once.
    """
    cut = pieces(docs, ws, tokenizer, limit)
    counts = ws.keep(cut.groupBy("length", "_part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = sorted(plan(histogram, limit))
    ranked = cut.join(starts, ["length", "_part"]).withColumn("_rank", F.col("_nth") + F.col("_before"))
    if len(rows) <= PLAN_ROWS:
        return _placed(ranked, np.array(rows, np.int64).reshape(-1, 6), ws)
    places = ws.spark.createDataFrame(rows, "length bigint, a bigint, b bigint, q bigint, first bigint, at bigint")
    nth = F.col("_rank") - F.col("a")
    placed = ranked.join(places, "length").filter((F.col("_rank") >= F.col("a")) & (F.col("_rank") < F.col("b")))
    sequence, offset = F.col("first") + F.floor(nth / F.col("q")), F.col("at") + F.pmod(nth, F.col("q")) * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("bigint").alias("sequence_id"), offset.alias("offset"))


def _placed(ranked: DataFrame, rows: np.ndarray, ws: Workspace) -> DataFrame:
    """Pieces with their places: those of a length lie in order in the plan, so each is found by halving."""
    shared = ws.spark.sparkContext.broadcast(rows)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        top = int(rows[:, 2].max(initial=0)) + 1
        keys = rows[:, 0] * top + rows[:, 1]
        for b in batches:
            size, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            at = rows[np.searchsorted(keys, size * top + rank, side="right") - 1] if b.num_rows else rows[:0]
            nth = rank - at[:, 1]
            places = [at[:, 4] + nth // at[:, 3], at[:, 5] + nth % at[:, 3] * size]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, places)], [*kept, "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.select(*kept, "_rank").mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
