"""Alignment of two tokenizers over the same bytes.

A chunk of texts is tokenised both ways and cut in Arrow batches: offsets where tokens of both end cut the texts into groups,
and every offset where one of either ends ends one overlap of an A token with a B token, a link. Spark deals out the
texts, counts the documents of each linked pair over all of them and brings the counts back to the links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, chunks

#: Pairs of ids sent to the tasks at once; of more, those that are in over a share of 1 / PAIRS of all (so fewer) are, the rest is joined.
PAIRS = 2_000_000
_SPACE = "▁"
#: Fixed value: how a byte-level vocabulary of this kind cuts texts before it merges bytes.
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Ids of both tokenizers, and where their tokens end."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = _byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_flat, self.b_start, self.b_size = _flat([_piece_bytes(self.b, i) for i in range(self.b.get_piece_size())])
        most = max(len(self.a[1]), len(self.b_size))
        self.letters = [_letters(most, mark) for mark in ",|;"]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: the ids of all texts and their byte lengths, end to end, and the n + 1 places where texts begin.

        A text that is null or empty, or whose bytes B changes, has none.
        """
        given = [t or "" for t in texts]
        raw = [(" " + t).encode() for t in given]
        a = [self.a[0](" " + t) if t else [] for t in given]
        b = self.b.encode(given, num_threads=1)
        ids = [np.fromiter(chain.from_iterable(x), np.int32) for x in (a, b)]
        at = [np.concatenate([[0], np.cumsum([len(x) for x in y])]) for y in (a, b)]
        sizes = [self.a[1][ids[0]], self.b_size[ids[1]]]
        same = np.array([bool(t) for t in given], bool) & self._same(raw, ids[1], sizes[1], at[1])
        out = []
        for k in range(2):
            keep, count = np.repeat(same, np.diff(at[k])), np.where(same, np.diff(at[k]), 0)
            out.append((ids[k][keep], sizes[k][keep], np.concatenate([[0], np.cumsum(count)])))
        return out

    def _same(self, raw: list[bytes], ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the bytes of B's tokens are a text's own; those of A always are."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        body = self.b_flat[np.arange(ends[-1]) + np.repeat(self.b_start[ids] - ends[:-1], sizes)].tobytes()
        return np.array([body[ends[x] : ends[y]] == r for x, y, r in zip(at[:-1], at[1:], raw, strict=True)], bool)


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_SPACE, " ").encode()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _byte_level(path: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """What encodes a text with a byte-level vocabulary, special tokens' strings as plain text, and each id's number of bytes.

    Where merges stand in the order of their ids, a faster encoder over the same vocabulary gives the same ids.
    """
    import tiktoken
    from tokenizers import Tokenizer

    letters = _byte_letters()
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    told = json.loads(slow.to_str())
    ranks = {bytes(letters[c] for c in t): i for t, i in told["model"]["vocab"].items() if all(c in letters for c in t)}
    sizes = np.zeros(max(told["model"]["vocab"].values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in told["model"]["merges"]]
    in_order = [told["model"]["vocab"][m] for m in merged]
    own = told["pre_tokenizer"] or {}
    if in_order == sorted(in_order) and len(ranks) == 256 + len(merged) and told["normalizer"] is None and own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space"):
        return tiktoken.Encoding("own", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes
    return lambda t: slow.encode(t, add_special_tokens=False).ids, sizes


def _letters(most: int, mark: str) -> np.ndarray:
    """For each id the bytes of its decimal form and of a mark, at most eight of them, as one long."""
    return np.array([f"{i}{mark}" for i in range(most)], "S8").view("<u8")


def _cut(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, bounds: np.ndarray, letters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of texts that lie end to end and end at ``bounds`` (bytes): all links, how many each text has, its groups, and their digest.

    A link has A's id in the upper half of a long, B's in the lower.
    """
    ends, before, at = [], [], []
    for size in (a_size, b_size):
        end = np.cumsum(size)
        one = np.zeros(int(bounds[-1]) + 1 if len(bounds) else 1, bool)
        one[end] = True
        total = np.cumsum(one, dtype=np.int32)
        ends.append(one)
        before.append(total - one)  # as many tokens end before an offset as stand before the one that holds the byte there
        at.append(end)
    places = np.flatnonzero(ends[0] | ends[1])
    links = (a[before[0][places]].astype(np.int64) << 32) + b[before[1][places]]
    both = ends[0] & ends[1]
    cuts = np.flatnonzero(both)
    counts = [np.diff(np.searchsorted(x, bounds, side="right"), prepend=0) for x in (places, cuts)]
    # a token's place in the groups' text: A's of a group stand before B's
    group = np.cumsum(both, dtype=np.int32) - both
    last = [both[x] for x in at]
    upto = [np.concatenate([[0], x[cuts] + 1]) for x in before]
    own = [group[x] for x in at]
    place = [np.arange(len(a)) + upto[1][own[0]], np.arange(len(b)) + upto[0][own[1] + 1]]
    text = np.zeros(len(a) + len(b), "<u8")
    text[place[0]] = np.where(last[0], letters[1][a], letters[0][a])
    text[place[1]] = np.where(last[1], letters[2][b], letters[0][b])
    tokens = sum(np.searchsorted(x, bounds, side="right") for x in at)
    size = np.concatenate([[0], np.cumsum(8 - (text.view(np.uint8).reshape(-1, 8) == 0).sum(1))])[np.concatenate([[0], tokens])]
    told = text.tobytes().translate(None, b"\0")
    digests = [hashlib.sha256(told[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
    return links, *counts, digests


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``links``: per overlap A's id in the upper half of a long, B's in the lower."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _ALIGNERS:
            _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
        aligner, row = _ALIGNERS[a_path, b_path], TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in chunks(whole, "text"):
                (a, a_size, a_at), (b, b_size, b_at) = aligner.encode(batch.column("text").to_pylist())
                bounds = np.concatenate([[0], np.cumsum(a_size)])[a_at[1:]]
                links, n_links, n_groups, digests = _cut(a, a_size, b, b_size, bounds, aligner.letters)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)), pa.array(links))
                rows = pa.array(np.arange(row, row + batch.num_rows))
                row += batch.num_rows
                numbers = [pa.array(x.astype(np.int64)) for x in (np.diff(a_at), np.diff(b_at), n_groups, n_links)]
                yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), *numbers, pa.array(digests, pa.string()), lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    kinds = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, kinds)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best: whether n is the highest of its A id, of which there are at most as many pairs as B has ids."""
    counts = links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", (F.col("n") == F.max("n").over(of_a)).cast("bigint"))


def align(docs: DataFrame, ws: Workspace, a_path: str, b_path: str, broadcast_pairs: int = PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose bytes a tokenizer changes, have no tokens: zeros and an empty string. Repeated
    rows are documents each and count each; null ids are kept; only doc_id and text are read. An empty table gives no rows.
    A very long text is one row; its arrays are as long as it has bytes.
    """
    links = ws.keep(aligned(docs, a_path, b_path), "links")
    pairs = ws.keep(pair_counts(links), "pairs")
    size, total = pairs.agg(F.count("*"), F.sum("n")).first()
    each = links.select("row", F.explode("links").alias("pair"))
    near = pairs if size <= broadcast_pairs else pairs.filter(F.col("n") * broadcast_pairs > total)  # fewer than so many either way
    looked = each.join(F.broadcast(near), "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    if size > broadcast_pairs:
        rest = each.join(F.broadcast(near.select("pair")), "pair", "left_anti").groupBy("row", "pair").agg(F.count("*").alias("times"))
        rest = rest.join(pairs, "pair").groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        looked = looked.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    told = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return links.drop("links").join(looked, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *told, "groups_sha256")
