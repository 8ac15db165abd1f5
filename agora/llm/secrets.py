"""Secret scans by way of a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match satisfies. Texts are
indexed in segments of a few megabytes, each in the task that reads it: a posting list per trigram that some query
names. A query's lists are intersected and united, and only the texts that remain are searched with the expression;
a rule without mandatory trigrams searches every text. Segments need no shuffle and no place on disk, and a lost one
is made again from its texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes

#: An alternative of so many exact strings at most is followed; beyond that a query is formed from what there is.
MAX_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches that don't overlap, of which those with enough characters in ``group`` count."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    #: Finds the same matches faster; only for rules whose failing matches hide no other.
    fast: str | None = None

    def compiled(self) -> re.Pattern[bytes]:
        return re.compile((self.fast or self.pattern).encode(), re.IGNORECASE if self.any_case else 0)


#: The base rules, in their order, then the method's own.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, fast=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 24, fast=r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]+", 39),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)

#: A query: True (any text), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple[str, frozenset]


def _join(kind: str, parts: list[Query]) -> Query:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat = frozenset().union(*(p[1] if isinstance(p, tuple) and p[0] == kind else {p} for p in parts))
    return next(iter(flat)) if len(flat) == 1 else (kind, flat)


def _of_strings(strings: set[bytes]) -> Query:
    """What texts with one of these strings have in common."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _walk(nodes) -> tuple[set[bytes] | None, Query]:
    """The strings that an expression matches, if they are few, else None and a query that its matches satisfy."""
    run: set[bytes] = {b""}
    found: list[Query] = []
    exact = True
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        found += [_of_strings(run), _of_strings(strings) if strings is not None else query]
        run, exact = {b""}, False
    return (run, _of_strings(run)) if exact else (None, _join("and", [*found, _of_strings(run)]))


def _node(op, arg) -> tuple[set[bytes] | None, Query]:
    name = str(op)
    if name == "LITERAL":
        return {bytes([arg]).lower()}, True
    if name == "IN":
        chars: set[bytes] = set()
        for kind, value in arg:
            if str(kind) != "LITERAL":
                return None, True
            chars.add(bytes([value]).lower())
        return chars, True
    if name == "SUBPATTERN":
        return _walk(arg[-1])
    if name == "BRANCH":
        sides = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in sides):
            strings = set().union(*(s for s, _ in sides))
            if len(strings) <= MAX_STRINGS:
                return strings, True
        return None, _join("or", [q for _, q in sides])
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, item = arg
        strings, query = _walk(item)
        if (low, high) == (1, 1):
            return strings, query
        if (low, high) == (0, 1) and strings is not None:
            return strings | {b""}, True
        return None, query if low else True
    return ({b""}, True) if name == "AT" else (None, True)


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-case trigrams that every text with a match satisfies."""
    strings, query = _walk(parser.parse(pattern.encode()))
    return _of_strings(strings) if strings is not None else query


def grams_of(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(grams_of, query[1]))


def postings(body: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> Callable[[bytes], np.ndarray]:
    """The inverted index of a segment: the numbers of the texts that hold a trigram, for trigrams that ``wanted`` marks."""
    upper = (body >= 65) & (body <= 90)
    low = np.where(upper, body + 32, body).astype(np.uint32)
    codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
    place = np.flatnonzero(wanted[codes])
    owner = np.searchsorted(at, place, side="right") - 1
    inside = place + 3 <= at[owner + 1]
    keys = np.unique((codes[place[inside]].astype(np.int64) << 32) | owner[inside])
    grams, texts = keys >> 32, keys & 0xFFFFFFFF

    def of(gram: bytes) -> np.ndarray:
        code = int.from_bytes(gram, "big")
        return texts[np.searchsorted(grams, code) : np.searchsorted(grams, code + 1)]

    return of


def candidates(query: Query, of: Callable[[bytes], np.ndarray], n: int) -> np.ndarray:
    """The texts of a segment that satisfy a query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return of(query)
    lists = sorted((candidates(q, of, n) for q in query[1]), key=len)
    out = lists[0]
    for x in lists[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


def spans_of(text: bytes, rule: Rule, search: re.Pattern[bytes]) -> list[tuple[int, int]]:
    """Byte ranges of a rule's secrets in a text."""
    return [m.span() for m in search.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """Per row: doc_id, ``n_<kind>`` of each base rule, base_sha256, spans, n_spans and n_searched (expressions run on the text).

    ``spans``: kind:start:end of all rules by start, then the rules' order, comma-joined, in code points, end exclusive;
    base_sha256 is the hash of the same string of the base rules. Null and empty texts have none. Repeated rows and null
    ids each get a row. Only doc_id and text are read, and an empty table gives no rows.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    counts = [f"n_{r.kind}" for r in rules[:base]]
    names = ["doc_id", *counts, "base_sha256", "spans", "n_spans", "n_searched"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_sha256 string, spans string, n_spans bigint, n_searched bigint"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << 24, bool)
        for g in set().union(*map(grams_of, queries)):
            wanted[int.from_bytes(g, "big")] = True
        compiled = [r.compiled() for r in rules]
        for whole in batches:
            for batch in chunks(whole, "text"):
                n = batch.num_rows
                body, at = text_bytes(batch.column("text"))
                raw, ends = body.tobytes(), at.tolist()
                of = postings(body, at, wanted)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
                searched = np.zeros(n, np.int64)
                for k, (rule, query, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
                    which = candidates(query, of, n)
                    searched[which] += 1
                    for i in which.tolist():
                        found[i] += [(a, k, b) for a, b in spans_of(raw[ends[i] : ends[i + 1]], rule, regex)]
                rows: list[tuple] = []
                for i in range(n):
                    spans = sorted(_points(raw[ends[i] : ends[i + 1]], found[i]))
                    said = [(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in spans]
                    own = [k for k, _ in said if k < base]
                    digest = hashlib.sha256(",".join(s for k, s in said if k < base).encode()).hexdigest()
                    rows.append((*(own.count(k) for k in range(base)), digest, ",".join(s for _, s in said), len(said), int(searched[i])))
                types = [*[pa.int64()] * base, pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(search, schema)
