"""Language-model scores, tokenizer alignment and whitening, held against plain versions."""

import dataclasses
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agora.llm import alignment, catalog, lm, whitening
from agora.llm.common import Workspace, word_hashes

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
DOCS = "doc_id bigint, text string, source string, row string, links string, segment int"
ODD = [(1, None, None, "a", "x", 1), (2, "", "s", None, None, 2), (3, " \t\n", "s", "a", "x", 3), (4, "one Two", "s", "a", "x", 3), (4, "one Two", "s", "a", "x", 3), (None, "one two", None, "a", "x", 3), (5, LONG, "s", "a", "x", 3), (7, "É▁x <|endoftext|>  two   blanks\n\n\n here \x00 ￿ 日本 🙂 z ", "t", "a", "x", 3), (8, "<s> </s> <unk> <0x0A>", "t", "a", "x", 3), (9, "tab\tand\x1c\x85 x\n y\n  z \n", "t", "a", "x", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, DOCS).select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_scores_against_exact_counts(spark, docs):
    """The base columns exactly; the model against the same formula on exact counts."""
    rows = docs.collect()
    single, pairs, after = Counter(), Counter(), Counter()
    for r in rows:
        if not is_held(r["doc_id"]):
            seq = ["<begin>", *words(r["text"]), "<end>"]
            single.update(seq[1:])
            for p in zip(seq, seq[1:], strict=False):
                pairs[p] += 1
                after[p[0]] += pairs[p] == 1
    n, v = sum(single.values()), len(single)
    seen = single | {"<begin>": single["<end>"]}

    def model(seq):
        total = 0.0
        for h, w in zip(seq, seq[1:], strict=False):
            alone = (single[w] + 0.1) / (n + 0.1 * (v + 1))
            t = after[h] or 1
            total += math.log10((pairs[h, w] + t * alone) / (seen[h] + t) if seen.get(h) else alone)
        return total

    def plain(r):
        seq = [*words(r["text"]), "<end>"]
        return r["doc_id"], is_held(r["doc_id"]), len(seq), sum(single[w] > 0 for w in seq), n

    got = lm.score_documents(docs, Workspace(spark, "lm")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(map(plain, rows), key=repr)
    by_id = {r["doc_id"]: r for r in rows}
    errors = []
    for r in got:
        seq = [*words(by_id[r["doc_id"]]["text"]), "<end>"]
        assert r["base_score"] == pytest.approx(sum(math.log10((single[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq), rel=1e-9)
        errors.append((r["score"] - model(["<begin>", *seq])) / len(seq))
    assert np.abs(errors).mean() < 0.02 and max(errors) < 0.3
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_other_ways_give_the_same_scores(spark, docs, monkeypatch):
    """A filter too large to be broadcast, words too many to be broadcast, several segments, common words spread over them."""
    small = docs.filter("length(text) < 20000 or text is null")
    monkeypatch.setattr(lm, "SEGMENT_TOKENS", 4000)
    one = lm.score_documents(small, Workspace(spark, "lm")).collect()
    monkeypatch.setattr(lm, "PROBE_BYTES", 20_000)
    other = lm.score_documents(small, Workspace(spark, "lm"), filter_bytes=1000, broadcast_words=500).collect()
    key = lambda r: repr(tuple(r)[:4])
    for x, y in zip(sorted(one, key=key), sorted(other, key=key), strict=True):
        assert tuple(x)[:5] == tuple(y)[:5] and x["score"] == pytest.approx(y["score"], rel=1e-12) and x["base_score"] == pytest.approx(y["base_score"], rel=1e-9)


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert lm.score_documents(none, Workspace(spark, "lm")).count() == 0
    only_held = [(i, "some text", None, None, None, 1) for i in range(100) if is_held(i)]
    rows = lm.score_documents(spark.createDataFrame(only_held, DOCS), Workspace(spark, "lm")).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows} == {(0, 0, 0.0, 0.0)}


def test_probabilities_sum_to_one(spark):
    """After each of several words, over the whole vocabulary and one unknown word."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, 60) if k < 400)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = lm.word_counts(docs, Workspace(spark, "lm"))
    model, bits = lm.train(docs, counts, Workspace(spark, "lm"))
    filter = lm.Filter.of({r["segment"]: np.frombuffer(r["bits"], "<u8") for r in bits.collect()}, model.layout.segments)
    vocabulary = sorted({w for _, t in rows for w in t.split()})
    for h in ("w1", "w2", "w7", "w40", "never"):
        asked = model.asks(pa.array([h, *(f"{h} {w}" for w in [*vocabulary, "unseen"])]))
        levels = filter.levels(asked.segments, asked.keys, asked.kinds)
        n = np.arange(len(asked.a))
        each = 10 ** model.scores(dataclasses.replace(asked, of_pair=n, begin=2 * n), levels)  # one pair a text
        after_h = asked.words[asked.a] == word_hashes(pa.array([h]), True)[0][0]
        assert after_h.sum() == len(vocabulary) + 2 and (each > 0).all() and (each <= 1).all()
        assert 0.85 < each[after_h].sum() < 1.1


def test_levels_come_back():
    """What goes in at a level is found at that level, or above it at the rate of false positives."""
    rng = np.random.default_rng(8)
    keys = rng.integers(1, 1 << 63, 20_000).astype(np.uint64)
    level = lm.level_of(np.minimum(rng.zipf(1.7, 20_000), 10**6))
    bits = lm.bits_of(np.concatenate([lm._events(keys, k, level) for k in range(3)]))
    filter = lm.Filter.of({0: bits}, 0)
    for kind in range(3):
        got = filter.levels(np.zeros(len(keys), np.int64), keys, np.full(len(keys), kind)).astype(int)
        assert (got >= level).all() and (got > level).mean() < 0.04
    absent = filter.levels(np.zeros(20_000, np.int64), rng.integers(1, 1 << 63, 20_000).astype(np.uint64), np.zeros(20_000, np.int64))
    assert (absent > 0).mean() < 0.04


def plain_alignment(rows):
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path("byte_bpe_50k.json")
    a_model = Tokenizer.from_file(path)
    a_model.encode_special_tokens = True
    letters = alignment._byte_letters()
    names = {i: t for t, i in json.load(open(path))["model"]["vocab"].items()}
    b_model = sentencepiece.SentencePieceProcessor(model_file=catalog.tokenizer_path("piece_bpe_32k.model"))
    docs = []
    for i, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in names[x]) if x in names else b"?" for x in a]
        b_bytes = []
        for x in b:
            p = b_model.id_to_piece(x)
            b_bytes.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
        if text and not b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
            a = b = []
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist()[: len(a)], np.cumsum([len(x) for x in b_bytes]).tolist()[: len(b)]
        links, groups, x, y, from_x, from_y = [], [], 0, 0, 0, 0
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            if a_end[x] == b_end[y]:
                groups.append(",".join(map(str, a[from_x : x + 1])) + "|" + ",".join(map(str, b[from_y : y + 1])))
                x, y = x + 1, y + 1
                from_x, from_y = x, y
            elif a_end[x] < b_end[y]:
                x += 1
            else:
                y += 1
        docs.append((i, len(a), len(b), groups, links))
    counts = Counter(p for *_, links in docs for p in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(i, n_a, n_b, len(g), len(x), sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, n_a, n_b, g, x in docs]


@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_alignment_against_a_plain_merge(spark, docs, limit):
    paths = [catalog.tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    some = docs.filter("doc_id % 3 = 0 or doc_id > 9000 or doc_id is null")
    got = alignment.align(some.withColumn("row", F.lit("r")), Workspace(spark, "a"), *paths, broadcast_pairs=limit)
    want = plain_alignment([(r["doc_id"], r["text"]) for r in some.collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 60 and sum(w[1] == 0 for w in want) >= 3
    assert alignment.align(docs.limit(0), Workspace(spark, "a"), *paths).count() == 0


def plain_whitening(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = np.array((fit * n - s), dtype=float) / n
    v = centred.T @ centred / n
    values, u = np.linalg.eigh(v)
    values, u = values[::-1][:16], u[:, ::-1][:, :16]
    own = x * n - s
    return n, [sum(int(c) ** 2 for c in r) for r in own], own.astype(float) / n @ u / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("tile", [32, 7])
def test_whitening_against_one_matrix(spark, tile):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(900, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    x[300:600] = x[0]
    rows = [(i, [float(c) for c in v], "k") for i, v in enumerate(x)]
    rows += [(None, rows[5][1], "k"), (7, rows[8][1], "k")]
    bad = [(900, None, "k"), (901, [None] + [1.0] * 19, "k"), (902, [float("nan")] * 20, "k"), (903, [float("inf")] * 20, "k"), (904, [1.0], "k"), (905, [], "k"), (906, [1e30] * 20, "k")]
    vectors = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, x string")
    got = whitening.whiten(vectors, Workspace(spark, "w"), tile=tile).collect()
    n, deviation, white, explained = plain_whitening([v for _, v, _ in rows])
    assert len(got) == 16 * len(rows)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, 17))
    for k, mine in by.items():
        assert {r["n"] for r in mine} == {n} and mine[0]["identity_error"] < 1e-6 and mine[0]["explained"] == pytest.approx(explained[k - 1], rel=1e-9)
        want = sorted(zip([-1 if r[0] is None else r[0] for r in rows], deviation, white[:, k - 1], strict=True), key=lambda r: r[:2])
        have = sorted(((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"], r["whitened"]) for r in mine), key=lambda r: r[:2])
        assert [r[:2] for r in have] == [r[:2] for r in want]
        sign = np.sign(have[10][2] * want[10][2])
        np.testing.assert_allclose([r[2] for r in have], [sign * r[2] for r in want], atol=1e-7)


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    white = lambda rows: whitening.whiten(make(rows), Workspace(spark, "w")).collect()
    assert white([]) == [] and white([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = white([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)])  # one direction alone varies
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1) and len(line) == 5
    far = white([(1, [-(2.0**38)] * 3), (2, [2.0**38] * 3), (3, [0.0, 1.0, 2.0])])
    assert all(r["deviation"] is None for r in far if r["vec_id"] < 3) and far
