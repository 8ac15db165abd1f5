"""What the check tool found too dear: each step on a small scale, with its results."""

import hashlib
import timeit

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

from agora.llm import alignment, catalog, lm, minhash, packing, passages
from agora.llm.common import Workspace


def test_words_are_cut_at_the_cost_of_a_split():
    text = "größe um ein Maß,\tund noch\r\nmehr davon. " * 3_000
    spaces = str.maketrans("\t\n\r", "   ")
    assert packing._words(text) == text.translate(spaces).split(" ")
    cost = lambda f: min(timeit.repeat(f, number=1, repeat=7))
    assert cost(lambda: packing._words(text)) < 0.5 * cost(lambda: text.translate(spaces).split(" "))


def test_words_with_marks_get_the_ids_of_the_whole_text():
    encoder = packing.Encoder(catalog.tokenizer_path())
    texts = ["a $$$ a", "licensed under cc by-nc 4.0.", "Que, ks: ¡ción! x;y ... ,", "one\ttwo.\r\nthree?! one", "two, two. TWO; größe? GRÖSSE", "", "日本, one."]
    for _ in range(2):  # the second time from the store
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_a_pair_is_made_once_for_a_passage_that_all_hold(spark):
    """Thirty texts with one passage in common: a row a text meets the others, not one for each shingle of the passage."""
    passage = " ".join(f"p{k}" for k in range(88))
    texts = spark.createDataFrame([(i, f"{passage} " + " ".join(f"t{i}x{k}" for k in range(10))) for i in range(30)], "doc_id bigint, text string")
    ws, rows = Workspace(spark, "costs"), []
    keep = ws.keep

    def counted(frame, label):
        kept = keep(frame, label)
        if label == "rare":
            rows.append(kept.count())
        return kept

    ws.keep = counted
    pairs = minhash.pairs_by_rare_shingles(texts.selectExpr("doc_id", "doc_id as label"), texts, ws).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(a, b) for a in range(30) for b in range(a)}
    assert rows == [30]


def test_copies_with_edits_of_their_own_make_no_pair_each(spark, monkeypatch):
    """120 texts with four words of their own each are near to the text they come from, which has the largest id, and not to each other."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        words = list(base)
        for k, at in enumerate(rng.choice(np.arange(1, 29), 4, replace=False) * 5):
            words[at] = f"t{i}x{k}"
        rows.append((i, " ".join(words)))
    pairs, confirm = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda p, texts: pairs.append(p.count()) or confirm(p, texts))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), Workspace(spark, "costs")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, 0, i == 0) for i, _ in rows}
    assert sum(pairs[1:]) < 2 * len(rows)


def test_what_scoring_sends_to_the_tasks_is_gone_after_it(spark, monkeypatch):
    """A second call on the same executors doesn't find the first one's filter and counts of words beside its own."""
    sent, gone = [], []
    send, destroy = spark.sparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(send(value)) or sent[-1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(self) or destroy(self, *a))
    docs = spark.createDataFrame([(i, f"a b c d{i % 3} a b") for i in range(40)], "doc_id bigint, text string")
    for filter_bytes, n in ((lm.FILTER_BYTES, 2), (1, 3)):
        got = lm.score_documents(docs, Workspace(spark, "costs"), filter_bytes)
        assert len(sent) == n and gone == sent
        assert got.count() == 40


def test_passages_leave_no_tables_of_steps_behind(spark, monkeypatch):
    """Verified in parts or at once, the passages are the same, and only what the result reads is left."""
    line = [" ".join(f"l{i}x{k}" for k in range(70)) for i in range(4)]
    rows = [(i, f"{line[i % 4]} " + " ".join(f"t{i}x{k}" for k in range(60)) + f" {line[i // 4]}") for i in range(16)]
    docs, out = spark.createDataFrame(rows, "doc_id bigint, text string"), []
    for share in (passages.PAIRS_PER_DOCUMENT, 0.2):
        monkeypatch.setattr(passages, "PAIRS_PER_DOCUMENT", share)
        ws, labels = Workspace(spark, "costs"), {}
        keep, remove = ws.keep, ws.remove
        monkeypatch.setattr(ws, "keep", lambda f, label: (kept := keep(f, label), labels.update({ws._paths[kept]: label}))[0])
        monkeypatch.setattr(ws, "remove", lambda path: labels.pop(path) and remove(path))
        out.append(sorted(map(tuple, passages.repeated_passages(docs, ws).collect())))
        assert not {"sketches", "values", "slices", "open", "common", "rest", "viable"} & {*labels.values()}
    assert len(out[0]) > 16 and out[0] == out[1]


def test_more_links_join_labels_and_not_all_links_again(spark, monkeypatch):
    """Labels after more links are those of all links together; only what the new ones connect is looked at."""
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    links, more = [(2, 1), (3, 2), (9, 7), (8, 7), (20, 19)], [(9, 3), (30, 8), (41, 40)]
    ws, sizes, components = Workspace(spark, "costs"), [], minhash.components
    labels = ws.keep(components(frame(links), ws), "labels")
    monkeypatch.setattr(minhash, "components", lambda f, ws: sizes.append(f.count()) or components(f, ws))
    got = minhash._merged(labels, frame(more), ws).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, components(frame(links + more), ws).collect()))
    assert sizes == [len(more)]


def test_shared_shingles_are_ordered_once(spark, monkeypatch):
    """A base with the largest id, and copies that are near to it only: the star joins labels, and places stay as they are."""
    base, rows = [f"w{k}" for k in range(150)], [(1000, " ".join(f"w{k}" for k in range(150)))]
    rows += [(i, " ".join(f"t{i}x{k}" if k % 37 == i % 37 and k > 4 else w for k, w in enumerate(base))) for i in range(40)]
    calls, prefixes = [], minhash._prefixes
    monkeypatch.setattr(minhash, "_prefixes", lambda *a: calls.append(1) or prefixes(*a))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), Workspace(spark, "costs")).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 41 and len(calls) == 1


def test_passages_take_little_beside_what_is_shared(spark, monkeypatch):
    """Whole windows are kept for values that several texts have only, copies not counted, and later rounds read the texts that are still open."""
    line = [" ".join(f"l{i}x{k}" for k in range(70)) for i in range(4)]
    rows = [(i, f"{line[i % 4]} " + " ".join(f"t{i}x{k}" for k in range(60)) + f" {line[i // 4]}") for i in range(16)]
    rows += [(100 + i, " ".join(f"own{i // 5}x{k}" for k in range(90))) for i in range(50)]
    rows += [(50 + i, " ".join(f"e{i}x{k}" if k % 40 == 7 * i else f"b{k}" for k in range(200))) for i in range(4)]
    ws, read, kept = Workspace(spark, "costs"), [], {}
    verify, keep = passages._verify, ws.keep
    monkeypatch.setattr(passages, "_verify", lambda spans, docs, *rest: (read.append(docs.count()), verify(spans, docs, *rest))[1])
    monkeypatch.setattr(ws, "keep", lambda f, label: (out := keep(f, label), kept.setdefault(label, out.count()))[0])
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), ws).collect()
    assert sum(r["doc_id"] >= 100 for r in found) == 40 and len({r["doc_id"] for r in found if r["doc_id"] < 50}) == 15
    assert read[0] == 70 and len(read) > 1 and max(read[1:]) <= 20
    windows = passages.windows(passages.sketches(spark.createDataFrame(rows[:16] + rows[66:], "doc_id bigint, text string")))
    shared = windows.groupBy("value").count().filter("count > 1")
    assert kept["values"] == shared.count() and kept["shared"] == windows.join(shared, "value").count()


def test_texts_of_pairs_are_cut_once_and_hopeless_pairs_left():
    texts = pa.array(["a b c d e f g", "x y z u v w", "a b c d e f g"])
    found, at, which = passages._shingles_of(texts)
    assert len(at) == 3 and which.tolist() == [0, 1, 0] and len(found) == 5
    hit = np.ones(60, bool)
    hit[20:40] = False
    assert not passages._enough_hits(hit) and not passages._enough_hits(hit[:45])
    hit[25:40] = True
    assert passages._enough_hits(hit) and not passages._enough_hits(hit[:45] & False)


def test_links_and_groups_of_texts_end_to_end():
    """Two texts and an empty one between: A ends at 2, 3, 6 and B at 1, 3, 6 of the first; one token each in the last."""
    letters = [alignment._letters(100, mark) for mark in ",|;"]
    sizes = [np.array(x) for x in ([2, 1, 3, 4], [1, 2, 3, 4])]
    links, n_links, n_groups, digests = alignment._cut(np.array([10, 0, 12, 7]), sizes[0], np.array([20, 21, 22, 7]), sizes[1], np.array([6, 6, 10]), letters)
    assert [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()] == [(10, 20), (10, 21), (0, 21), (12, 22), (7, 7)]
    assert n_links.tolist() == [4, 0, 1] and n_groups.tolist() == [2, 0, 1]
    assert digests == [hashlib.sha256(b"10,0|20,21;12|22").hexdigest(), "", hashlib.sha256(b"7|7").hexdigest()]


def test_scoring_by_segments_keeps_rows_small(spark, monkeypatch):
    """No row holds a chunk of texts or a segment of the filter: the memory of an executor would grow with them."""
    kept, keep = [], Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, frame, label: kept.append(keep(self, frame, label)) or kept[-1])
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(300)], "doc_id bigint, text string")
    far = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, Workspace(spark, "costs"), filter_bytes=1).collect()}
    assert not [c for t in kept for c, kind in t.dtypes if kind == "array<string>"]
    sizes = [t.agg(F.max(F.length(c))).first()[0] for t in kept for c in ("text", "bits") if c in t.columns]
    assert len(sizes) == 2 and max(sizes) <= 1 << 18
    near = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, Workspace(spark, "costs")).collect()}
    assert far == near
