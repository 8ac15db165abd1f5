"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate links.

A text's set is its distinct shingles of five words. One hash of each shingle gives its bin and its value; a bin's
least value is the bin's entry, and an empty bin borrows that of the first filled bin in an order of its own, the same
for all texts. Bands of entries are bucket keys. In a bucket every member is compared with the least member only, on
full sets, so a bucket makes as many pairs as it has members. Where this leaves members in more than one component, an
exact search among those members finds the links that a star can miss: only sets that share one of their rarest
shingles, at places where enough of both is still to come, are compared. Of a shingle's holders those of other
components are held against the one with least of its own first, which is one more star, and what that joins needs no
pairs any more. Documents with equal sets are one before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, chunks, mix, shingle_hashes, word_hashes
from .components import components

WIDTH = 5
#: 32 bands of 4: a pair at a similarity of 0.75 shares no bucket with a chance of (1 - 0.75**4)**32, 5 in a million.
BINS, BANDS = 128, 32
#: Links hold from this similarity on, in hundredths.
PERCENT = 75

_ORDER = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1 << 50)).reshape(BINS, BINS), axis=1)
_LAST = np.uint64(64 - BINS.bit_length() + 1)


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in rising order, and the texts' n + 1 offsets among them."""
    words, offsets, _ = word_hashes(texts, lower=True)
    found, places = shingle_hashes(words, offsets, WIDTH, short=True)
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        found[a:b].sort()
    if not len(found):
        return found, places
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    fresh[places[:-1][places[:-1] < len(found)]] = True
    return found[fresh], np.concatenate([[0], np.cumsum(fresh)])[places]


def entries(found: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The densified bins of each text with a set: texts x BINS."""
    n = len(places) - 1
    owner = np.repeat(np.arange(n), np.diff(places))
    cell = owner * BINS + (found >> _LAST).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    values = np.zeros(n * BINS, np.uint64)
    filled = np.zeros(n * BINS, bool)
    values[cell[first]], filled[cell[first]] = found[first], True
    out = values.copy()
    some = np.repeat(np.diff(places) > 0, BINS)
    empty = np.flatnonzero(~filled & some)
    for t in range(BINS):
        if not len(empty):
            break
        source = empty - empty % BINS + _ORDER[empty % BINS, t]
        have = filled[source]
        out[empty[have]] = values[source[have]]
        empty = empty[~have]
    return out.reshape(n, BINS)


def bands_of(matrix: np.ndarray) -> np.ndarray:
    """Bucket keys, texts x BANDS; a band's number is part of its keys."""
    parts = matrix.reshape(len(matrix), BANDS, BINS // BANDS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, k])
    return key


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            found, places = sets_of(batch.column("text"))
            counts = np.diff(places)
            total = np.zeros((2, len(found) + 1), np.uint64)
            np.cumsum(mix(found), out=total[0, 1:])
            np.cumsum(mix(found ^ np.uint64(0x5DEECE66D)), out=total[1, 1:])
            keys = (total[:, places[1:]] - total[:, places[:-1]]).view(np.int64)
            some = counts > 0
            bands = np.zeros((len(counts), BANDS), np.uint64)
            if some.any():
                bands[some] = bands_of(entries(found, places)[some])
            flat = pa.array(bands.view(np.int64).reshape(-1))
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(np.repeat(some, BANDS))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(keys[0]), pa.array(keys[1]), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, k1 and k2 (equal for equal sets), bands (none for an empty set)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(_sketch, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "ta"):
            sa, pa_ = sets_of(batch.column("ta"))
            sb, pb = sets_of(batch.column("tb"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = sa[pa_[i] : pa_[i + 1]], sb[pb[i] : pb[i + 1]]
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if not small or 100 * small < PERCENT * large:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], ["a", "b", "linked"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether their full sets are similar enough. ``texts``: doc_id, text."""
    sides = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return sides.select("a", "b", "ta", "tb").mapInArrow(_compare, "a bigint, b bigint, linked boolean")


def _rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            found, places = sets_of(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            counts = np.diff(places)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.repeat(counts, counts)), pa.array(found.view(np.int64))], ["doc_id", "n", "shingle"])


def _possible(shingles: DataFrame, ws: Workspace) -> DataFrame:
    """``shingles`` (doc_id, label, n, shingle) with ``df`` and ``c``, without documents that can be linked with no other label.

    A shingle that only one label has is in no intersection that matters, so ``c``, the number of a document's other
    shingles, bounds all of its intersections. One below three quarters of the set rules the document out.
    """
    shared = shingles.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    common = ws.keep(shingles.select("doc_id", "label", "n", "shingle").join(shared.select("shingle", "df"), "shingle"), "common")
    counts = common.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter(100 * F.col("c") >= PERCENT * F.col("n"))
    return ws.keep(common.join(counts.select("doc_id", "c"), "doc_id"), "possible")


def _first_of_holders(rare: DataFrame, ws: Workspace) -> DataFrame:
    """``rare`` (doc_id, df, shingle, ...) with one shingle of those that the same documents hold: the first in order of df and shingle.

    The first shingle that two documents share is the first of all those that its holders share, so it stays; if places
    allow a pair at a later one, they do so there. Holders are told apart by 128 bits and their number.
    """
    rare = ws.keep(rare, "prefixes")
    holders = rare.groupBy("df", "shingle").agg(F.bit_xor(F.xxhash64("doc_id")).alias("h1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h2"), F.count("*").alias("m")).filter("m > 1")
    first = holders.groupBy("h1", "h2", "m").agg(F.min(F.struct("df", "shingle")).alias("w")).select(F.col("w.shingle").alias("shingle"))
    return rare.join(first, "shingle")


def _shingled(texts: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n (size of the set) and shingle of every document of ``texts``."""
    return ws.keep(texts.dropDuplicates(["doc_id"]).mapInArrow(_rare_pairs, "doc_id bigint, n bigint, shingle bigint"), "shingled")


def _able(rows: DataFrame, ws: Workspace) -> DataFrame:
    """``rows`` (doc_id, label, n, c, place, shingle, ...) without those at whose place no holder of another label can be a partner.

    From its place on a set has ``most`` shared shingles left. As the smaller of two it needs six sevenths of its own size,
    as the larger one three sevenths of both sizes, and no holder is smaller than the least one. Both bounds hold at the
    first shingle that two linked sets share, so that row stays in either.
    """
    rows = rows.withColumn("most", F.least("c", F.col("n") - F.col("place") + 1))
    least = rows.groupBy("shingle").agg(F.min("n").alias("least"))
    smaller = (100 + PERCENT) * F.col("most") >= 2 * PERCENT * F.col("n")
    larger = (100 + PERCENT) * F.col("most") >= PERCENT * (F.col("n") + F.greatest("least", F.ceil(PERCENT * F.col("n") / 100)))
    able = ws.keep(rows.join(least, "shingle").filter(smaller | larger).drop("least", "most"), "able")
    several = able.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("shingle")
    return able.join(several, "shingle", "left_semi")


def _prefixes(shingled: DataFrame, members: DataFrame, ws: Workspace) -> DataFrame:
    """Where pairs of different labels may begin: doc_id, label, n, c, place, shingle."""
    rows = _possible(shingled.join(members, "doc_id"), ws)
    rows = _possible(rows.select("doc_id", "label", "n", "shingle"), ws)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "shingle")) + F.col("n") - F.col("c")
    rare = rows.withColumn("place", place).filter(100 * (F.col("place") - 1) <= (100 - PERCENT) * F.col("n"))
    return ws.keep(_first_of_holders(_able(ws.keep(rare, "places"), ws), ws).select("doc_id", "label", "n", "c", "place", "shingle"), "rare")


def _partners(name: str) -> list:
    return [F.col(c).alias(d) for c, d in (("doc_id", "b"), ("label", "lb"), ("n", "nb"), ("c", "cb"), ("place", "at"))] + [F.col(name)]


def _enough():
    to_come = F.least("c", "cb", F.col("n") - F.col("place") + 1, F.col("nb") - F.col("at") + 1)
    return (100 + PERCENT) * to_come >= PERCENT * (F.col("n") + F.col("nb"))


def _central_pairs(rare: DataFrame) -> DataFrame:
    """Of each shingle's holders those of other labels against the one that has least of its own: a pair a row at most.

    Copies that differ from one text in places of their own are near to that text before they are to each other. If it is
    among them, it has all of its shingles in common with others.
    """
    best = F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("doc_id")).alias("d"), "doc_id", "label", "n", "c", "place")).alias("w")
    centres = rare.groupBy("shingle").agg(best).select("w.*", "shingle").select(_partners("shingle"))
    alike = (F.col("lb") != F.col("label")) & (100 * F.least("n", "nb") >= PERCENT * F.greatest("n", "nb"))
    pairs = rare.join(centres, "shingle").filter(alike & _enough())
    return pairs.select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()


def _all_pairs(rare: DataFrame) -> DataFrame:
    small = rare.filter((100 + PERCENT) * (F.col("place") - 1) <= (100 - PERCENT) * F.col("n")).select(_partners("shingle"))
    smaller = (F.col("nb") < F.col("n")) | ((F.col("nb") == F.col("n")) & (F.col("b") < F.col("doc_id")))
    pairs = rare.join(small, "shingle").filter(smaller & _enough() & (F.col("lb") != F.col("label")) & (100 * F.col("nb") >= PERCENT * F.col("n")))
    return pairs.select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()


def pairs_by_rare_shingles(members: DataFrame, texts: DataFrame, ws: Workspace) -> DataFrame:
    """Every pair of ``members`` (doc_id, label) of different labels that can be linked: an exact way, for what stars left.

    Two linked sets have at least (na + nb) * 75 / 175 shingles in common, all of them among those that several labels
    have. With the rarest first, places that only the own label's shingles take up before those, the first one they share
    stands where as many are still to come in either. A pair is made only from such places, and only where both sets
    have enough shared shingles for it: sets that differ from one text in places of their own haven't.
    """
    mine = members.select("doc_id", "label").distinct()
    return _all_pairs(_prefixes(_shingled(texts.join(mine.select("doc_id"), "doc_id", "left_semi"), ws), mine, ws))


def _merged(labels: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """``labels`` (node, label) after more ``links`` (a, b): components of the labels that they connect, which are few. A node without a label is its own."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    fresh = ws.keep(components(between, ws), "merged")
    changed = labels.join(fresh.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return ws.keep(changed.unionByName(fresh.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")


def near_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns aren't read): doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and are linked with nothing; very long ones are compared whole. Rows with equal ids count as one document
    for links and each get a row. Of a component the row with the least doc_id is kept. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = ws.keep(sketches(docs), "sketches")
    classes = ws.keep(sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    ours = sketched.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    banded = ours.select("doc_id", F.explode("bands").alias("bucket"))
    centres = ws.keep(banded.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).filter("centre <> last").select("bucket", "centre"), "centres")
    starred = ws.keep(banded.join(centres, "bucket"), "starred")
    first_pairs = ws.keep(starred.filter("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    involved = ws.keep(starred.select("doc_id").distinct(), "involved")
    ws.sweep()
    texts = ws.keep(docs.join(involved, "doc_id", "left_semi"), "texts")
    ws.sweep()
    tested = ws.keep(confirm(first_pairs, texts), "tested")
    ws.sweep()
    links = tested.filter("linked").select("a", "b")
    labels = ws.keep(components(links, ws), "labels")
    # a centre has met all others of its bucket and leaves; buckets within one component are done
    labelled = starred.filter("doc_id <> centre").select("bucket", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    left = ws.keep(labelled.select("bucket", "doc_id", F.coalesce("label", "doc_id").alias("label")), "left")
    open_ones = left.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    members = ws.keep(left.join(open_ones, "bucket", "left_semi").select("doc_id", "label").distinct(), "members")
    shingled = _shingled(texts.join(members.select("doc_id"), "doc_id", "left_semi"), ws)
    rare = _prefixes(shingled, members, ws)
    central = ws.keep(_central_pairs(rare).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "central")
    second = ws.keep(confirm(central, texts), "tested")
    if not second.filter("linked").isEmpty():
        labels = _merged(labels, second.filter("linked").select("a", "b"), ws)
        # labels only grow together: places and bounds by the labels before hold for fewer pairs too
        renamed = rare.drop("label").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        rare = ws.keep(_able(ws.keep(renamed, "places"), ws), "rare")
    known = tested.select("a", "b").unionByName(second.select("a", "b"))
    pairs = ws.keep(_all_pairs(rare).join(known, ["a", "b"], "left_anti"), "pairs")
    more = ws.keep(confirm(pairs, texts).filter("linked").select("a", "b"), "tested")
    if not more.isEmpty():
        labels = _merged(labels, more, ws)
    # what the result reads is sketched, classes and labels
    ws.drop(centres, starred, first_pairs, involved, texts, tested, left, members, shingled, rare, central, second, pairs, more)
    keyed = sketched.drop("bands").join(classes, ["k1", "k2"], "left")
    named = keyed.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    # an empty set has a class of its own
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` without those that a smaller doc_id of their component stands for, all columns as they are.

    Of rows with equal ids one stays; rows with a null id, which are linked with nothing, all stay.
    """
    gone = ws.keep(near_duplicates(docs, ws).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    left = docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
    repeated = ws.keep(docs.select("doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
