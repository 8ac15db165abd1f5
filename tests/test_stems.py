"""Stems of words whose stems are published with the algorithm."""

from pyspark.sql import functions as F

from agora.functions.stems import stem
from agora.operators import postings

STEMS = "consign consign, consigned consign, consigning consign, consistency consist, consistent consist, consistently consist, consists consist, consolation consol, consolations consol, consolatory consolatori, consolidate consolid, consolidated consolid, knack knack, knackeries knackeri, knavish knavish, kneel kneel, kneeled kneel, knightly knight, knots knot, knotted knot, generously generous, generate generat, happy happi, ties tie, cries cri, gas gas, gaps gap, kiwis kiwi, this this, hopping hop, hoping hope, luxuriated luxuri, nationality nation, agreed agre, feed feed, dying die, skies sky, news news, inning inning, by by, say say, cry cri, enjoy enjoy, relational relat, hopefulness hope, formative format, adoption adopt, probate probat, controll control, communism communism, i i, yes yes, youth youth, vietnamization vietnam, bed bed, sing sing, bled bled"


def test_stems(spark):
    pairs = [tuple(p.split()) for p in STEMS.split(", ")]
    frame = spark.createDataFrame(pairs, "word string, want string")
    assert [tuple(r) for r in frame.withColumn("got", stem(F.col("word"))).filter("got is distinct from want").collect()] == []
    assert spark.range(1).select(stem(F.lit(None).cast("string"))).first()[0] is None and spark.range(1).select(stem(F.lit(""))).first()[0] == ""


def test_index_of_stems(spark):
    rows = spark.createDataFrame([(1, "Taxing the schools"), (2, "a school taxed twice, taxes on taxes"), (3, "nothing of it")], "id int, text string")
    index = postings.index(rows, "id", {"text": "D"}, english=True)
    terms = postings.stems_of(spark, postings.query_terms("school taxes and taxation of a tax"))
    assert terms == ["school", "tax", "taxat"]
    found = {r["id"]: [[h["position"] for h in hits] for hits in r["hits"]] for r in postings.matches(index, terms[:2]).collect()}
    assert found == {1: [[3], [1]], 2: [[2], [3, 5, 7]]}
