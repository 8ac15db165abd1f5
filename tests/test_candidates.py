"""Odd cases of the operators on names, candidates and reports that no query shows."""

from pyspark.sql import functions as F

from agora.functions import names
from agora.operators import candidates, filters, merge, reporting, search


def told(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_names_without_a_first_word(spark):
    assert told(spark, names.person_name, None, "", "???") == [None, None, None]
    (one,) = told(spark, names.person_name, "John 'JJ' Smith-Jones V")
    assert one.asDict() == {"first": "John", "last": "Smith-Jones", "middle": None, "preferred": "JJ", "suffix": "V"}


def test_accents_and_doctors(spark):
    assert told(spark, names.normalize_name, "Dr. Zoë  Ñu - Åse", '"Dr. Jay" Bo', None) == ["Zoe Nu-Ase", '"Dr. Jay" Bo', None]


def test_insert_absent_keeps_one_of_repeated_rows(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c"), (3, None)], "k int, v string")
    assert sorted(map(tuple, merge.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, None)]


def test_reports_and_bulk_loads(spark, tmp_path):
    report = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, said string")
    reporting.write_csv(report, f"{tmp_path}/report")
    assert sorted(map(tuple, spark.read.csv(f"{tmp_path}/report", header=True, escape='"', schema=report.schema).collect())) == [(1, 'a "b", c'), (2, None)]
    for _ in range(2):
        merge.bulk_load(report, f"{tmp_path}/table", by=["id"])
    assert spark.read.parquet(f"{tmp_path}/table").count() == 2


def test_word_similarity(spark):
    said = told(spark, lambda t: F.round(search.word_similarity(t, "word two"), 6), "word", "words", "", "other")
    assert said[0] == 1.0 and said[1] < 1.0 and said[2] == 0.0 and 0 <= said[3] < 0.3


def test_filters_of_nulls(spark):
    f = F.col
    rows = spark.createDataFrame([(None, None), ("a-2", "[]"), ("a-b", '[{"x": 1}]')], "slug string, js string")
    got = rows.select(filters.slug_of(f("slug"), F.lit("a")), filters.json_has(f("js"), "x", F.lit(1)), filters.role_at_least(f("slug"), "x", ["x"])).collect()
    assert [r[0] or False for r in got] == [False, True, False] and [r[1] or False for r in got] == [False, False, True] and not any(r[2] for r in got)


def test_merge_keeps_what_is_known(spark):
    known = spark.createDataFrame([("a", 1, 5), ("b", 1, None)], "ref_key string, race int, votes int")
    races = spark.createDataFrame([(1, 50), (2, 60)], "race int, total_votes int")
    new = spark.createDataFrame([("a", None, 70), ("b", 8, None), ("c", 1, 1)], "ref_key string, votes int, total_votes int")
    out = candidates.merge_results(new, known, races)
    assert sorted(map(tuple, out["candidates"].select("ref_key", "votes").collect())) == [("a", 5), ("b", 8)]
    assert sorted(map(tuple, out["races"].collect())) == [(1, 70), (2, 60)]
    assert [r["ref_key"] for r in out["unmatched"].collect()] == ["c"]
    assert out["stats"].first().asDict() == {"n_rows": 3, "n_matched": 2, "n_races": 1, "n_unmatched": 1}
