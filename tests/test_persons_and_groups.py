"""Slugs, persons, opinion groups and ranks on small tables with the cases that went wrong or may."""

import random

import pytest
from pyspark.sql import functions as F

from agora.operators import candidates, groups, merge, postings, storage


def slugs(spark, bases, taken=()):
    rows = spark.createDataFrame(list(enumerate(bases)), "id int, base string")
    out = merge.numbered_slugs(rows, "base", "id", spark.createDataFrame([(t,) for t in taken], "slug string")).collect()
    return [r["slug"] for r in sorted(out, key=lambda r: r["id"])]


def test_slugs_of_bases_that_end_with_numbers(spark):
    assert slugs(spark, ["a", "a", "a-1"]) == ["a", "a-2", "a-1"]
    assert slugs(spark, ["ward-5"], ["ward-5"]) == ["ward-5-1"]
    assert slugs(spark, ["a", "a"], ["a-1", "a-7"]) == ["a", "a-8"]
    assert slugs(spark, ["a", None, "a"], ["a", "a-x", "b-9"]) == ["a-1", None, "a-2"]
    some = random.Random(3).choices(["a", "a-1", "a-1-1", "b", "b-2"], k=60)
    got = slugs(spark, some, ["a-1", "b", "b-3"])
    assert len(set(got)) == 60 and not set(got) & {"a-1", "b", "b-3"}


def test_persons_by_email_or_address(spark):
    rows = [(1, "p", "a@x", "1 Main"), (2, "p", None, "1 main "), (3, "p", "b@x", "2 Oak"), (4, "p", "B@x", None), (5, "p", "b@x", "1 Main"), (6, "q", "a@x", "1 Main"), (7, "p", "", ""), (8, "p", None, None)]
    got = {r["id"]: (r["slug"], r["first_id"]) for r in candidates.same_persons(spark.createDataFrame(rows, "id int, base string, email string, address string")).collect()}
    assert got == {1: ("p", 1), 2: ("p", 1), 3: ("p", 1), 4: ("p", 1), 5: ("p", 1), 6: ("q", 6), 7: ("p-1", 7), 8: ("p-2", 8)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    ids = list(range(200))
    rng.shuffle(ids)
    edges = list(zip(ids[:120], ids[1:120], strict=False)) + [(ids[150], x) for x in ids[151:180]] + [(x, x) for x in ids[180:]]
    parent = {x: x for x in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["component"] for r in storage.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for e in edges for x in e}


def test_ranks_within_one_large_group(spark):
    rows = spark.range(5000).select(F.lit(None).cast("string").alias("g"), (F.col("id") * 7919 % 5000).alias("x"))
    got = storage.ranked(rows, ["g"], [F.col("x")]).collect()
    assert len(got) == 5000 and all(r["rank"] == r["x"] + 1 for r in got)


def votes(spark, rows):
    return spark.createDataFrame([(u, s, p, i, i) for i, (u, s, p) in enumerate(rows)], "user_id int, statement int, position string, ts int, event_id int")


def test_nobody_agrees(spark):
    rows = [(u, s, "support" if u % 2 else "oppose") for u in range(6) for s in range(1, 6)]
    told = groups.characteristic_votes(votes(spark, rows), spark.createDataFrame([(u, 0) for u in range(6)], "user_id int, group int")).collect()
    assert [(r["rank"], r["statement"], r["consensus"]) for r in sorted(told, key=lambda r: r["rank"])] == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]


def test_groups_have_a_least_size(spark):
    """One participant stands far from all others, yet the second group is filled up to half the mean size by those nearest to it."""
    rows = [(u, s, "support") for u in range(20) for s in range(12)] + [(20, s, "oppose") for s in range(12)] + [(u, 20 + u, "oppose") for u in range(20)]
    got = groups.opinion_groups(votes(spark, rows), 2).collect()
    sizes = {g: sum(r["group"] == g for r in got) for g in (0, 1)}
    assert len(got) == 21 and min(sizes.values()) >= 21 // 4
    again = groups.opinion_groups(votes(spark, rows), 2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert groups.opinion_groups(votes(spark, rows).limit(0)).count() == 0
    one = groups.opinion_groups(votes(spark, [(1, 1, "neutral"), (2, 1, "neutral")]))
    assert sorted(tuple(r) for r in one.collect())[0][0] == 1


def test_ranks_of_texts(spark):
    rows = spark.createDataFrame([(1, "tax", "a bill on tax and school tax"), (2, None, "school. far from it: the word tax"), (3, "school", None), (4, None, None)], "id int, title string, text string")
    index = postings.index(rows, "id", {"title": "A", "text": "D"})
    assert {r["id"] for r in postings.matches(index, ["tax", "school"]).collect()} == {1, 2}
    ranks = {r["id"]: r["x"] for r in postings.matches(index, ["tax", "school"]).select("id", postings.rank_all(F.col("hits")).alias("x")).collect()}
    assert 0 < ranks[2] < ranks[1] < 1
    any_of = {r["id"]: r["x"] for r in postings.matches(index, ["tax", "school"], every=False).select("id", postings.rank_any(F.col("hits")).alias("x")).collect()}
    assert any_of[3] == pytest.approx(1.0 / postings.ALL / 2) and set(any_of) == {1, 2, 3}
    cover = {r["id"]: r["x"] for r in postings.matches(index, ["tax", "school"]).select("id", postings.cover_density(F.col("hits"), normal=False).alias("x")).collect()}
    # places of 2: school 1, tax 7: one stretch with five words between, mean weight 0.1
    assert cover[2] == pytest.approx(0.1 / (1 + 5))
    assert postings.query_terms("The School tax, the TAX") == ["school", "tax"]
