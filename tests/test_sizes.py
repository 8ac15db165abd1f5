"""Steps that once grew faster than their input, and rows on edges and ties."""

from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (adds the queries)
from agora.functions.text import similarity
from agora.operators import candidates, districts, search, spatial, storage
from agora.plans import catalog


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_related_texts_take_their_trigrams_once(spark):
    rows = spark.createDataFrame([(1, "Cold widgets", 3), (2, None, 1), (3, "bolts and cold", None), (4, "???", 9), (5, "old wid", 2)], "id int, t string, n int")
    found = search.related(rows, "t", "cold widgets and bolts", F.col("n"))
    assert optimized(found).count("sequence(1, (length(") == 1
    assert [(r["id"], round(r["score"], 6)) for r in found.collect()][0][0] == 1
    assert search.related(rows, "t", "the ?", F.col("n")).count() == 0


def test_best_run_is_that_of_all_runs(spark):
    query = "ab cab abba"
    texts = ["cab", "ab abba", "", "xyz", "ba ab", "abba cab ab zzz", "cabab", None]

    def share(have: set, grams: list[str]) -> float:
        return max(len([g for g in grams[s:e] if g in have]) / (len(have) + e - s - len([g for g in grams[s:e] if g in have])) for s in range(len(grams)) for e in range(s + 1, len(grams) + 1))

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", search.word_similarity(F.col("t"), query)).collect()
    grams = search.query_grams(query)
    assert dict(map(tuple, rows)) == {i: share(set(search.query_grams(t or "")), grams) for i, t in enumerate(texts)}


def test_points_on_an_edge_of_a_ring_are_outside(spark):
    areas = spark.createDataFrame([("a", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "a string, ring array<struct<x: double, y: double>>")
    points = [(1, 0.0, 5.0), (2, 10.0, 5.0), (3, 5.0, 0.0), (4, 5.0, 10.0), (5, 0.0, 0.0), (6, 0.01, 0.01), (7, 9.99, 9.99), (8, None, 1.0)]
    got = spatial.join_points(spark.createDataFrame(points, "i int, x double, y double"), areas, 3.0).collect()
    assert sorted(r["i"] for r in got) == [6, 7]


def test_ballots_count_the_races_of_places(spark):
    towns = [("MN", "Oak County", t) for t in ("North Unorg", "elm", None)] + [("CO", None, None), (None, None, None)]
    places = spark.createDataFrame([(i, *towns[i % 5], ["3", "4"] if i % 2 else None) for i in range(40)], "id int, state string, county string, city string, judicial array<string>")
    kinds = [("national", None, None, None), ("city", None, None, "North Unorg"), ("city", None, None, "Elm"), ("county", None, None, None), ("district", "judicial", "3", None), ("district", "judicial", None, None), (None, None, None, None)]
    races = spark.createDataFrame([(90 - i, "MN", *kinds[i % 7][:3], "Oak", kinds[i % 7][3]) for i in range(70)], "race int, state string, election_scope string, district_type string, district string, county string, municipality string")
    pairs = districts.races_of_places(places, "id", races, "race").groupBy("id").agg(F.count("*"), F.min("race"))
    got = districts.ballots(places, "id", races, "race")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and got.count() > 30
    assert got.columns == ["id", "n_races", "first_race"]


def square(x, y, side):
    return [[(x, y), (x + side, y), (x + side, y + side), (x, y + side)]]


def test_one_area_holds_places_and_shapes_once(spark):
    points = spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(120)] + [(500, None, 1.0)], "p int, x double, y double")
    areas = spark.createDataFrame([(99 - i, f"n{i}", square(i % 3 - 0.5, -0.5, 1.0 + i % 2)) for i in range(60)], "gid int, name string, rings array<array<struct<x: double, y: double>>>")
    got = spatial.one_area(points, "p", areas, "gid")
    pairs = spatial.join_areas(points, areas).collect()
    least = {r["p"]: min((s["gid"], s["name"]) for s in pairs if s["p"] == r["p"]) for r in pairs}
    assert {r["p"]: (r["gid"], r["name"]) for r in got.collect()} == least and got.count() == len(least)
    assert optimized(got).count("Aggregate") >= 4  # places and shapes stand once before they meet


def test_areas_by_place_hold_every_pair(spark):
    points = spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(60)] + [(500, None, 1.0)], "p int, x double, y double")
    areas = spark.createDataFrame([(i, square(i % 3 - 0.5, -0.5, 1.0 + i % 2)) for i in range(30)] + [(70, [])], "s int, rings array<array<struct<x: double, y: double>>>")
    told = spatial.areas_by_place(points, "p", areas, "s").collect()
    of = {kind: [(r["a"], r["b"]) for r in told if r["relation"] == kind] for kind in ("point", "area", "inside")}
    pairs = {(p, s) for p, q in of["point"] for s, t in of["area"] if (q, t) in set(of["inside"])}
    assert pairs == {(r["p"], r["s"]) for r in spatial.join_areas(points, areas).collect()} and pairs
    assert len(of["point"]) == 60 and len(of["area"]) == 31 and len(of["inside"]) == len(set(of["inside"])) < 50


def test_ties_of_telling_units_do_not_hang_on_rounding(spark):
    sf = "/root/testdata/sf0.1"
    compare(catalog.QUERIES["camps_agree"](spark, sf), catalog.SQL["camps_agree"], sf)


def test_races_of_one_key_meet_places_once(spark):
    found = catalog.QUERIES["races_for_address"](spark, "/root/testdata/sf0.001")
    assert "count(1)" in optimized(found).split("Join", 1)[1]


def filed(spark, rows):
    return spark.createDataFrame(rows, "id int, slug string, email string, phone string, address string")


def test_resolution_makes_no_pairs(spark):
    pick = lambda i, *v: v[i % len(v)]
    staged = [(i, pick(i, "a-1", "b", None), pick(i, "x", "y", "", None), pick(i, "1", "2", "", "3", None), pick(i, "p", None, "q", "", "r", "p", "s")) for i in range(90)] + [(95, "a", "none", None, "")]
    known = [(i, pick(i, "a", "a-7", "b-2", "c"), pick(i, "y", "x", None, "z", ""), pick(i, "2", "1", None, ""), pick(i, "q", "p", "")) for i in range(80)]
    stem = lambda slug: slug and slug.split("-")[0]
    pairs = {}
    for s in staged:
        for k in known:
            by = [j for j in (2, 3, 4) if s[1] and stem(s[1]) == stem(k[1]) and s[j] and s[j] == k[j]]
            if by:
                pairs[s[0], k[0]] = ("email", "phone", "address")[by[0] - 2]
    got = candidates.resolve(filed(spark, staged), filed(spark, known))
    rows = {side: [r for r in got.collect() if r["side"] == side] for side in ("staged", "known")}
    found = {}
    for s in rows["staged"]:
        for k in rows["known"]:
            by = [c for c in ("email", "phone", "address") if s[f"{c}_class"] is not None and s[f"{c}_class"] == k[f"{c}_class"]]
            if by:
                found[s["id"], k["id"]] = by[0]
    assert found == pairs and len(rows["staged"]) == 91 and len(rows["known"]) == 80
    for side, at in (("staged", 0), ("known", 1)):
        for r in rows[side]:
            assert [r["n_email"], r["n_phone"], r["n_address"]] == [sum(p[at] == r["id"] and by == c for p, by in pairs.items()) for c in ("email", "phone", "address")]
    assert {r["id"] for r in rows["staged"] if r["action"] == "insert"} == {s[0] for s in staged} - {p[0] for p in pairs}
    told = candidates.resolution(filed(spark, staged), filed(spark, known))
    dupes = {k: sorted(s for s, q in pairs if q == k) for k in {p[1] for p in pairs}}
    assert {tuple(r) for r in told["dupes"].collect()} == {(k, s[0], len(s) - 1) for k, s in dupes.items() if len(s) > 1}


def test_match_classes_hold_every_pair(spark):
    pick = lambda i, *v: v[i % len(v)]

    def people(n, k):
        return [(i, pick(i * k, "Catherine", "Katherine", "Bob", None), pick(i, None, "Q"), pick(i * k, "Miller", "Millar", "Zyx", "Miller", None), pick(i, "s1", "s2", "", None, "s3"), pick(i * k, "x", "", None, "y", "z", "v"), pick(i, None, "1", "2", "", "3", None, "4"), pick(i * k, " A st", "a ST", "", None, None, "b")) for i in range(n)]

    staged, known = people(50, 1), people(60, 7)
    low = lambda v: (v or "").strip().lower()
    whole = lambda p: p[3] and f"{p[1] or ''} {p[2] or ''} {p[3]}".lower()
    names = sorted({whole(p) for p in staged + known} - {None})
    grid = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s"))
    alike = {(r["a"], r["b"]): r["s"] for r in grid.collect()}
    exact = [lambda p: p[5] or None, lambda p: p[6] or None, lambda p: low(p[7]) or None, lambda p: p[1] and p[3] and (low(p[1]), low(p[2]), low(p[3])), lambda p: p[4] or None]
    want = {}
    for s in staged:
        for k in known:
            by = [candidates.MATCHES[i] for i, f in enumerate(exact) if f(s) and f(s) == f(k)]
            near = alike.get((whole(s), whole(k)), 0.0)
            by += ["high_similarity" if near > 0.8 else "medium_similarity"] if near > 0.6 else []
            if by:
                want[s[0], k[0]] = by[0]
    schema = "id int, first_name string, middle_name string, last_name string, slug string, email string, phone string, address string"
    rows = candidates.classified(spark.createDataFrame(staged, schema), spark.createDataFrame(known, schema)).collect()
    near = {(r["id"], r["other"]): r["match_type"] for r in rows if r["relation"] == "alike"}
    got = {}
    for s in (r for r in rows if r["relation"] == "staged"):
        for k in (r for r in rows if r["relation"] == "known"):
            by = [m for m, c in zip(candidates.MATCHES, ("email", "phone", "address", "name", "slug")) if s[f"{c}_class"] is not None and s[f"{c}_class"] == k[f"{c}_class"]]
            by += [near[s["alike_class"], k["alike_class"]]] if (s["alike_class"], k["alike_class"]) in near else []
            if by:
                got[s["id"], k["id"]] = by[0]
    assert got == want and set(want.values()) == set(candidates.MATCHES)
    assert sum(r["relation"] != "alike" for r in rows) == 110


def test_partitions_grow_with_the_table(spark):
    assert storage.dealt(spark.range(10), ["id"], 50_000_001).rdd.getNumPartitions() == 51
    assert storage.dealt(spark.range(10), ["id"], 0).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    found = catalog.QUERIES["runoff_having"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in optimized(found)


def test_points_in_areas_are_all_pairs(spark):
    points = spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(60)] + [(500, None, 1.0)], "p int, x double, y double")
    areas = spark.createDataFrame([(i, square(i % 3 - 0.5, -0.5, 1.0 + i % 2)) for i in range(30)] + [(70, [])], "s int, rings array<array<struct<x: double, y: double>>>")
    told = sorted(map(tuple, spatial.points_in_areas(points, "p", areas, "s").collect()))
    assert told == sorted((r["p"], r["s"]) for r in spatial.join_areas(points, areas).collect()) and told
    assert catalog.QUERIES["points_in_layers"](spark, "/root/testdata/sf0.001").columns == ["c_custkey", "s_suppkey"]


def test_matched_are_all_pairs_with_their_similarity(spark):
    pick = lambda i, *v: v[i % len(v)]

    def people(n, k):
        return [(i, pick(i * k, "Catherine", "Katherine", "Bob", None), pick(i, None, "Q"), pick(i * k, "Miller", "Millar", "Zyx", "Miller", None), pick(i, "s1", "s2", "", None, "s3"), pick(i * k, "x", "", None, "y", "z", "v"), pick(i, None, "1", "2", "", "3", None, "4"), pick(i * k, " A st", "a ST", "", None, None, "b")) for i in range(n)]

    staged, known = people(50, 1), people(60, 7)
    low = lambda v: (v or "").strip().lower()
    whole = lambda p: p[3] and f"{p[1] or ''} {p[2] or ''} {p[3]}".lower()
    names = sorted({whole(p) for p in staged + known} - {None})
    grid = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s"))
    alike = {(r["a"], r["b"]): r["s"] for r in grid.collect()}
    exact = [lambda p: p[5] or None, lambda p: p[6] or None, lambda p: low(p[7]) or None, lambda p: p[1] and p[3] and (low(p[1]), low(p[2]), low(p[3])), lambda p: p[4] or None]
    want = []
    for s in staged:
        for k in known:
            near = alike.get((whole(s), whole(k)))
            by = [candidates.MATCHES[i] for i, f in enumerate(exact) if f(s) and f(s) == f(k)]
            by += ["high_similarity" if near > 0.8 else "medium_similarity"] if (near or 0) > 0.6 else []
            if by:
                want.append((s[0], k[0], by[0], near if near is None else round(near, 6)))
    schema = "id int, first_name string, middle_name string, last_name string, slug string, email string, phone string, address string"
    got = candidates.matched(spark.createDataFrame(staged, schema), spark.createDataFrame(known, schema)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and {w[2] for w in want} == set(candidates.MATCHES)
    assert any(w[3] is not None and w[3] <= 0.6 for w in want)
    assert catalog.QUERIES["match_classes"](spark, "/root/testdata/sf0.001").columns == ["staged_id", "known_id", "match_type", "name_similarity"]


def test_resolved_are_all_updates_and_inserts(spark):
    pick = lambda i, *v: v[i % len(v)]
    staged = [(i, pick(i, "a-1", "b", None), pick(i, "x", "y", "", None), pick(i, "1", "2", "", "3", None), pick(i, "p", None, "q", "", "r", "p", "s")) for i in range(90)] + [(95, "a", "none", None, "")]
    known = [(i, pick(i, "a", "a-7", "b-2", "c"), pick(i, "y", "x", None, "z", ""), pick(i, "2", "1", None, ""), pick(i, "q", "p", "")) for i in range(80)]
    stem = lambda slug: slug and slug.split("-")[0]
    want = []
    for s in staged:
        for k in known:
            by = [c for j, c in ((2, "email"), (3, "phone"), (4, "address")) if s[1] and stem(s[1]) == stem(k[1]) and s[j] and s[j] == k[j]]
            want += [(s[0], "update", k[0], by[0], k[1])] if by else []
    got = candidates.resolved(filed(spark, staged), filed(spark, known)).collect()
    assert sorted(tuple(r) for r in got if r["action"] == "update") == sorted(want) and {w[3] for w in want} == {"email", "phone", "address"}
    inserted = [r for r in got if r["action"] == "insert"]
    assert sorted(r["id"] for r in inserted) == sorted({s[0] for s in staged} - {w[0] for w in want}) and all(r["known_id"] is None for r in inserted)
    said = [r["slug"] for r in inserted if r["slug"] is not None]
    assert len(set(said)) == len(said) and not set(said) & {k[1] for k in known}
    assert catalog.QUERIES["resolved_filings"](spark, "/root/testdata/sf0.001").columns == ["id", "action", "known_id", "matched_by", "slug"]
