"""Projections against published examples, areas with holes and parts, places of layers, keys of odd places and offices."""

import random

import pytest
from pyspark.sql import functions as F

from agora.functions import projections
from agora.operators import districts, spatial

RINGS = "rings array<array<struct<x: double, y: double>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_projections_give_the_published_examples(spark):
    grid = projections.transverse_mercator(-2.0, 49.0, 0.9996012717, 400000.0, -100000.0, (6377563.396, 299.3249646))
    cone = projections.conformal_conic(-99.0, 27 + 50 / 60, 28 + 23 / 60, 30 + 17 / 60, 2000000.0, 0.0, (20925832.16, 294.97870))
    cases = [(grid, 0.5, 50.5, 577274.98, 69740.49), (cone, -96.0, 28.5, 2963503.91, 254759.80), (projections.UTM_15, -93.0, 45.0, 500000.0, 4982950.40), (projections.TEXAS_CONIC, -100.0, 31 + 10 / 60, 1000000.0, 1000000.0)]
    for plane, lon, lat, x, y in cases:
        got = spark.range(1).select(*plane(F.lit(lon), F.lit(lat))).first()
        assert got[0] == pytest.approx(x, abs=0.01) and got[1] == pytest.approx(y, abs=0.01)
    assert all(v is None for v in spark.range(1).select(*projections.UTM_15(F.lit(None).cast("double"), F.lit(1.0))).first())


def test_areas_of_any_size_with_holes_and_parts(spark):
    rng = random.Random(3)
    areas, shapes = [], []
    for i in range(30):
        size = 2.0 ** rng.randrange(-4, 9)
        x, y = rng.uniform(-100, 100), rng.uniform(-100, 100)
        rings = [box(x, y, x + size, y + size / 3), box(x + size / 4, y + size / 9, x + size / 2, y + size / 5), [(x - size, y), (x - size / 2, y), (x - size, y + size)]]
        shapes.append((x, y, size))
        areas.append((i, [r + r[:1] if i % 2 else r for r in rings]))
    areas += [(90, []), (91, None), (92, [[]])]
    points = [(i, rng.uniform(-120, 120), rng.uniform(-120, 120)) for i in range(500)] + [(900, None, 1.0)]
    points += [(500 + i, x + 0.1 * size, y + 0.1 * size) for i, (x, y, size) in enumerate(shapes)] + [(600, shapes[0][0], shapes[0][1]), (601, shapes[0][0], shapes[0][1] + shapes[0][2] / 6)]

    def holds(shape, px, py):
        x, y, s = shape
        outer = x < px < x + s and y < py < y + s / 3
        hole = x + s / 4 <= px <= x + s / 2 and y + s / 9 <= py <= y + s / 5
        corner = px > x - s and py > y and (px - (x - s)) * 2 + (py - y) < s
        return outer and not hole or corner

    want = {(p, i) for p, px, py in points if px is not None for i, s in enumerate(shapes) if holds(s, px, py)}
    frame = spark.createDataFrame(areas, f"area int, {RINGS}")
    for cells in (1, 4):
        got = spatial.join_areas(spark.createDataFrame(points, "p int, x double, y double"), frame, cells=cells).select("p", "area").collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == want
    assert spatial.join_areas(spark.createDataFrame(points, "p int, x double, y double"), frame.limit(0)).count() == 0
    one = spatial.one_area(spark.createDataFrame(points, "p int, x double, y double"), "p", frame, "area").collect()
    assert {tuple(r) for r in one} == {(p, min(i for q, i in want if q == p)) for p, _ in want}


def races(spark, place, *offices):
    lists = {c: "array<string>" for c in districts.LISTS}
    places = spark.createDataFrame([(1, *place.values())], "id int, " + ", ".join(f"{c} {lists.get(c, 'string')}" for c in place))
    cells = [(i, *(o.get(c) for c in districts.OFFICE)) for i, o in enumerate(offices)]
    said = spark.createDataFrame(cells, "race int, " + ", ".join(f"{c} string" for c in districts.OFFICE))
    return sorted(r["race"] for r in districts.races_of_places(places, "id", said, "race").collect())


def test_keys_of_odd_places_and_offices(spark):
    of = lambda kind, **more: {"state": "MN", "election_scope": "district", "district_type": kind, **more}
    soil = [of("soil_and_water", county="Polk", district=d) for d in ("2", "2 (East)", "East", "West")]
    assert races(spark, {"state": "MN", "county": "Polk County", "soil_and_water": "East"}, *soil) == [1, 2]
    hospital = [of("hospital", hospital_district=h, county=c) for h, c in (("Cook County", "Cook"), ("Cook County", "Polk"), ("Elm", "Polk"), ("Elm", None))]
    assert races(spark, {"state": "MN", "county": "Cook", "hospital": "Cook County"}, *hospital) == [0]
    assert races(spark, {"state": "MN", "county": "Cook", "hospital": "Elm"}, *hospital) == [2, 3]
    assert races(spark, {"state": "MN", "county": None, "hospital": "Elm"}, *hospital) == []
    town = [{"state": "MN", "election_scope": "city", "municipality": m} for m in ("ELM", "Unorganized North Unorg", "North Unorg")] + [of("city", municipality="elm", district=d) for d in ("Ward 3", "3", "Ward 3a")]
    assert races(spark, {"state": "MN", "city": "Elm", "ward": "3"}, *town) == [0, 3, 4]
    assert races(spark, {"state": "MN", "city": "North Unorg"}, *town) == [1, 2]
    school = [of("school", school_district=s) for s in ("ISD #5", "SSD #5", "5", None)]
    assert races(spark, {"state": "MN", "school_district": "5", "school_district_type": "03"}, *school) == [1, 2]
    assert races(spark, {"state": "MN", "school_district": "5", "school_district_type": "07"}, *school) == []
    courts = [{**of("judicial", district="1"), "state": "TX"}, {**of("constable", county="Bee", district="1, 2"), "state": "TX"}, of("judicial", district="1"), {"election_scope": "national"}, {"state": "TX", "election_scope": "state"}, {}]
    assert races(spark, {"state": "TX", "county": "Bee", "judicial": ["1", "1", "9"], "constable": "2"}, *courts) == [0, 1, 3, 4]
    assert races(spark, {"state": "CO", "county": "Bee"}, *courts) == [3]
    assert races(spark, {"state": None}, *courts) == [3]
    # parts that hold the sign between parts are no others
    assert races(spark, {"state": "MN", "county": "a|b", "county_commissioner": "c"}, of("county", county="a", district="b|c"), of("county", county="a|b", district="c")) == [1]


def test_layers_of_minnesota(spark):
    x, y = spark.range(1).select(*projections.UTM_15(F.lit(-93.0), F.lit(45.0))).first()
    square = lambda dx, half: [box(x + dx - half, y - half, x + dx + half, y + half)]
    voting = [
        (7, "01", "0010", "Elm Twp", "03", "07", "District 04", "Cook County", "W-02", square(0, 500.0)), (9, "01", "0099", "Far", "1", "1", None, None, None, square(0, 400.0)),
        (8, "02", "0020", None, "00", None, "West", None, "02", square(2000.0, 500.0)), (6, "03", "0030", "Oak", None, None, None, None, None, square(-2000.0, 500.0)),
    ]
    schools = [(1, "0535", "01", square(0, 600.0)), (2, "2180", "01", square(2000.0, 600.0))]
    crosswalk = [("01", "0010", "0111", "05"), ("02", "0020", "2180", "09"), ("03", "0030", "0700", "08")]
    subdistricts = [("2180", "02", None, None, square(2000.0, 100.0)), ("2180", "01", "99", None, square(2000.0, 100.0)), ("0700", "04", None, None, square(-2000.0, 100.0))]
    degree = 2000.0 / 78_815  # about so many metres of longitude at 45 degrees
    addresses = [(1, -93.0, 45.0, "MN", "A"), (2, -93.0 + degree, 45.0, "MN", "B"), (3, -93.0 - degree, 45.0, "MN", "C"), (4, -90.0, 45.0, "MN", "D"), (5, None, 45.0, "MN", "E")]
    got = districts.mn_places(
        spark.createDataFrame(addresses, "id int, lon double, lat double, state string, city string"), "id",
        spark.createDataFrame(voting, f"gid int, county_code string, precinct_code string, municipality string, county_commissioner string, judicial string, soil_and_water string, hospital string, ward string, {RINGS}"),
        spark.createDataFrame(schools, f"school_gid int, school_district string, school_district_type string, {RINGS}"),
        spark.createDataFrame(crosswalk, "county_code string, precinct_code string, school_district string, subdistrict string"),
        spark.createDataFrame(subdistricts, f"school_district string, subdistrict string, county_code string, precinct_code string, {RINGS}"),
    )
    names = ("id", "city", "county_commissioner", "judicial", "soil_and_water", "hospital", "ward", "school_district", "school_district_type", "school_subdistrict")
    assert sorted((tuple(r[c] for c in names) for r in got.collect())) == [
        (1, "Elm Township", "3", ["7"], "4", "Cook County", "2", "535", "01", "5"),
        (2, "B", "", [], "West", None, "2", "2180", "01", "2"),
        (3, "Oak", None, [], None, None, None, "700", None, "8"),
    ]
