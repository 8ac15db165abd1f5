import datetime

import pytest
from pyspark.sql import functions as F

from agora.functions import text as tx
from agora.operators import search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, code", [("R", "REP"), ("r", "REP"), (" R ", "REP"), ("DFL", "DFL"), ("DEM", "DEM"), ("NP", "N"), ("", None), ("XYZ", None), (None, None)])
def test_party_code(spark, text, code):
    assert one(spark, tx.party_code(F.lit(text).cast("string"))) == code


@pytest.mark.parametrize("text, name", [("democratic party", "Democratic Party"), ("Democrat", None), ("No Party Affiliation", "Unaffiliated"), ("the UNITY PARTY of X", "Unity Party")])
def test_party_name(spark, text, name):
    assert one(spark, tx.party_name(F.lit(text))) == name


@pytest.mark.parametrize("text, n", [("City Council Member (Elect 3)", 3), ("x (elect 2)", 2), ("(Elect)", None), ("Elect 3", None)])
def test_seats_to_fill(spark, text, n):
    assert one(spark, tx.seats_to_fill(F.lit(text))) == n


@pytest.mark.parametrize("text, slug", [("John Smith", "john-smith"), ("  A & B -- C ", "a-b-c"), ("É1", "1"), ("", "")])
def test_slugify(spark, text, slug):
    assert one(spark, tx.slugify(F.lit(text))) == slug


@pytest.mark.parametrize("year, day", [(2023, 7), (2024, 5), (2025, 4), (2026, 3), (2027, 2), (2028, 7)])
def test_general_election(spark, year, day):
    assert one(spark, tx.general_election_date(F.lit(year))) == datetime.date(year, 11, day)


@pytest.mark.parametrize(
    "title, office",
    [
        ("Judge, County Criminal Court of Appeals 2", "Judge - County Criminal Court of Appeals"),
        ("County Commissioner, Precinct 2", "County Commissioner"),
        ("Railroad Commissioner", None),
        ("Criminal District Judge, Judicial District 4", None),
        ("precinct 12 chair", "Precinct Chair"),
        ("District Clerk/County Clerk", "County & District Clerk"),
    ],
)
def test_county_office(spark, title, office):
    assert one(spark, tx.county_office(F.lit(title))) == office


def test_office_subtitle(spark):
    def of(short=False, **parts):
        keys = ("election_scope", "political_scope", "district_type", "state", "state_name", "county", "municipality", "school_district", "district")
        return one(spark, tx.office_subtitle({k: F.lit(parts.get(k)).cast("string") for k in keys}, short))

    senate = dict(election_scope="district", political_scope="state", district_type="state_senate", state="AL", district="1")
    assert of(**senate) == "AL - Senate District 1"
    assert of(short=True, **senate) == "AL - SD 1"
    assert of(election_scope="district", political_scope="local", district_type="city", municipality="Buckwild City", state="AL", district="Ward 3") == "Buckwild City, AL - Ward 3"
    assert of(election_scope="national") is None
    assert of(election_scope="district", political_scope="local", district_type="school", state="MN", school_district="ISD 1") == "MN - ISD 1"


def test_titles_and_links(spark):
    assert one(spark, tx.html_title(F.lit('<head><title> </title><meta property="og:title" content="A"></head>'))) == "A"
    assert one(spark, tx.html_title(F.lit("<title>no head</title>"))) is None
    assert one(spark, tx.clean_url(F.lit("https://a.b/c?x=1&token=t&y=2#z"))) == "https://a.b/c?token=t"
    assert one(spark, tx.clean_url(F.lit("https://a.b/c?xtoken=1"))) == "https://a.b/c"


def test_similarity(spark):
    assert one(spark, tx.similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, tx.similarity(F.lit(""), F.lit(""))) == 0.0


@pytest.mark.parametrize("query, found", [("", True), (None, True), ("green cats", True), ('"green cats"', False), ('"cats are"', True), ("dogs or cats", True), ("cats -green", False), ("dogs", False)])
def test_websearch(spark, query, found):
    assert one(spark, search.websearch(F.lit("Cats are green."), query)) is found
