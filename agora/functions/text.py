"""Text functions as column expressions: slugs, natural order, trigrams, titles, links, names, office rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(value: Column) -> Column:
    """Small letters, digits and single hyphens; letters outside a-z go."""
    kept = F.regexp_replace(F.lower(value), "[^a-z0-9 -]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(kept, "\\s+", "-"), "-+", "-"), F.lit("-"))


def leading_int(value: Column) -> Column:
    """The number that a text begins with, null if none: for natural order."""
    return F.expr("int(null)") if value is None else F.nullif(F.regexp_extract(value, "^([0-9]+)", 1), F.lit("")).try_cast("int")


def trailing_int(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, "([0-9]+)$", 1), F.lit("")).try_cast("int")


def trigrams(value: Column) -> Column:
    """The distinct trigrams of a text's words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(value), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(grams))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` uses it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def overlap(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets of trigrams; 0 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    return once(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), lambda t: overlap(t["a"], t["b"]))


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def html_title(html: Column) -> Column:
    """A page's title: <title> in its head, else a meta tag named title, else any meta tag with title in its name."""
    head = F.regexp_extract(html, "(?is)<head[^>]*>(.*?)</head>", 1)
    name, content = "(?:name|property)=[\"'][^\"']*title[^\"']*[\"']", "content=[\"']([^\"']*)[\"']"
    exact = "name=[\"']title[\"']"
    tags = [f"(?i)<meta[^>]*{a}[^>]*{b}[^>]*>" for n in (exact, name) for a, b in ((n, content), (content, n))]
    return F.coalesce(_found(head, "(?i)<title[^>]*>(.*?)</title>", 1), *(_found(head, t, 1) for t in tags))


def clean_url(url: Column) -> Column:
    """A link without its fragment and parameters, but for ``token``."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    token = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), "[?&]token=([^&]*)", 1)
    return F.when(token != "", F.concat(bare, F.lit("?token="), token)).otherwise(bare)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Half-up percentage, null for a whole of null or 0."""
    return F.round((part.cast("double") * 100 / F.nullif(whole, F.lit(0))).cast("decimal(24,8)"), digits).cast("double")


def full_name(first: Column, middle: Column, last: Column, suffix: Column, preferred: Column) -> Column:
    """Preferred or first name, middle, last, suffix; parts that are null or blank are left out."""
    parts = [F.nullif(F.trim(x), F.lit("")) for x in (F.coalesce(preferred, first), middle, last, suffix)]
    return F.concat_ws(" ", *parts)


#: Abbreviations of parties and their codes.
PARTY_CODES = {"R": "REP", "REPUBLICAN": "REP", "DFL": "DFL", "DEM": "DEM", "DEMOCRATIC": "DEM", "LIB": "LIB", "GRE": "GRE", "IND": "IND", "NP": "N"}
#: Names of parties, as they are looked for, in order.
PARTY_NAMES = ("Democratic Party", "Republican Party", "Libertarian Party", "American Constitution Party", "Center Party", "Unity Party", "Forward Party", "Approval Voting Party")


def party_code(text: Column) -> Column:
    key = F.upper(F.trim(text))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in PARTY_CODES.items() for x in kv)), key)


def party_name(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(low.contains("unaffiliated") | low.contains("no party affiliation"), "Unaffiliated")
    for name in PARTY_NAMES:
        out = out.when(low.contains(name.lower()), name)
    return out


def is_special_election(title: Column) -> Column:
    return F.lower(title).contains("special election")


def is_ranked_choice(title: Column) -> Column:
    return F.lower(title).contains("first choice")


def seats_to_fill(title: Column) -> Column:
    """n of "(Elect n)", in any case."""
    return F.nullif(F.regexp_extract(title, "(?i)\\(Elect\\s+([0-9]+)\\)", 1), F.lit("")).try_cast("int")


#: Canonical county office, texts of which one is held, texts that rule it out. First match wins.
COUNTY_OFFICES = (
    ("Judge - County Criminal Court of Appeals", ("Judge, County Criminal Court of Appeals",), ()),
    ("Judge - County Criminal Court at Law", ("Judge, County Criminal Court",), ()),
    ("Judge - County Court at Law", ("Judge, County Court at Law", "County Court-at-Law"), ()),
    ("Judge - Probate Court", ("Probate Court",), ()),
    ("Criminal District Judge", ("Criminal District Judge",), ("Judicial District",)),
    ("Criminal District Attorney", ("Criminal District Attorney",), ()),
    ("County Judge", ("County Judge",), ()),
    ("Judge - County Civil Court at Law", ("Judge, County Civil Court at Law",), ()),
    ("County Attorney", ("County Attorney",), ()),
    ("County & District Clerk", ("County and District Clerk", "District and County Clerk", "County Clerk/District Clerk", "District Clerk/County Clerk"), ()),
    ("District Clerk", ("District Clerk",), ()),
    ("County Clerk", ("County Clerk",), ()),
    ("Sheriff & County Tax Assessor-Collector", ("Sheriff and Tax Assessor-Collector",), ()),
    ("Sheriff", ("Sheriff",), ()),
    ("County Tax Assessor-Collector", ("Tax Assessor-Collector",), ()),
    ("County Treasurer", ("County Treasurer",), ()),
    ("County Surveyor", ("County Surveyor",), ()),
    ("County School Trustee", ("County School Trustee",), ()),
    ("County Commissioner", ("County Commissioner", "Commissioner"), ("Railroad", "Agriculture", "General Land Office")),
    ("Justice of the Peace", ("Justice of the Peace", "JOP"), ()),
    ("County Constable", ("Constable",), ()),
    ("Precinct Chair", ("Precinct Chair",), ()),
    ("County Chair", ("County Chair", "Party Chairman", "Party Chair"), ()),
)
PRECINCT_CHAIR = "(?i)precinct\\s+[0-9]+\\s+chair"


def county_office(title: Column, rules=COUNTY_OFFICES) -> Column:
    """The canonical office of a contest title, by an ordered rule table as one conditional expression; null if no rule takes it."""
    out = None
    for office, held, barred in rules:
        test = F.lit(False)
        for x in held:
            test = test | title.contains(x)
        if office == "Precinct Chair":
            test = test | title.rlike(PRECINCT_CHAIR)
        for x in barred:
            test = test & ~title.contains(x)
        out = F.when(test, office) if out is None else out.when(test, office)
    return out


def office_subtitle(o: dict[str, Column], short: bool = False) -> Column:
    """What stands under an office's title. Keys: election_scope, political_scope, district_type, state, state_name, county, municipality, school_district, district.

    Any missing part makes it null.
    """
    scope, politics, kind = o["election_scope"], o["political_scope"], o["district_type"]
    local, of_state = politics == "local", politics == "state"
    place = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    district = (
        F.when((politics == "federal") & (kind == "us_congressional"), place(o["state"], " - District ", o["district"]))
        .when(of_state & (kind == "state_house"), place(o["state"], " - HD " if short else " - House District ", o["district"]))
        .when(of_state & (kind == "state_senate"), place(o["state"], " - SD " if short else " - Senate District ", o["district"]))
        .when(local & (kind == "county"), place(o["county"], " County, ", o["state"], " - District ", o["district"]))
        .when(local & (kind == "city"), place(o["municipality"], ", ", o["state"], " - ", o["district"]))
        .when(local & (kind == "school"), F.coalesce(place(o["state"], " - ", o["school_district"], " - District ", o["district"]), place(o["state"], " - ", o["school_district"])))
    )
    return (
        F.when(scope == "state", o["state_name"])
        .when(scope == "district", district)
        .when(scope == "county", place(o["county"], " County"))
        .when((scope == "city") & local, place(o["municipality"], ", ", o["state"]))
    )


def general_election_date(year: Column) -> Column:
    """The Tuesday after the first Monday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "MON"), 1)


def age(born: Column, as_of: Column) -> Column:
    return F.expr("int(null)") if born is None else F.floor(F.datediff(as_of, born) / 365).cast("int")
