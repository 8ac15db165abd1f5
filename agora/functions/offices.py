"""Titles of offices taken apart, by two states' rule tables, and what is made of the parts: slugs, lines under titles, races' titles, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import slug_of_words, title_case
from .rules import Rule, captured, first_match, holds

PARTS = ("name", "title", "chamber", "political_scope", "election_scope", "district_type", "district", "seat", "county", "municipality", "school_district", "hospital_district")

# Fixed values of Minnesota: phrases, office name, title. The first match wins.
MN_NAMES = (
    (("u.s. senator", "united states senator"), "U.S. Senate", "U.S. Senator"),
    (("u.s. representative", "u.s. house", "united states representative"), "U.S. House", "U.S. Representative"),
    (("state senator", "state senate"), "State Senate", "State Senator"),
    (("state representative", "state house"), "State House", "State Representative"),
    (("soil and water supervisor",), "Soil and Water Supervisor", "Soil and Water Supervisor"),
    (("county park commissioner",), "County Park Commissioner", "County Park Commissioner"),
    (("county commissioner",), "County Commissioner", "County Commissioner"),
    (("chief justice - supreme court",), "Chief Justice - Supreme Court", "Chief Justice - Supreme Court"),
    (("associate justice - supreme court",), "Associate Justice - Supreme Court", "Associate Justice - Supreme Court"),
    (("judge - court of appeals",), "Judge - Court of Appeals", "Judge - Court of Appeals"),
    ((), "(Judge - [0-9]{1,3}(?:st|nd|rd|th)? District)", None),
    (("sanitary district board member",), "Sanitary District Board", "Sanitary District Board Member"),
    (("council member",), "City Council", "City Council Member"),
    (("city clerk - treasurer",), "City Clerk & Treasurer", "City Clerk & Treasurer"),
    (("city clerk",), "City Clerk", "City Clerk"),
    (("city treasurer",), "City Treasurer", "City Treasurer"),
    (("mayor",), "Mayor", "Mayor"),
    (("town clerk - treasurer",), "Town Clerk & Treasurer", "Town Clerk & Treasurer"),
    (("town clerk",), "Town Clerk", "Town Clerk"),
    (("town treasurer",), "Town Treasurer", "Town Treasurer"),
    (("town supervisor",), "Town Supervisor", "Town Supervisor"),
    (("school board member",), "School Board", "School Board Member"),
    (("hospital district board member",), "Hospital District Board", "Hospital District Board Member"),
    (("utility board commissioner",), "Utility Board Commissioner", "Utility Board Commissioner"),
    (("board of public works",), "Board of Public Works", "Board of Public Works Member"),
    (("board of estimate and taxation",), "Board of Estimate and Taxation", "Board of Estimate and Taxation Member"),
    (("park and recreation commissioner",), "Park and Recreation Commissioner", "Park and Recreation Commissioner"),
)
# Chambers by pattern.
CHAMBERS = (
    ("(?i)U(?:nited |.)S(?:tates|.) Senat(?:e|or)", "senate"),
    ("(?i)U(?:nited |.)S(?:tates|.) (?:House|Representative)", "house"),
    ("(?i)State Senat(?:e|or)", "senate"),
    ("(?i)State (?:House|Representative)", "house"),
)
# Fixed values of Minnesota: numbers of the counties whose soil and water supervisors stand for districts.
MN_SOIL_COUNTIES = (2, 10, 19, 56, 60, 62, 65, 69, 70, 82)
# Fixed values of Minnesota: phrases and kind of district, after those of soil and water.
MN_DISTRICT_TYPES = (
    (("u.s. representative",), "us_congressional"),
    (("state senator",), "state_senate"),
    (("state representative",), "state_house"),
    (("soil and water supervisor",), "soil_and_water"),
    (("county commissioner", "county park commissioner"), "county"),
    (("council member ward", "council member district", "council member precinct", "council member section"), "city"),
    (("school board",), "school"),
    (("district court",), "judicial"),
    (("hospital district board",), "hospital"),
    (("park and recreation",), "park"),
)
# Fixed values of Minnesota: who elects an office.
_COUNTY_WIDE = ("county attorney", "county sheriff", "county recorder", "county surveyor", "county coroner", "county auditor", "county treasurer")
_WARDS = ("ward", "district", "precinct", "section")
_CITY_WIDE = ("city clerk", "city treasurer", "mayor", "town clerk", "town treasurer", "town supervisor", "sanitary district board", "board of public works", "utility board commissioner", "board of estimate and taxation", "police chief")
MN_SCOPES = (
    Rule("county", (_COUNTY_WIDE,)),
    Rule("district", (("u.s. representative", "state representative", "state senator", "county commissioner", "county park commissioner", "school board member"),)),
    Rule("district", ("park and recreation commissioner", "district")),
    Rule("district", ("judge", "district court")),
    Rule("district", ("council member", _WARDS)),
    Rule("city", (("council member", *_CITY_WIDE),)),
    Rule("city", ("park and recreation commissioner", "at large")),
    Rule("district", ("hospital district board", ("at large", "(cook county)"))),
    Rule("city", ("hospital district board",)),
)
# Fixed values of Minnesota: a title's district.
_NUMBER, _NTH = "District ([0-9]{1,3}[A-Z]?)", "([0-9]{1,3})(?:st|nd|rd|th) District"
MN_DISTRICTS = (
    *(Rule(f"{{}} ({d.capitalize()})", ("soil and water supervisor", f"({d})"), tuple(f"({x})" for x in before), _NUMBER) for d, before in (("north", ()), ("south", ("north",)), ("east", ("north", "south")), ("west", ("north", "south", "east")))),
    Rule("Wards {}", ("council member wards", "red wing"), (), "Wards ([0-9]{1,3} & [0-9]{1,3})"),
    Rule("Ward {}", ("council member ward",), (), "Ward ([0-9A-Z]+)"),
    Rule("Precinct {}", ("council member precinct", "glencoe"), (), "Precinct ([0-9]{1,3})"),
    Rule("Section {}", ("council member section", "crystal"), (), "Section ([I|]+)"),
    *(Rule(f"{town} District", (f"school board member {town.lower()} district",)) for town in ("Fairfax", "Gibbon", "Winthrop", "Russell", "Tyler", "Ruthton")),
    Rule("{}", ("school board member position", ("isd #861", "isd #390")), (), "Position ([0-9]{1,3})"),
    Rule("{}", ("hospital district board", "(cook county)"), (), "Board Member ([0-9]{1,3})"),
    Rule("{}", (), (), _NTH),
    Rule("{}", (), (), _NUMBER),
)
# Fixed values of Minnesota: a title's seat.
MN_SEATS = (
    Rule("At Large", ("at large",)),
    Rule("At Large - {}", ("council member", "seat"), (), "Seat ([A-Za-z0-9]+)"),
    Rule("{}", ("seat",), (), "Seat ([A-Za-z0-9]+)"),
    Rule("{}", (("district court", "supreme court"),), (), "Court ([0-9]{1,3})"),
    Rule("{}", ("court of appeals",), (), "Appeals ([0-9]{1,3})"),
    Rule("{}", ("school board member position", ("isd #535", "isd #206")), (), "Position ([0-9]{1,3})"),
)
# Fixed values of Minnesota: a title's hospital district, and the offices whose titles name a place in parentheses.
_INSIDE = "\\(([^)]+)\\)"
MN_HOSPITALS = (
    Rule("{}", (), (), "(?s)^(?=.*Hospital District Board Member [0-9]{1,2}).*?" + _INSIDE),
    Rule("Northern Itasca - Koochiching", (), (), "Hospital District Board Member at Large Koochiching"),
    Rule("Northern Itasca - Itasca", (), (), "Hospital District Board Member at Large Itasca"),
    Rule("{}", (), (), "(?s)^(?=.*Hospital District Board Member at Large).*?" + _INSIDE),
)
MN_PLACES = (
    Rule("{}", (("council member", *_CITY_WIDE, "park and recreation commissioner"),), (), _INSIDE),
    Rule("{}", ("hospital district board",), ("at large", "(cook county)"), _INSIDE),
)
# Fixed values of Minnesota: towns whose names two counties have.
MN_SAME_NAMES = ("Beaver Township", "Becker Township", "Clover Township", "Cornish Township", "Fairview Township", "Hillman Township", "Lawrence Township", "Long Lake Township", "Louisville Township", "Moose Lake Township", "Stokes Township", "Twin Lakes Township")

# Fixed values of Texas: office name, phrases of which all are held (within parentheses: one of them), phrases that rule it out. The first match wins.
TX_NAMES = (
    Rule("U.S. House", (("u.s. representative", "u. s. representative"),)),
    Rule("U.S. Senate", (("u.s. senator", "u. s. senator"),)),
    Rule("Lieutenant Governor", ("lieutenant governor",)),
    Rule("Governor", ("governor",)),
    Rule("Attorney General", ("attorney general",)),
    Rule("State Board of Education", ("state board of education",)),
    Rule("Railroad Commissioner", ("railroad commissioner",)),
    Rule("Commissioner of Agriculture", ("commissioner of agriculture",)),
    Rule("Commissioner of the General Land Office", ("commissioner of the general land office",)),
    Rule("Comptroller of Public Accounts", ("comptroller of public accounts",)),
    Rule("State House", ("state representative",)),
    Rule("State Senate", ("state senator",)),
    Rule("Chief Justice - Supreme Court", ("chief justice", "supreme court")),
    Rule("Justice - Supreme Court", ("justice", "supreme court"), ("chief",)),
    Rule("Chief Justice - Court of Appeals", ("chief justice", "court of appeals")),
    Rule("Justice - Court of Appeals", ("justice", "court of appeals"), ("chief",)),
    Rule("Judge - Court of Criminal Appeals", ("court of criminal appeals",)),
    Rule("District Judge", ("district judge", "judicial district")),
    Rule("Criminal District Attorney", ("criminal district attorney",)),
    Rule("District Attorney", ("district attorney",)),
    Rule("County Commissioner", ("county commissioner",)),
    Rule("County Judge", ("county judge",)),
    Rule("County & District Clerk", ("county and district clerk",)),
    Rule("County & District Clerk", ("county clerk", "district clerk")),
    Rule("County Clerk", ("county clerk",)),
    Rule("District Clerk", ("district clerk",)),
    Rule("County Attorney", ("county attorney",)),
    Rule("County Treasurer", ("county treasurer",)),
    Rule("County Surveyor", ("county surveyor",)),
    Rule("Sheriff & County Tax Assessor-Collector", ("sheriff", "county tax assessor-collector")),
    Rule("County Tax Assessor-Collector", ("county tax assessor-collector",)),
    Rule("County Chair", ("county chair",)),
    Rule("Justice of the Peace", ("justice of the peace",)),
    Rule("County Constable", ("county constable",)),
    Rule("Sheriff", ("sheriff",)),
    Rule("County School Trustee", ("department of education",)),
    Rule("Judge - 1st Multicounty Court at Law", ("1st multicounty court at law",)),
    Rule("Judge - County Civil Court at Law", ("county civil court at law",)),
    Rule("Judge - County Criminal Court of Appeals", ("county criminal court of appeals",)),
    Rule("Judge - County Criminal Court at Law", ("county criminal court",)),
    Rule("Judge - Probate Court", ("probate court",)),
    Rule("Judge - County Court at Law", ("county court at law",)),
    Rule("Criminal District Judge", ("criminal district judge",)),
    Rule("Precinct Chair", ("precinct chair",)),
)
# Fixed values of Texas: names whose title is another; chairs carry their party's letter; offices that name their county after themselves.
TX_TITLES = {"U.S. House": "U.S. Representative", "U.S. Senate": "U.S. Senator", "State House": "State Representative", "State Senate": "State Senator", "State Board of Education": "State Board of Education Member"}
TX_CHAIRS = ("County Chair", "Precinct Chair")
TX_PARTIES = {"democratic": "D", "republican": "R"}
TX_COUNTY_AFTER = ("Criminal District Attorney", "Criminal District Judge")
# Fixed values of Texas: political scope, election scope, kind of district, and the offices of them.
TX_SCOPES = (
    ("federal", "district", "us_congressional", ("U.S. House",)),
    ("federal", "state", None, ("U.S. Senate",)),
    ("state", "state", None, ("Governor", "Lieutenant Governor", "Attorney General", "Railroad Commissioner", "Commissioner of Agriculture", "Commissioner of the General Land Office", "Comptroller of Public Accounts", "Chief Justice - Supreme Court", "Justice - Supreme Court", "Judge - Court of Criminal Appeals")),
    ("state", "district", "board_of_education", ("State Board of Education",)),
    ("state", "district", "state_house", ("State House",)),
    ("state", "district", "state_senate", ("State Senate",)),
    ("state", "district", "court_of_appeals", ("Chief Justice - Court of Appeals", "Justice - Court of Appeals")),
    ("state", "district", "judicial", ("District Judge", "District Attorney")),
    ("local", "district", "county", ("County Commissioner",)),
    ("local", "county", None, ("Criminal District Attorney", "County Judge", "County Clerk", "District Clerk", "County Attorney", "County Treasurer", "County Surveyor", "County Tax Assessor-Collector", "County Chair (D)", "County Chair (R)", "County & District Clerk", "Sheriff", "Judge - County Court at Law", "Judge - 1st Multicounty Court at Law", "Judge - County Civil Court at Law", "Judge - County Criminal Court of Appeals", "Judge - County Criminal Court at Law", "Judge - Probate Court", "Criminal District Judge")),
    ("local", "district", "justice_of_the_peace", ("Justice of the Peace",)),
    ("local", "district", "constable", ("County Constable",)),
    ("local", "district", "voting_precinct", ("Precinct Chair", "Precinct Chair (D)", "Precinct Chair (R)")),
    ("local", "county", None, ("County School Trustee",)),
)
# Fixed values of Texas: the appeals court that the whole state elects; the county whose trustees stand for districts, by position.
TX_STATE_APPEALS = "15"
TX_TRUSTEES = ("harris", {"3": "At Large", "5": "At Large", "7": "At Large", "1": "2", "2": "4", "4": "3", "6": "1"})
# Fixed values of Texas: ranks of titles; of the appeals courts, that of the whole state first.
TX_RANKS = {
    1: ("U.S. President",), 2: ("U.S. Vice President",), 3: ("U.S. Senator",), 4: ("U.S. Representative",), 5: ("Governor",), 6: ("Lieutenant Governor",), 7: ("Secretary of State",), 8: ("Attorney General",),
    9: ("Comptroller of Public Accounts",), 10: ("Commissioner of the General Land Office",), 11: ("Commissioner of Agriculture",), 12: ("Railroad Commissioner",), 15: ("Chief Justice - Supreme Court",), 16: ("Justice - Supreme Court",),
    17: ("Judge - Court of Criminal Appeals",), 18: ("State Board of Education",), 19: ("State Senator",), 20: ("State Representative",), 23: ("Chief Justice - Court of Appeals",), 24: ("Justice - Court of Appeals",), 25: ("District Judge",),
    26: ("District Attorney",), 27: ("Criminal District Judge",), 28: ("Criminal District Attorney",), 30: ("County Judge",), 31: ("Judge - County Court at Law",), 32: ("Judge - 1st Multicounty Court at Law",), 35: ("Judge - County Civil Court at Law",),
    36: ("Judge - County Criminal Court of Appeals",), 37: ("Judge - County Criminal Court at Law",), 38: ("Judge - Probate Court",), 40: ("County Attorney",), 41: ("District Clerk",), 42: ("County Clerk", "County & District Clerk"), 44: ("Sheriff",),
    45: ("County Tax Assessor-Collector",), 46: ("County Treasurer",), 47: ("County Surveyor",), 48: ("County School Trustee",), 50: ("County Commissioner",), 51: ("Justice of the Peace",), 52: ("County Constable",), 55: ("County Chair (D)", "County Chair (R)"),
    56: ("Precinct Chair (D)", "Precinct Chair (R)"), 60: ("Mayor",), 61: ("City Council",),
}
# primaries' parties by code, of each state.
PRIMARIES = {"MN": {"N": "Nonpartisan", "REP": "Republican", "DEM": "Democratic", "DFL": "Democratic"}, "TX": {"R": "Republican", "REP": "Republican", "D": "Democratic", "DEM": "Democratic"}}

def _nothing() -> Column:
    return F.lit(None).cast("string")


def _struct(**parts: Column) -> Column:
    return F.struct(*(parts.get(k, _nothing()).cast("string").alias(k) for k in PARTS))


def _chamber(text: Column) -> Column:
    return first_match((Rule(said, (), (), p) for p, said in CHAMBERS), text)


def mn_office(title: Column, county: Column | None = None, county_id: Column | None = None) -> Column:
    """What a Minnesota title says of its office: a struct of ``PARTS``. A title that no rule knows is name and title itself; null gives nulls."""
    low = F.lower(title)
    named = [Rule(said if phrases else "{}", (phrases,) if phrases else (), (), None if phrases else said) for phrases, said, _ in MN_NAMES]
    titled = [Rule(said if phrases else "{}", (phrases,) if phrases else (), (), None if phrases else name) for phrases, name, said in MN_NAMES]
    name = first_match(named, title, low, title)
    soil = holds(low, "soil and water supervisor")
    by_district = F.coalesce(county_id.isin(*MN_SOIL_COUNTIES), F.lit(False)) if county_id is not None else F.lit(False)
    kind = F.when(soil & ~by_district & ~holds(low, ("u.s. representative", "state senator", "state representative")), _nothing()).otherwise(first_match([Rule(said, (phrases,)) for phrases, said in MN_DISTRICT_TYPES], title, low))
    scope = F.when(title.isNull(), _nothing()).when(soil, F.when(by_district, "district").otherwise("county")).otherwise(first_match(MN_SCOPES, title, low, F.lit("state")))
    politics = (
        F.when(scope == "state", F.when(F.lower(name).contains("u.s. senate"), "federal").otherwise("state"))
        .when((scope == "district") & (kind == "us_congressional"), F.when(name.startswith("U.S."), "federal").otherwise("state"))
        .when((scope == "district") & kind.isin("state_senate", "state_house"), "state")
        .when(scope.isNotNull(), "local")
    )
    return _struct(
        name=name,
        title=first_match(titled, title, low, title),
        chamber=_chamber(title),
        political_scope=politics,
        election_scope=scope,
        district_type=kind,
        district=first_match(MN_DISTRICTS, title, low),
        seat=first_match(MN_SEATS, title, low),
        county=_nothing() if county is None else county,
        municipality=first_match(MN_PLACES, title, low),
        school_district=captured(title, "\\((SSD #[0-9]+|ISD #[0-9]+)\\)"),
        hospital_district=first_match(MN_HOSPITALS, title, low),
    )


def _longest_first(counties: Column | Sequence[str]) -> Column:
    if not isinstance(counties, Column):
        return F.array(*map(F.lit, sorted(counties, key=lambda c: -len(c)))).cast("array<string>")
    by = F.array_sort(F.transform(counties, lambda c, i: F.struct(-F.length(c), i, c.alias("c"))))
    return F.transform(by, lambda s: s["c"])


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def county_before(title: Column, counties: Column | Sequence[str]) -> Column:
    """A struct (county, rest) of "KLEBERG - COUNTY JUDGE"; without one of the counties before a hyphen, null and the title."""
    pattern = "(?s)^\\s*([A-Z][A-Za-z\\s]+?)\\s*-\\s*(.*)$"

    def split(t: Column) -> Column:
        return F.struct(F.regexp_replace(F.regexp_extract(t, pattern, 1), "(?i)^lasalle$", "La Salle").alias("c"), F.trim(F.regexp_extract(t, pattern, 2)).alias("r"), F.trim(t).alias("t"))

    def told(x: Column) -> Column:
        own = F.try_element_at(F.filter(_longest_first(counties), lambda c: F.lower(c) == F.lower(x["c"])), F.lit(1))
        known = own.isNotNull() & (x["r"] != "")
        return F.struct(F.when(known, x["c"]).alias("county"), F.when(known, x["r"]).otherwise(x["t"]).alias("rest"))

    return _let(_let(title, split), told)


def county_within(title: Column, counties: Column | Sequence[str]) -> Column:
    """A struct (county, rest) of "CRIMINAL DISTRICT JUDGE DALLAS COUNTY NUMBER 1", the longest county first; without one, null and the title."""
    needle = lambda c: F.concat(F.lit(" "), F.upper(c), F.lit(" COUNTY"))

    def find(t: Column) -> Column:
        return F.struct(t.alias("t"), F.try_element_at(F.filter(_longest_first(counties), lambda c: F.contains(F.upper(t), needle(c))), F.lit(1)).alias("c"))

    def cut(x: Column) -> Column:
        at = F.position(needle(x["c"]), F.upper(x["t"]))
        rest = F.concat_ws(" ", F.substring(x["t"], F.lit(1), at - 1), F.substring(x["t"], at + F.length(x["c"]) + F.lit(8), F.length(x["t"])))
        return F.struct(x["c"].alias("county"), _squeezed(F.when(x["c"].isNotNull(), rest).otherwise(x["t"])).alias("rest"))

    return _let(_let(F.trim(title), find), cut)


def _list(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "[&,\\s]+"), lambda x: x != ""), ", ")


def tx_seat(title: Column) -> Column:
    """A struct (seat, rest): the number after "place", and the title without its first one."""
    place = "place\\s+([0-9]{1,3})"
    rest = lambda t: F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, f"(?is)^(.*?){place}", "$1")), ",+$", ""))
    return _let(title, lambda t: F.struct(captured(t, f"(?i){place}").alias("seat"), rest(t).alias("rest")))


def _tx_plain(title: Column, counties: Column | Sequence[str]) -> Column:
    """A title in small letters without its county."""
    return F.lower(county_within(county_before(title, counties)["rest"], counties)["rest"])


def tx_district(title: Column, seat: Column, counties: Column | Sequence[str]) -> Column:
    """The district that a title without its seat names, the most specific wording first."""
    segment_start, precincts = "(?U)^[\\p{L}.\\s]+", "(?i)(?:precinct|pct\\.?)\\s+([0-9][0-9\\s,&]*)"
    of_chair = "(?i)precinct\\s+chair\\s*[,]?\\s*(?:\\s*-\\s*)?\\s*(?:pct\\.?\\s*)?(?:precinct\\s+)?\\s*([0-9]+[A-Za-z]?(?:\\s*[,&]\\s*[0-9]+[A-Za-z]?)*)"
    by_seat = F.try_element_at(F.create_map(*(F.lit(x) for kv in TX_TRUSTEES[1].items() for x in kv)), F.trim(seat))
    listed = lambda s: F.when(s.rlike("[&,]"), _list(s)).otherwise(F.trim(s))

    def told(x: Column) -> Column:
        t, low = x["t"], x["low"]
        take = lambda pattern: captured(t, f"(?i){pattern}")
        segment = F.regexp_replace(F.regexp_replace(take("pchr_(.+?)_(?:rep|dem)"), segment_start, ""), "\\.", "")
        number = lambda n: F.when(n.contains("&"), _list(n)).otherwise(n)
        return F.coalesce(
            F.when(low.contains("pchr_"), F.nullif(F.trim(segment), F.lit(""))),
            F.when(low.contains("court of appeals"), take("([0-9]{1,3})(?:st|nd|rd|th)\\s+court\\s+of\\s+appeals\\s+district")),
            F.when(low.contains("judicial district"), take("([0-9]{1,3})(?:st|nd|rd|th)\\s+judicial\\s+district")),
            F.when(holds(low, ("precinct", "pct")) & ~low.contains("precinct chair"), _list(captured(t, precincts))),
            take("([0-9]{1,3})(?:st|nd|rd|th)\\s+district"),
            captured(t, "#\\s*([0-9][0-9A-Za-z-]*)"),
            _let(F.trim(take("no\\.\\s*([0-9][0-9A-Za-z\\s&\\-]*)")), number),
            take("number\\s+([0-9][0-9A-Za-z-]*)"),
            take("position\\s+([0-9]+)"),
            take("district\\s+([0-9]{1,3}[A-Za-z]*)"),
            F.when(low.contains("precinct chairman"), _list(captured(t, precincts)))
            .when(low.contains("precinct chair"), _let(captured(t, of_chair), listed))
            .when(low.contains(f"{TX_TRUSTEES[0]} county department of education"), by_seat),
        )

    return _let(_let(title, lambda t: F.struct(t.alias("t"), _tx_plain(t, counties).alias("low"))), told)


def tx_office(title: Column, party: Column, county: Column, counties: Column | Sequence[str]) -> Column:
    """What a Texas filing says of its office: a struct of ``PARTS``, with nulls where no rule knows the title.

    ``counties``: the names of the counties, as a list or an array column; a title's own one is looked for where the filing gives none.
    """
    letter = F.try_element_at(F.create_map(*(F.lit(x) for kv in TX_PARTIES.items() for x in kv)), F.lower(F.trim(party)))
    titles = F.create_map(*(F.lit(x) for kv in TX_TITLES.items() for x in kv))

    def named(t: Column) -> Column:
        return _let(_tx_plain(t, counties), lambda plain: F.struct(t.alias("t"), first_match(TX_NAMES, plain, plain).alias("name")))

    def placed(x: Column) -> Column:
        name = F.when(x["name"].isin(*TX_CHAIRS) & letter.isNotNull(), F.concat(x["name"], F.lit(" ("), letter, F.lit(")"))).otherwise(x["name"])
        own = F.when(x["name"].isin(*TX_COUNTY_AFTER), county_within(x["t"], counties)).otherwise(county_before(x["t"], counties))
        of = lambda own: F.struct(name.alias("name"), F.coalesce(F.nullif(F.trim(county), F.lit("")), own["county"]).alias("county"), tx_seat(_squeezed(own["rest"])).alias("s"))
        return _let(own, of)

    def with_district(x: Column) -> Column:
        seat = x["s"]["seat"]
        return F.struct(x["name"].alias("name"), title_case(x["county"]).alias("county"), seat.alias("seat"), tx_district(x["s"]["rest"], seat, counties).alias("district"))

    def parts(x: Column) -> Column:
        name, district, known = x["name"], x["district"], x["name"].isNotNull()
        whole_state = name.isin("Chief Justice - Court of Appeals", "Justice - Court of Appeals") & F.coalesce(district == TX_STATE_APPEALS, F.lit(False))
        whole_county = name.isin("Justice of the Peace", "County Constable") & (F.coalesce(F.trim(district), F.lit("")) == "")
        trustee = (name == "County School Trustee") & F.coalesce(F.lower(F.trim(x["county"])) == TX_TRUSTEES[0], F.lit(False)) & ~F.coalesce(x["seat"].isin("3", "5", "7"), F.lit(False))
        return _struct(
            name=name,
            title=F.coalesce(F.try_element_at(titles, name), name),
            chamber=F.when(name.isin("U.S. Senate", "State Senate"), "senate").when(name.isin("U.S. House", "State House"), "house"),
            political_scope=_by_name(name, 0),
            election_scope=F.when(whole_state, "state").when(whole_county, "county").when(trustee, "district").otherwise(_by_name(name, 1)),
            district_type=F.when(whole_state | whole_county, _nothing()).when(trustee, "county").otherwise(_by_name(name, 2)),
            district=F.when(known, district),
            seat=F.when(known, x["seat"]),
            county=F.when(known, x["county"]),
        )

    text = F.trim(F.regexp_replace(F.regexp_replace(title, "\\s+$", ""), "(?i) - unexpired term$", ""))
    return _let(_let(_let(_let(text, named), placed), with_district), parts)


def _by_name(name: Column, part: int) -> Column:
    out = None
    for row in TX_SCOPES:
        test = name.isin(*row[3])
        out = F.when(test, F.lit(row[part]).cast("string")) if out is None else out.when(test, F.lit(row[part]).cast("string"))
    return out


def tx_rank(title: Column, district: Column) -> Column:
    """The place of an office in lists; the appeals court of the whole state stands before the others."""
    title = F.trim(title)
    out = None
    for rank, titles in TX_RANKS.items():
        out = F.when(title.isin(*titles), rank) if out is None else out.when(title.isin(*titles), rank)
    appeals = title.isin("Chief Justice - Court of Appeals", "Justice - Court of Appeals") & F.coalesce(district == TX_STATE_APPEALS, F.lit(False))
    return F.when(appeals, out - 2).otherwise(out)


def _held(part: Column) -> Column:
    return F.coalesce(part, F.lit(""))


def office_slug(o: Column, state: str) -> Column:
    """The slug of an office (a struct of ``PARTS``), of the parts that tell it from others of its scope and kind of district; null without a name, empty without a scope."""
    name = F.replace(F.replace(o["name"], F.lit("."), F.lit("")), F.lit("&"), F.lit("and"))
    kind, scope = o["district_type"], o["election_scope"]
    line = lambda *parts: F.concat_ws(" ", F.lit(state), name, *(_held(p) for p in parts))
    where = [o["district"], o["seat"]]
    if state == "TX":
        county = F.when(o["county"] != "", F.concat(o["county"], F.lit(" county")))
        said = (
            F.when(o["name"] == "Judge - 1st Multicounty Court at Law", line())
            .when(o["name"] == "County School Trustee", line(county, o["seat"], o["district"]))
            .when(scope == "state", line(*where))
            .when((scope == "county") | kind.isin("county", "justice_of_the_peace", "constable", "voting_precinct"), line(county, *where))
            .when((scope == "district") & (kind == "school"), line(o["school_district"], *where))
            .when(scope == "district", line(*where))
            .otherwise(line(o["county"], *where))
        )
        return slug_of_words(F.when(name.isNotNull(), said))
    county, town = F.concat(_held(o["county"]), F.lit(" county")), F.replace(_held(o["municipality"]), F.lit("Township"), F.lit("Twp"))
    district = (
        F.when(kind.isin("county", "soil_and_water"), line(county, *where))
        .when(kind.isin("city", "park"), line(town, county, *where))
        .when(kind == "school", line(o["school_district"], *where))
        .when(kind == "judicial", line(o["seat"]))
        .when(kind == "hospital", line(o["hospital_district"], *where))
        .otherwise(line(*where))
    )
    said = F.when(scope == "state", line(*where)).when(scope == "county", line(county, *where)).when(scope == "city", line(town, county, o["school_district"], *where)).when(scope == "district", district)
    return slug_of_words(F.when(name.isNotNull(), F.coalesce(said, F.lit(""))))


def _both(*parts: Column | str) -> Column:
    """A long and a short line of parts that are alike in both; a null part makes them null."""
    said = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.struct(said.alias("long"), said.alias("short"))


def _two(long: Column, short: Column) -> Column:
    return F.struct(long.alias("long"), short.alias("short"))


def mn_subtitle(o: Column) -> Column:
    """The line under a Minnesota office, a struct of a long and a short form."""
    kind, scope, seat, district, county, town = (o[k] for k in ("district_type", "election_scope", "seat", "district", "county", "municipality"))
    at_large = F.lower(seat).contains("at large")
    seated = F.when(seat.isNull(), "").when(at_large, F.concat(F.lit(" - "), seat)).otherwise(F.concat(F.lit(" - Seat "), seat))
    digits = district.rlike("(?U)^\\p{N}*$")
    numbered = lambda base, label="District": _two(F.concat(base, F.lit(f" - {label} "), district), F.concat(base, F.lit(" - "), district))
    in_county, in_town = F.concat(county, F.lit(" County, MN")), F.concat(town, F.lit(", MN"))
    state = _both("MN")
    ward = F.trim(F.replace(F.replace(F.replace(F.replace(district, F.lit("Ward "), F.lit("")), F.lit("Wards "), F.lit("")), F.lit("Section "), F.lit("")), F.lit("Precinct "), F.lit("")))
    city = F.when(town.isNull(), state).when(district.isNull(), _both(in_town)).when(digits, numbered(in_town)).otherwise(_two(F.concat(in_town, F.lit(" - "), district), F.when(ward == "", in_town).otherwise(F.concat(in_town, F.lit(" - "), ward))))
    park = F.when(town.isNull(), state).when(district.isNull(), _both(in_town)).when(digits, numbered(in_town)).otherwise(_both(in_town, " - ", district))
    school = F.concat(F.lit("MN - "), o["school_district"])
    schools = (
        F.when(school.isNull(), state)
        .when(district.isNull(), _both(school, seated))
        .when(digits, _two(F.concat(school, F.lit(" - District "), district, seated), F.concat(school, F.lit(" - "), district, seated)))
        .otherwise(_both(school, " - ", district, seated))
    )
    hospital = o["hospital_district"]
    hospitals = F.when(hospital.isNull(), state).when(digits, _two(F.concat(hospital, F.lit(" - District "), district, seated), F.concat(hospital, F.lit(" - "), district, seated))).otherwise(_both(hospital, seated))
    of_county = F.when(county.isNull() | district.isNull(), state).otherwise(numbered(in_county))
    judge = F.when(seat.isNull(), state).otherwise(_two(F.concat(F.lit("MN - Seat "), seat), F.concat(F.lit("MN - "), seat)))
    plain = lambda label: F.when(district.isNull(), state).otherwise(numbered(F.lit("MN"), label))
    same_names = town.isin(*MN_SAME_NAMES) & county.isNotNull()
    return (
        F.when((scope == "state") & ((o["name"] == "U.S. Senate") | seat.isNull()), _two(F.lit("Minnesota"), F.lit("MN")))
        .when(scope == "state", _two(F.concat(F.lit("MN"), seated), F.concat(F.lit("MN - "), seat)))
        .when(scope == "county", F.when(county.isNull(), state).when(district.isNull(), _both(in_county)).otherwise(numbered(in_county)))
        .when(scope == "city", F.when(town.isNull(), state).when(same_names, _both(town, " - ", in_county, seated)).otherwise(_both(in_town, seated)))
        .when((scope == "district") & (kind == "us_congressional"), plain("District"))
        .when((scope == "district") & (kind == "state_house"), plain("House District"))
        .when((scope == "district") & (kind == "state_senate"), plain("Senate District"))
        .when((scope == "district") & kind.isin("county", "soil_and_water"), of_county)
        .when((scope == "district") & (kind == "city"), city)
        .when((scope == "district") & (kind == "school"), schools)
        .when((scope == "district") & (kind == "judicial"), judge)
        .when((scope == "district") & (kind == "hospital"), hospitals)
        .when((scope == "district") & (kind == "park"), park)
        .when(scope == "district", state)
        .otherwise(_both(""))
    )


def tx_subtitle(o: Column) -> Column:
    """The line under a Texas office, a struct of a long and a short form."""
    kind, scope, seat, district, county = (o[k] for k in ("district_type", "election_scope", "seat", "district", "county"))

    def labelled(said: Column, label: str, shown: Column | None = None) -> tuple[Column, Column]:
        """Long and short; empty for null, without the label at large."""
        shown = said if shown is None else shown
        short = F.concat(F.lit(" - "), shown)
        long = F.when(F.lower(F.trim(said)) == "at large", short).otherwise(F.concat(F.lit(f" - {label} "), shown))
        return F.coalesce(long, F.lit("")), F.coalesce(short, F.lit(""))

    items = F.filter(F.transform(F.split(district, ","), lambda x: F.trim(x)), lambda x: x != "")
    shown = F.when(F.size(items) == 0, F.trim(district)).when(F.size(items) == 2, F.array_join(items, " & ")).otherwise(F.array_join(items, ", "))
    here = lambda label: labelled(district, label, shown)
    line = lambda base, *ends: _two(F.concat(base, *(e[0] for e in ends)), F.concat(base, *(e[1] for e in ends)))
    state, texas = F.lit("TX"), _two(F.lit("Texas"), F.lit("TX"))
    in_county, courts = F.concat(county, F.lit(" County, TX")), F.lower(F.coalesce(o["name"], F.lit(""))).contains("court")
    seats = labelled(seat, "Seat")
    only_state = line(state)
    trustee = line(in_county, labelled(seat, "Position"), here("Precinct"))
    whole_county = F.when(courts, line(in_county, here("Court"), seats)).otherwise(line(in_county, here("District"), seats))
    precinct = F.when(county.isNull(), only_state).otherwise(line(in_county, here("Precinct"), labelled(seat, "Place")))
    of_kind = (
        F.when(kind == "us_congressional", line(state, here("District")))
        .when(kind == "state_house", line(state, here("House District")))
        .when(kind == "state_senate", line(state, here("Senate District")))
        .when(kind.isin("county", "justice_of_the_peace", "constable", "voting_precinct"), precinct)
        .when(kind.isin("judicial", "court_of_appeals"), line(state, here("District"), seats))
        .when(kind.isin("school", "board_of_education"), F.when(district.isNull(), only_state).otherwise(line(state, here("District"), labelled(seat, "Place"))))
        .otherwise(only_state)
    )
    town = F.concat(o["municipality"], F.lit(", TX"))
    return (
        F.when((o["name"] == "County School Trustee") & county.isNotNull(), trustee)
        .when((scope == "state") & ((o["name"] == "U.S. Senate") | seat.isNull()), texas)
        .when(scope == "state", line(state, here("District"), seats))
        .when(scope == "county", F.when(county.isNull(), _two(F.concat(F.lit("Texas"), seats[0]), F.concat(F.lit("TX"), seats[1]))).otherwise(whole_county))
        .when(scope == "district", of_kind)
        .when(scope == "city", F.when(town.isNull(), only_state).otherwise(_both(town, F.coalesce(F.concat(F.lit(" - "), seat), F.lit("")))))
        .otherwise(_both(""))
    )


def race_title(state: str, name: Column, subtitle: Column, special: Column, primary: Column, party: Column, year: Column) -> Column:
    """A struct (title, slug): state, office, what stands under it, whether special, primary of which party or general, year."""
    under = F.when(subtitle.startswith(f"{state} - "), F.substring(subtitle, 6, 10_000)).otherwise(subtitle)
    some = lambda p: F.when(p != "", p)
    of_party = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIMARIES[state].items() for x in kv)), party), some(party))
    kind = F.when(primary, F.concat_ws(" - ", F.lit("Primary"), of_party)).otherwise("General")
    title = F.trim(F.regexp_replace(F.concat_ws(" - ", F.lit(state), some(name), some(under), F.when(special, "Special Election"), kind, year.cast("string")), "  +", " "))
    return F.struct(title.alias("title"), slug_of_words(F.replace(title, F.lit("."), F.lit(""))).alias("slug"))


def source_key(*parts: Column) -> Column:
    """The key that a source's record is known by: its parts as one slug."""
    return slug_of_words(F.concat_ws("-", *parts))
