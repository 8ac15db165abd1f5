"""Titles of offices and races, made of the columns of a table, taken apart and put together again; SQL says what each kind gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions import offices
from agora.operators import elections

from .catalog import query, read


def cases(key: str, kinds: list[dict[str, str]], columns: tuple[str, ...]) -> str:
    """SQL: per column one CASE over the kinds; what a kind doesn't name is null."""
    return ", ".join(f"CASE {key} {' '.join(f'WHEN {i} THEN {kind[c]}' for i, kind in enumerate(kinds) if c in kind)} END AS {c}" for c in columns)


def fill(template: str, **parts):
    """A text with columns in its braces."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before)] * bool(before) + [parts[name].cast("string")]
    return F.concat(*out, *[F.lit(rest)] * bool(rest))


def filled(templates: list[str], key, **parts):
    out = None
    for i, t in enumerate(templates):
        out = F.when(key == i, fill(t, **parts)) if out is None else out.when(key == i, fill(t, **parts))
    return out


_OFFICE = ("name", "title", "chamber", "political_scope", "election_scope", "district_type", "district", "seat", "municipality", "school_district", "hospital_district", "slug", "long", "short")
MN_TITLES = [
    "U.S. Representative District {n}",
    "State Senator District {n}A",
    "Council Member Ward {n} ({m})",
    "School Board Member Position {n} (ISD #535)",
    "Judge - {n}th District Court {p}",
    "Soil and Water Supervisor District {n} (East)",
    "Mayor ({m})",
    "Hospital District Board Member {p} (Cook County)",
    "Council Member Seat {n} ({m})",
    "Warden of {m}",
]
_SOIL = f"n IN ({', '.join(map(str, offices.MN_SOIL_COUNTIES))})"
MN_SAID = [
    {"name": "'U.S. House'", "title": "'U.S. Representative'", "chamber": "'house'", "political_scope": "'federal'", "election_scope": "'district'", "district_type": "'us_congressional'", "district": "n::VARCHAR", "slug": "'mn-us-house-' || n", "long": "'MN - District ' || n", "short": "'MN - ' || n"},
    {"name": "'State Senate'", "title": "'State Senator'", "chamber": "'senate'", "political_scope": "'state'", "election_scope": "'district'", "district_type": "'state_senate'", "district": "n || 'A'", "slug": "'mn-state-senate-' || n || 'a'", "long": "'MN - Senate District ' || n || 'A'", "short": "'MN - ' || n || 'A'"},
    {"name": "'City Council'", "title": "'City Council Member'", "political_scope": "'local'", "election_scope": "'district'", "district_type": "'city'", "district": "'Ward ' || n", "municipality": "m", "slug": "'mn-city-council-' || lower(m) || '-' || lower(c) || '-county-ward-' || n", "long": "m || ', MN - Ward ' || n", "short": "m || ', MN - ' || n"},
    {"name": "'School Board'", "title": "'School Board Member'", "political_scope": "'local'", "election_scope": "'district'", "district_type": "'school'", "seat": "n::VARCHAR", "school_district": "'ISD #535'", "slug": "'mn-school-board-isd-535-' || n", "long": "'MN - ISD #535 - Seat ' || n", "short": "'MN - ISD #535 - Seat ' || n"},
    {"name": "'Judge - ' || n || 'th District'", "title": "'Judge - ' || n || 'th District'", "political_scope": "'local'", "election_scope": "'district'", "district_type": "'judicial'", "district": "n::VARCHAR", "seat": "p::VARCHAR", "slug": "'mn-judge-' || n || 'th-district-' || p", "long": "'MN - Seat ' || p", "short": "'MN - ' || p"},
    {
        "name": "'Soil and Water Supervisor'", "title": "'Soil and Water Supervisor'", "political_scope": "'local'", "election_scope": f"CASE WHEN {_SOIL} THEN 'district' ELSE 'county' END", "district_type": f"CASE WHEN {_SOIL} THEN 'soil_and_water' END", "district": "n || ' (East)'",
        "slug": "'mn-soil-and-water-supervisor-' || lower(c) || '-county-' || n || '-east'", "long": "c || ' County, MN - District ' || n || ' (East)'", "short": "c || ' County, MN - ' || n || ' (East)'",
    },
    {"name": "'Mayor'", "title": "'Mayor'", "political_scope": "'local'", "election_scope": "'city'", "municipality": "m", "slug": "'mn-mayor-' || lower(m) || '-' || lower(c) || '-county'", "long": "m || ', MN'", "short": "m || ', MN'"},
    {"name": "'Hospital District Board'", "title": "'Hospital District Board Member'", "political_scope": "'local'", "election_scope": "'district'", "district_type": "'hospital'", "district": "p::VARCHAR", "hospital_district": "'Cook County'", "slug": "'mn-hospital-district-board-cook-county-' || p", "long": "'Cook County - District ' || p", "short": "'Cook County - ' || p"},
    {"name": "'City Council'", "title": "'City Council Member'", "political_scope": "'local'", "election_scope": "'city'", "seat": "'At Large - ' || n", "municipality": "m", "slug": "'mn-city-council-' || lower(m) || '-' || lower(c) || '-county-at-large-' || n", "long": "m || ', MN - At Large - ' || n", "short": "m || ', MN - At Large - ' || n"},
    {"name": "'Warden of ' || m", "title": "'Warden of ' || m", "political_scope": "'state'", "election_scope": "'state'", "slug": "'mn-warden-of-' || lower(m)", "long": "'Minnesota'", "short": "'MN'"},
]


@query(f"WITH t AS (SELECT c_custkey, c_custkey % {len(MN_TITLES)} AS k, c_nationkey AS n, c_custkey % 7 + 1 AS p, c_mktsegment AS m, CASE c_custkey % 3 WHEN 0 THEN 'Aitkin' WHEN 1 THEN 'Carver' ELSE 'Dodge' END AS c FROM customer) SELECT c_custkey, {cases('k', MN_SAID, _OFFICE)} FROM t")
def offices_of_titles(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    title = filled(MN_TITLES, F.col("c_custkey") % len(MN_TITLES), n=F.col("c_nationkey"), p=F.col("c_custkey") % 7 + 1, m=F.col("c_mktsegment"))
    county = F.element_at(F.array(*map(F.lit, ("Aitkin", "Carver", "Dodge"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    o = c.select("c_custkey", offices.mn_office(title, county, F.col("c_nationkey")).alias("o"))
    o = o.select("c_custkey", "o", offices.office_slug(F.col("o"), "MN").alias("slug"), offices.mn_subtitle(F.col("o")).alias("s"))
    return o.select("c_custkey", *(F.col(f"o.{x}") for x in _OFFICE[:-3]), "slug", "s.long", "s.short")


_FILED = ("name", "title", "chamber", "political_scope", "election_scope", "district_type", "district", "seat", "county", "slug", "long", "short", "rank", "race", "race_slug")
TX_TITLES = [
    "{r} - COUNTY COMMISSIONER PRECINCT {n}",
    "CRIMINAL DISTRICT JUDGE  {r} COUNTY NUMBER {n}",
    "JUSTICE, {n}TH COURT OF APPEALS DISTRICT, PLACE {p}",
    "{r} - JUSTICE OF THE PEACE PRECINCT {n} & {p}, PLACE 2 - Unexpired Term  ",
    "U. S. REPRESENTATIVE DISTRICT {n}",
    "{r} - PRECINCT CHAIR PCHR_P.{n}A_REP",
    "NOBODY - CONSTABLE AT SEA",
    "{r} - COUNTY CONSTABLE",
]
_TX_SAID = [
    {"name": "'County Commissioner'", "political_scope": "'local'", "election_scope": "'district'", "district_type": "'county'", "district": "n::VARCHAR", "county": "c", "slug": "'tx-county-commissioner-' || s || '-county-' || n", "long": "c || ' County, TX - Precinct ' || n", "short": "c || ' County, TX - ' || n", "rank": "50"},
    {"name": "'Criminal District Judge'", "political_scope": "'local'", "election_scope": "'county'", "district": "n::VARCHAR", "county": "c", "slug": "'tx-criminal-district-judge-' || s || '-county-' || n", "long": "c || ' County, TX - District ' || n", "short": "c || ' County, TX - ' || n", "rank": "27"},
    {
        "name": "'Justice - Court of Appeals'", "political_scope": "'state'", "election_scope": "CASE n WHEN 15 THEN 'state' ELSE 'district' END", "district_type": "CASE WHEN n <> 15 THEN 'court_of_appeals' END", "district": "n::VARCHAR", "seat": "p::VARCHAR",
        "slug": "'tx-justice-court-of-appeals-' || n || '-' || p", "long": "'TX - District ' || n || ' - Seat ' || p", "short": "'TX - ' || n || ' - ' || p", "rank": "CASE n WHEN 15 THEN 22 ELSE 24 END",
    },
    {"name": "'Justice of the Peace'", "political_scope": "'local'", "election_scope": "'district'", "district_type": "'justice_of_the_peace'", "district": "n || ', ' || p", "seat": "'2'", "county": "c", "slug": "'tx-justice-of-the-peace-' || s || '-county-' || n || '-' || p || '-2'", "long": "c || ' County, TX - Precinct ' || n || ' & ' || p || ' - Place 2'", "short": "c || ' County, TX - ' || n || ' & ' || p || ' - 2'", "rank": "51"},
    {"name": "'U.S. House'", "title": "'U.S. Representative'", "chamber": "'house'", "political_scope": "'federal'", "election_scope": "'district'", "district_type": "'us_congressional'", "district": "n::VARCHAR", "slug": "'tx-us-house-' || n", "long": "'TX - District ' || n", "short": "'TX - ' || n", "rank": "4"},
    {"name": "'Precinct Chair (' || y || ')'", "political_scope": "'local'", "election_scope": "'district'", "district_type": "'voting_precinct'", "district": "n || 'A'", "county": "c", "slug": "'tx-precinct-chair-' || lower(y) || '-' || s || '-county-' || n || 'a'", "long": "c || ' County, TX - Precinct ' || n || 'A'", "short": "c || ' County, TX - ' || n || 'A'", "rank": "56"},
    {},
    {"name": "'County Constable'", "political_scope": "'local'", "election_scope": "'county'", "county": "c", "slug": "'tx-county-constable-' || s || '-county'", "long": "c || ' County, TX'", "short": "c || ' County, TX'", "rank": "52"},
]
_UNDER = "CASE WHEN long LIKE 'TX - %' THEN long[6:] ELSE long END"
_RACE = f"'TX - ' || name || ' - ' || {_UNDER} || CASE WHEN special THEN ' - Special Election' ELSE '' END || ' - Primary - ' || CASE y WHEN 'D' THEN 'Democratic' ELSE 'Republican' END || ' - 2026'"


@query(
    f"""WITH t AS (SELECT o_orderkey, o_orderkey % {len(TX_TITLES)} AS k, o_custkey % 25 + 1 AS n, o_custkey % 3 + 1 AS p, CASE o_orderstatus WHEN 'F' THEN 'D' ELSE 'R' END AS y, o_custkey % 10 = 0 AS special, r_name AS r,
      array_to_string(list_transform(string_split(r_name, ' '), lambda w: w[1:1] || lower(w[2:])), ' ') AS c, replace(lower(r_name), ' ', '-') AS s FROM orders JOIN region ON r_regionkey = o_orderkey % 5),
    u AS (SELECT o_orderkey, y, special, {cases('k', _TX_SAID, _FILED[:-2])} FROM t)
    SELECT * EXCLUDE (y, special) REPLACE (coalesce(title, name) AS title), {_RACE} AS race, trim(regexp_replace(lower(replace({_RACE}, '.', '')), '[^a-z0-9]+', '-', 'g'), '-') AS race_slug FROM u WHERE name IS NOT NULL"""
)
def filings_of_titles(spark, sf_dir):
    counties = read(spark, sf_dir, "region").agg(F.collect_list("r_name").alias("counties"))  # five names
    o = read(spark, sf_dir, "orders").join(F.broadcast(read(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("o_orderkey") % 5).crossJoin(F.broadcast(counties))
    title = filled(TX_TITLES, F.col("o_orderkey") % len(TX_TITLES), n=F.col("o_custkey") % 25 + 1, p=F.col("o_custkey") % 3 + 1, r=F.col("r_name"))
    party = F.when(F.col("o_orderstatus") == "F", "Democratic").otherwise("Republican")
    o = o.select("o_orderkey", (F.col("o_custkey") % 10 == 0).alias("special"), party.alias("party"), offices.tx_office(title, party, F.lit(None).cast("string"), F.col("counties")).alias("o")).filter("o.name is not null")
    o = o.select("*", offices.office_slug(F.col("o"), "TX").alias("slug"), offices.tx_subtitle(F.col("o")).alias("s"), offices.tx_rank(F.col("o.title"), F.col("o.district")).alias("rank"))
    race = offices.race_title("TX", F.col("o.name"), F.col("s.long"), F.col("special"), F.lit(True), F.substring("party", 1, 1), F.lit(2026))
    return o.select("o_orderkey", *(F.col(f"o.{x}") for x in _FILED[:9]), "slug", "s.long", "s.short", "rank", race.alias("race")).select("*", F.col("race.slug").alias("race_slug")).withColumn("race", F.col("race.title"))


#: Two parties' primaries an office; orders are races, what was sold for them are votes of suppliers.
_PRIMARY = """WITH e AS (SELECT l_orderkey AS race_id, l_suppkey AS candidate_id, sum(l_quantity)::BIGINT AS votes FROM lineitem GROUP BY 1, 2),
t AS (SELECT race_id, sum(votes)::BIGINT AS total FROM e GROUP BY 1),
r AS (SELECT o_orderkey AS race_id, o_orderkey // 2 AS office, CASE o_orderkey % 2 WHEN 0 THEN 'Democratic' ELSE 'Republican' END AS party, CASE WHEN o_orderkey % 7 = 0 THEN 2 END AS num_elect, o_orderstatus <> 'P' AS whole, total FROM orders LEFT JOIN t ON race_id = o_orderkey),
p AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY votes DESC, candidate_id) AS place FROM e),
u AS (SELECT race_id FROM r JOIN e USING (race_id) WHERE whole GROUP BY race_id, total HAVING max(votes) / total < 0.5 AND count(*) > 2)
"""


def primaries(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("race_id"), F.col("l_suppkey").alias("candidate_id")).agg(F.sum("l_quantity").cast("bigint").alias("votes"))
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    party = F.when(k % 2 == 0, "Democratic").otherwise("Republican")
    office = F.floor(k / 2).cast("string")
    races = o.select(
        k.alias("race_id"), F.concat(F.lit("TX - House "), office, F.lit(" - Primary - "), party, F.lit(" - 2026 ")).alias("title"), F.concat(F.lit("tx-house-"), office, F.lit("-primary-"), F.lower(party), F.lit("-2026-")).alias("slug"), office.alias("office_id"), party.alias("party"),
        F.when(k % 7 == 0, 2).alias("num_elect"), F.array().cast("array<bigint>").alias("winner_ids"), F.when(F.col("o_orderstatus") != "P", 9).otherwise(8).alias("reporting"), F.lit(9).alias("precincts"),
    )
    return elections.after_primary(races.join(line.groupBy("race_id").agg(F.sum("votes").alias("total_votes")), "race_id", "left"), line)


@query(_PRIMARY + "SELECT race_id AS source_race_id, 'tx-house-' || office || '-primary-' || lower(party) || '-2026-runoff' AS slug, 'TX - House ' || office || ' - Primary - ' || party || ' - 2026 - Runoff' AS title, office::VARCHAR AS office_id, party FROM r JOIN u USING (race_id)")
def runoff_races(spark, sf_dir):
    return primaries(spark, sf_dir)["runoff_races"]


@query(_PRIMARY + "SELECT 'tx-house-' || office || '-primary-' || lower(party) || '-2026-runoff' AS slug, candidate_id FROM r JOIN u USING (race_id) JOIN p USING (race_id) WHERE place <= 2")
def runoff_candidates(spark, sf_dir):
    return primaries(spark, sf_dir)["runoff_candidates"]


@query(_PRIMARY + "SELECT 'tx-house-' || office || '-general-2026' AS slug, min(race_id) AS source_race_id, 'TX - House ' || office || ' - General - 2026' AS title, office::VARCHAR AS office_id, arg_min(coalesce(num_elect, 0), race_id) AS num_elect FROM r GROUP BY office")
def general_races(spark, sf_dir):
    return primaries(spark, sf_dir)["general_races"].withColumn("num_elect", F.coalesce("num_elect", F.lit(0)))


@query(_PRIMARY + "SELECT DISTINCT 'tx-house-' || office || '-general-2026' AS slug, candidate_id FROM r JOIN p USING (race_id) WHERE whole AND race_id NOT IN (SELECT race_id FROM u) AND place <= coalesce(num_elect, 1)")
def general_candidates(spark, sf_dir):
    return primaries(spark, sf_dir)["general_candidates"]


@query(_PRIMARY + "SELECT race_id, string_agg(candidate_id::VARCHAR, ',' ORDER BY place) AS winners FROM r JOIN p USING (race_id) WHERE whole AND place <= CASE WHEN race_id IN (SELECT race_id FROM u) THEN 2 ELSE coalesce(num_elect, 1) END GROUP BY 1")
def primary_outcomes(spark, sf_dir):
    return primaries(spark, sf_dir)["winners"].select("race_id", F.array_join(F.col("winner_ids").cast("array<string>"), ",").alias("winners"))
