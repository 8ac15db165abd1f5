"""More operators bound to tables: names, offices, candidates, bills, filters and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.functions import names
from agora.functions import text as tx
from agora.operators import candidates, elections, filters, groups, merge, reporting, search, votes

from .catalog import V, cast_votes, query, read, results
from .offices import cases, filled


def values(rows: list[tuple], columns: str) -> str:
    """Literal rows as SQL."""
    told = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) AS t({columns}))"


# names, offices, districts

#: Names made of a part's two words (first f and last g, in small letters in the table), its type t and its brand's number n.
NAMES = ['{f} {l}', '{f} {t} {l}', '{f} "{n}" {t} {l}', "{f} {t} ({n}) {l}", "{f} {t} {l}, jr", "Dr. {f}  {l} III", "{f} van {l}", "{f} st {l}", "{f} - {t} {l}", "{l}"]
NAMED = [
    {"first": "f", "last": "l"},
    {"first": "f", "last": "l", "middle": "t"},
    {"first": "f", "last": "l", "middle": "t", "preferred": "n"},
    {"first": "f", "last": "l", "middle": "t", "preferred": "n"},
    {"first": "f", "last": "l", "middle": "t", "suffix": "'jr.'"},
    {"first": "f", "last": "l", "suffix": "'III'"},
    {"first": "f", "last": "'van ' || l"},
    {"first": "f", "last": "'st. ' || l"},
    {"first": "f || '-' || t", "last": "l"},
    {},
]


@query(f"WITH p AS (SELECT p_partkey, p_partkey % {len(NAMES)} AS k, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[2] AS l, lower(p_type) AS t, 'nick' AS n FROM part) SELECT p_partkey, {cases('k', NAMED, ('first', 'last', 'middle', 'preferred', 'suffix'))} FROM p")
def person_names(spark, sf_dir):
    p, words = read(spark, sf_dir, "part"), F.split("p_name", " ")
    raw = filled(NAMES, F.col("p_partkey") % len(NAMES), f=F.get(words, 0), l=F.get(words, 1), t=F.lower("p_type"), n=F.lit("nick"))
    return p.select("p_partkey", names.person_name(raw).alias("n")).select("p_partkey", *(F.col(f"n.{c}") for c in ("first", "last", "middle", "preferred", "suffix")))


TITLES = [("HARRIS COUNTY", "Harris County"), ("SE-GWEN mccoy", "Se-Gwen McCoy"), ("o'brian iii", "O'Brian III"), ('AJ (TJ) "jim" smith jr', 'AJ (TJ) "Jim" Smith Jr'), ("vi li henry viii", "Vi Li Henry VIII"), ("j.d. VANCE", "J.D. Vance"), ("", "")]
_SEGMENT = "CASE WHEN regexp_full_match(lower(s), '[ivxlcdm]+') AND lower(s) NOT IN ('vi', 'xi', 'di', 'mi', 'im', 'id', 'ci', 'li') OR lower(s) IN ('aj', 'oj') OR (regexp_full_match(lower(s), '[b-df-hj-np-tv-z]{2}') AND lower(s) NOT IN ('jr', 'sr', 'dr')) THEN upper(s) WHEN lower(s) LIKE 'mc_%' THEN 'Mc' || upper(s[3:3]) || lower(s[4:]) ELSE upper(s[1:1]) || lower(s[2:]) END"


@query(f"SELECT raw, told FROM {values(TITLES, 'raw, told')} UNION ALL SELECT DISTINCT upper(p_type || ' ' || p_brand), array_to_string(list_transform(string_split(p_type || ' ' || p_brand, ' '), lambda s: {_SEGMENT}), ' ') FROM part")
def title_case(spark, sf_dir):
    raw = spark.createDataFrame([(r[0],) for r in TITLES], "raw string")
    raw = raw.unionByName(read(spark, sf_dir, "part").select(F.upper(F.concat_ws(" ", "p_type", "p_brand")).alias("raw")).distinct())
    return raw.select("raw", names.title_case(F.col("raw")).alias("told"))


CONTESTS = ["United States Senator", "Representative to the {n}th United States Congress - District 5", "U.S. House of Representatives District {n}", "State Senator - District {n}", "State Representative - District {n}A", "Regent of the University of Colorado - At Large", "District Attorney - {n}th Judicial District", "County Court Judge - Adams", "Supreme Court Justice - X", "Regional Transportation District Director - District A", "Mayor"]
_SAID = [
    {"office": "'U.S. Senate'", "political_scope": "'federal'", "election_scope": "'state'"},
    {"district": "'5'"},
    {"office": "'U.S. House'", "political_scope": "'federal'", "election_scope": "'district'", "district": "n::VARCHAR"},
    {"office": "'State Senate'", "political_scope": "'state'", "election_scope": "'district'", "district": "n::VARCHAR"},
    {"office": "'State House'", "political_scope": "'state'", "election_scope": "'district'", "district": "n || 'A'"},
    {"office": "'Board of Regents'", "political_scope": "'local'", "election_scope": "'district'", "seat": "'At Large'"},
    {"office": "'District Attorney'", "political_scope": "'local'", "election_scope": "'district'", "district": "n::VARCHAR"},
    {"office": "'County Court Judge'", "political_scope": "'local'", "election_scope": "'county'"},
    {"office": "'Supreme Court Justice'", "political_scope": "'state'", "election_scope": "'state'"},
    {"office": "'Regional Transportation District Director'", "political_scope": "'state'", "election_scope": "'district'", "district": "'A'"},
    {},
]


@query(f"SELECT c_custkey, {cases('k', _SAID, ('office', 'political_scope', 'election_scope', 'district', 'seat'))} FROM (SELECT c_custkey, c_custkey % {len(CONTESTS)} AS k, c_nationkey + 1 AS n FROM customer)")
def contest_offices(spark, sf_dir):
    t = filled(CONTESTS, F.col("c_custkey") % len(CONTESTS), n=F.col("c_nationkey") + 1)
    o = read(spark, sf_dir, "customer").select("c_custkey", t.alias("t")).select("c_custkey", "t", names.co_office(F.col("t")).alias("o"))
    return o.select("c_custkey", F.col("o.name").alias("office"), "o.political_scope", "o.election_scope", names.co_district(F.col("t")).alias("district"), names.co_seat(F.col("t")).alias("seat"))


CODES = ["00{n}", "W-0{n}", "00District 0{n} East", "West Ward-0{n}", "000"]
_CODED = [
    {"plain": "n::VARCHAR", "ward": "n::VARCHAR"},
    {"plain": "'W-0' || n", "ward": "n::VARCHAR"},
    {"plain": "'District 0' || n || ' East'", "ward": "'District 0' || n || ' East'", "district": "n::VARCHAR"},
    {"plain": "'West Ward-0' || n", "ward": "n::VARCHAR", "district": "'West'"},
    {"plain": "''", "ward": "''"},
]


@query(f"SELECT o_orderkey, {cases('k', _CODED, ('plain', 'ward', 'district'))} FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_custkey + 1 AS n FROM orders)")
def district_codes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", filled(CODES, F.col("o_orderkey") % 5, n=F.col("o_custkey") + 1).alias("code"))
    c = F.col("code")
    return o.select("o_orderkey", names.without_zeros(c).alias("plain"), names.ward(c).alias("ward"), names.district_or_direction(c).alias("district"))


@query("SELECT c_custkey, court FROM (SELECT c_custkey, unnest(list_filter(list_transform(string_split(c_custkey || ', ' || (c_custkey % 3) || ',,', ','), lambda x: trim(x)), lambda x: x <> '')) AS court FROM customer)")
def listed_courts(spark, sf_dir):
    said = F.concat(F.col("c_custkey").cast("string"), F.lit(", "), (F.col("c_custkey") % 3).cast("string"), F.lit(",,"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.explode(names.listed(said)).alias("court"))


PARTIES = ["R", " dfl ", "Democratic", "Registered Libertarian Party {n}", "No Party Affiliation {n}", "{n}"]
_PARTY = [{"code": "'REP'"}, {"code": "'DFL'"}, {"code": "'DEM'"}, {"name": "'Libertarian Party'"}, {"name": "'Unaffiliated'"}, {}]


@query(f"SELECT c_custkey, {cases('c_custkey % 6', _PARTY, ('code', 'name'))} FROM customer")
def party_codes(spark, sf_dir):
    said = filled(PARTIES, F.col("c_custkey") % 6, n=F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", tx.party_code(said).alias("code"), tx.party_name(said).alias("name"))


RACES = ["{m} First Choice (Elect {n})", "Special Election State Senate {n}", "Judge, County Court at Law No {n}", "Railroad Commissioner", "Precinct {n} Chair", "Sheriff and Tax Assessor-Collector", "{m} Commissioner, Place {n}"]
_RULED = [{"ranked": "true", "seats": "n"}, {"special": "true"}, {"office": "'Judge - County Court at Law'"}, {}, {"office": "'Precinct Chair'"}, {"office": "'Sheriff & County Tax Assessor-Collector'"}, {"office": "'County Commissioner'"}]


@query(f"SELECT c_custkey, coalesce(ranked, false) AS ranked, coalesce(special, false) AS special, seats, office FROM (SELECT c_custkey, {cases('k', _RULED, ('ranked', 'special', 'seats', 'office'))} FROM (SELECT c_custkey, c_custkey % 7 AS k, c_nationkey + 1 AS n FROM customer))")
def contest_rules(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", filled(RACES, F.col("c_custkey") % 7, m=F.col("c_mktsegment"), n=F.col("c_nationkey") + 1).alias("title"))
    t = F.col("title")
    return c.select("c_custkey", tx.is_ranked_choice(t).alias("ranked"), tx.is_special_election(t).alias("special"), tx.seats_to_fill(t).alias("seats"), tx.county_office(t).alias("office"))


SITES = ["https://www.facebook.com/{n}", "https://ballotpedia.org/{n}", "https://smith{n}.house.gov", "https://smithfortexas{n}.org", "https://example{n}.org", "https://example.org/{n}"]


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'social' WHEN 1 THEN 'encyclopedia' WHEN 2 THEN 'official' WHEN 3 THEN 'campaign' WHEN 4 THEN 'campaign' ELSE 'other' END AS kind FROM pages")
def site_kinds(spark, sf_dir):
    p, k = read(spark, sf_dir, "pages"), F.col("page_id") % 6
    title = F.when(k == 4, "Smith for Congress").when(k == 5, "Smith").otherwise("Home")
    return p.select("page_id", names.site_kind(filled(SITES, k, n=F.col("page_id")), title, F.array(F.lit("Ann"), F.lit(" Smith"), F.lit(None).cast("string"))).alias("kind"))


@query("SELECT page_id, list_distinct(list_transform(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'), lambda x: lower(x))).len() AS n_emails, coalesce(regexp_matches(html, '(?i)href=[\"'']https?://([a-z0-9-]+\\.)*facebook\\.com([/?#\"'']|$)'), false) AS facebook FROM pages")
def page_contacts(spark, sf_dir):
    html = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", F.size(names.emails(html)).cast("bigint").alias("n_emails"), F.coalesce(names.social_links(html)["facebook"].isNotNull(), F.lit(False)).alias("facebook"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 9 + 2025 - year(o_orderdate) WHEN 1 THEN 2025 - year(o_orderdate) WHEN 2 THEN 0 END::INT AS years FROM orders")
def years_in_office(spark, sf_dir):
    """Careers of a mandate that ended and one that goes on, of one said by its first year, of none, and null."""
    o, year, k = read(spark, sf_dir, "orders"), F.year("o_orderdate"), F.col("o_orderkey") % 4
    span = lambda a, b: F.concat_ws("-", a.cast("string"), b)
    held = lambda title, said: F.struct(F.lit(title).alias("title"), said.alias("span"))
    both = F.array(held("Candidate", span(F.lit(1950), F.lit("1959"))), held("Senator", span(year, (year + F.col("o_custkey") % 9).cast("string"))), held("Mayor", span(year, F.lit("present"))))
    career = F.when(k == 0, both).when(k == 1, F.array(held("Judge", year.cast("string")))).when(k == 2, F.array(held("Candidate", year.cast("string"))))
    return o.select("o_orderkey", names.years_in_office(career, F.lit(2025)).alias("years"))


# filters


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^Customer#0+[1-9]$')")
def slug_matches(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.filter(filters.slug_of(F.regexp_replace("c_name", "#0+", "-"), F.lit("Customer")) & (F.col("c_custkey") == F.col("c_custkey") % 10)).select("c_custkey")


@query("SELECT page_id FROM pages WHERE url NOT LIKE '%1%' AND url NOT LIKE 'http://%' AND url NOT LIKE '%test'")
def urls_left(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter(filters.none_like(F.col("url"), ["%1%", "http://%", "%test"])).select("page_id")


_FLAGS = "SELECT l_orderkey, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1"


@query(f"SELECT l_orderkey, list_has_any(f, ['R', 'X']) AS some, list_has_all(f, ['R', 'A']) AS every FROM ({_FLAGS})")
def array_predicates(spark, sf_dir):
    f = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return f.select("l_orderkey", filters.has_any(F.col("f"), ["R", "X"]).alias("some"), filters.has_all(F.col("f"), ["R", "A"]).alias("every"))


@query("SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_suppkey = 3 GROUP BY 1)")
def json_containment(spark, sf_dir):
    sponsors = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_suppkey").alias("people_id")))).alias("sponsors"))
    return sponsors.filter(filters.json_has(F.col("sponsors"), "people_id", F.lit(3))).select(F.col("l_orderkey").alias("o_orderkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def json_flags(spark, sf_dir):
    k = F.col("c_custkey")
    attributes = F.when(k % 3 == 0, '{"categorized": true}').when(k % 3 == 1, '{"categorized": "no idea"}').otherwise("{}")
    return read(spark, sf_dir, "customer").filter(~filters.json_flag(attributes, "$.categorized")).select("c_custkey")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'P')) AS some, (SELECT count(*) FROM orders) AS every, 0::BIGINT AS none")
def moderated(spark, sf_dir):
    s = F.col("o_orderstatus")
    n = lambda given: F.count(F.when(filters.one_of(s, given), 1))
    return read(spark, sf_dir, "orders").agg(n(["F", "P"]).alias("some"), n(None).alias("every"), n([]).alias("none"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')")
def role_ladder(spark, sf_dir):
    ladder = ["BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return read(spark, sf_dir, "customer").filter(filters.role_at_least(F.col("c_mktsegment"), "HOUSEHOLD", ladder)).select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#12'")
def optional_equalities(spark, sf_dir):
    return read(spark, sf_dir, "part").filter(filters.optional(p_brand="Brand#12", p_type=None)).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter(F.col("o_orderkey") == 7).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 33, 1000000007)")
def multi_key_lookup(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter(filters.one_of(F.col("o_orderkey"), [1, 2, 33, 1000000007])).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT c_mktsegment, year(o_orderdate)::INT AS year FROM customer JOIN orders ON o_custkey = c_custkey")
def distinct_years(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).distinct()
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey").select("c_mktsegment", "year").distinct()


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 10")
def page_with_total(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    total = o.agg(F.count("*").alias("total"))  # one row
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(5).select("o_orderkey").crossJoin(F.broadcast(total))


# joins and reports


@query("""SELECT r.r_name AS region, sr.r_name AS supplier_region, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN region sr ON sr.r_regionkey = sn.n_regionkey
WHERE p_size >= 10 GROUP BY 1, 2""")
def star_of_nine(spark, sf_dir):
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = read(spark, sf_dir, "customer").join(places.withColumnRenamed("r_name", "region"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "region")
    sellers = read(spark, sf_dir, "supplier").join(places.withColumnRenamed("r_name", "supplier_region"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "supplier_region")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = read(spark, sf_dir, "part").filter("p_size >= 10").select("p_partkey")
    star = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    star = star.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return star.groupBy("region", "supplier_region").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("customers"))


@query("SELECT c_custkey, x.label FROM customer c LEFT JOIN (SELECT DISTINCT s_nationkey AS n, s_suppkey % 5 AS k, 'district ' || s_nationkey || '/' || (s_suppkey % 5) AS label FROM supplier) x ON x.n = c.c_nationkey AND x.k = c.c_custkey % 5")
def crosswalk(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 5).alias("k")).distinct()
    s = s.withColumn("label", F.concat(F.lit("district "), F.col("n").cast("string"), F.lit("/"), F.col("k").cast("string")))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 5).alias("k"))
    return c.join(s, ["n", "k"], "left").select("c_custkey", "label")


@query("SELECT c_custkey, p_name FROM customer JOIN part ON ltrim(regexp_extract(c_name, '[0-9]+$'), '0') = p_partkey::VARCHAR")
def normalised_key(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", names.without_zeros(F.regexp_extract("c_name", "[0-9]+$", 0)).alias("code"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code"), "p_name")
    return c.join(p, "code").select("c_custkey", "p_name")


@query("""SELECT n_name, c_custkey, c_name, last_date, coalesce(n, 0) AS n_submissions FROM customer JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_date, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n_regionkey = 1""")
def guide_report(spark, sf_dir):
    return reporting.guide_report(
        read(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("race"), "n_name"),
        read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("race"), F.col("c_custkey").alias("candidate"), F.col("c_custkey"), "c_name"),
        read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate"), F.col("o_orderdate").alias("at")),
    ).select("n_name", "c_custkey", "c_name", F.col("last_at").alias("last_date"), "n_submissions")


@query("SELECT 99 AS guide, p_name AS prompt, p_partkey AS copied_from_id FROM part WHERE p_brand = 'Brand#11'")
def copied_questions(spark, sf_dir):
    old = read(spark, sf_dir, "part").filter("p_brand = 'Brand#11'").select(F.lit(1).alias("guide"), F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"))
    return merge.copied(old, "id", guide=F.lit(99)).select("guide", "prompt", "copied_from_id")


@query("SELECT c_custkey AS id, 'inserted' AS found FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'existing' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def inserted_or_existing(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return merge.inserted_or_existing(c.filter("id % 3 = 0"), c.filter("id % 2 = 0"), ["id"])


# search


@query("""SELECT p_partkey FROM (SELECT p_partkey, len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w IN ('red', 'rose'))) AS h, l.n FROM part
LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey) ORDER BY h / (h + 1) = 0, h / (h + 1), n DESC NULLS LAST, p_partkey LIMIT 20""")
def popular_first(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    found = read(spark, sf_dir, "part").withColumn("rank", search.rank(F.col("p_name"), ["red", "rose"])).join(n, "p_partkey", "left")
    return search.by_popularity(found, ["rank"], "n", "p_partkey").select("p_partkey")


_GRAMS = "flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2])))"
_ASKED = "cold widgets and bolts"


@query(f"""WITH s AS (SELECT p_partkey AS id, p_name AS content, p_size AS votes FROM part), q AS (SELECT {_GRAMS.format(c=f"'{_ASKED}'")} AS g),
t AS (SELECT id, votes, content, list_distinct({_GRAMS.format(c="content")}) AS a, g, list_distinct(g) AS b, len(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda w: w IN ('cold', 'widgets', 'bolts'))) AS h FROM s, q WHERE content IS NOT NULL),
e AS (SELECT id, max(hit / (len(a) + (y - x) - hit)) AS word FROM (SELECT id, a, x, y, len(list_filter(g[x + 1:y], lambda v: list_contains(a, v))) AS hit FROM t, (SELECT unnest(range(0, 40)) AS x), (SELECT unnest(range(1, 41)) AS y) WHERE x < y AND y <= len(g)) GROUP BY 1),
u AS (SELECT id, votes, content, h, word, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS alike FROM t JOIN e USING (id)),
r AS (SELECT id, (0.4 * alike + 0.4 * (h / (h + 1)) + 0.2 * (1 - word)) * (1 + ln(greatest(votes, 1))) AS score FROM u WHERE alike > 0.1 OR contains(lower(content), '{_ASKED}') OR h > 0)
SELECT id, round(score, 6) AS score FROM r WHERE score > 0.1 ORDER BY score DESC, id LIMIT 5""")
def related_statements(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), F.col("p_size").alias("votes"))
    return search.related(rows, "content", _ASKED, F.col("votes")).select("id", F.round("score", 6).alias("score"))


# elections


@query("""WITH r AS (SELECT l_orderkey AS race, l_suppkey AS candidate, CAST(sum(l_quantity) AS BIGINT) AS votes FROM lineitem GROUP BY 1, 2),
s AS (SELECT o_orderkey AS race, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN NULL ELSE 2 END AS num_elect, CASE WHEN o_orderkey % 2 = 0 THEN 'local' ELSE 'state' END AS scope FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY votes DESC NULLS LAST, candidate) AS rank FROM r JOIN s USING (race))
SELECT race, num_elect, scope, string_agg(candidate::VARCHAR, ',' ORDER BY rank) AS winners FROM k WHERE rank <= coalesce(num_elect * 2, CASE WHEN scope = 'local' THEN 2 ELSE 1 END) GROUP BY ALL""")
def primary_winners(spark, sf_dir):
    k = F.col("o_orderkey")
    races = read(spark, sf_dir, "orders").select(k.alias("race"), F.when(k % 3 == 0, 1).when(k % 3 == 2, 2).alias("num_elect"), F.when(k % 2 == 0, "local").otherwise("state").alias("scope"))
    won = candidates.primary_winners(results(spark, sf_dir), races)
    return won.withColumn("winners", F.array_join(F.transform("winners", lambda c: c.cast("string")), ","))


@query("""WITH r AS (SELECT CASE l_linenumber WHEN 1 THEN 'Mayor ' || l_orderkey || ' First Choice' WHEN 2 THEN 'Mayor ' || l_orderkey || ' Second Choice' WHEN 3 THEN 'Question ' || l_orderkey ELSE 'Clerk ' || l_orderkey END AS office, 'S' || l_suppkey AS candidate, l_quantity::BIGINT AS votes, l_partkey % 3 * 100 AS total FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY office, candidate ORDER BY votes DESC, total) AS n FROM r WHERE office NOT LIKE 'Question%')
SELECT office, candidate, 'mn-sos-' || replace(lower(office), ' ', '-') || '-' || lower(candidate) AS ref_key, votes, CASE WHEN office LIKE '%First Choice' THEN total ELSE nullif(total, 0) END AS total_votes FROM b WHERE n = 1""")
def ranked_choice(spark, sf_dir):
    n = F.col("l_linenumber")
    office = filled(["Mayor {o} First Choice", "Mayor {o} Second Choice", "Question {o}", "Clerk {o}"], F.least(n, F.lit(4)) - 1, o=F.col("l_orderkey"))
    rows = read(spark, sf_dir, "lineitem").select(office.alias("office"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("candidate"), F.col("l_quantity").cast("bigint").alias("votes"), (F.col("l_partkey") % 3 * 100).alias("total"))
    return candidates.first_choices(rows, "mn-sos")


_MERGED = """WITH c AS (SELECT l_orderkey || '-' || l_suppkey AS ref_key, l_orderkey AS race, CASE WHEN l_suppkey % 2 = 0 THEN sum(l_quantity)::BIGINT END AS votes FROM lineitem GROUP BY l_orderkey, l_suppkey),
n AS (SELECT l_orderkey || '-' || l_suppkey AS ref_key, CASE WHEN l_suppkey % 3 > 0 THEN max(l_quantity)::BIGINT END AS votes, CASE WHEN l_orderkey % 2 = 0 THEN 1000 + l_orderkey END AS total_votes FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY l_orderkey, l_suppkey UNION ALL SELECT 'none', 1, 1)"""


def _merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").cast("bigint").alias("s"), F.max("l_quantity").cast("bigint").alias("m"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("ref_key")
    known = li.select(key, F.col("l_orderkey").alias("race"), F.when(F.col("l_suppkey") % 2 == 0, F.col("s")).alias("votes"))
    new = li.filter("l_suppkey % 5 > 0").select(key, F.when(F.col("l_suppkey") % 3 > 0, F.col("m")).alias("votes"), F.when(F.col("l_orderkey") % 2 == 0, 1000 + F.col("l_orderkey")).alias("total_votes"))
    new = new.unionByName(spark.createDataFrame([("none", 1, 1)], new.schema))
    races = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("race"), F.lit(5).cast("bigint").alias("total_votes"))
    return candidates.merge_results(new, known, races)


@query(_MERGED + " SELECT ref_key, race, coalesce(n.votes, c.votes) AS votes FROM c LEFT JOIN n USING (ref_key)")
def merged_candidates(spark, sf_dir):
    return _merged(spark, sf_dir)["candidates"]


@query(_MERGED + " SELECT o_orderkey AS race, coalesce(t.total, 5) AS total_votes FROM orders LEFT JOIN (SELECT race, max(total_votes) AS total FROM c JOIN n USING (ref_key) GROUP BY 1) t ON t.race = o_orderkey")
def merged_races(spark, sf_dir):
    return _merged(spark, sf_dir)["races"]


@query(_MERGED + " SELECT (SELECT count(*) FROM n) AS n_rows, (SELECT count(*) FROM c JOIN n USING (ref_key)) AS n_matched, (SELECT count(DISTINCT race) FROM c JOIN n USING (ref_key)) AS n_races, 1::BIGINT AS n_unmatched")
def merge_report(spark, sf_dir):
    return _merged(spark, sf_dir)["stats"]


#: Suppliers as staged persons, customers as known ones: alike by nation, and by e-mail, phone or address for some.
_PEOPLE = """(SELECT {k} AS id, CASE {k} % 3 WHEN 0 THEN 'Catherine' WHEN 1 THEN 'Katherine' ELSE 'Bob' END AS first_name, CASE WHEN {k} % 4 = 0 THEN 'Q' END AS middle_name, 'M' || md5({n}::VARCHAR)[1:7] AS last_name, 'p' || {n} || '-' || {k} % 9 AS slug,
CASE WHEN {k} % 7 = 0 THEN 'm' || {k} % 50 || '@x.org' WHEN {k} % 7 = 1 THEN '' END AS email, CASE WHEN {k} % 5 = 0 THEN {k} % 40 || '' END AS phone, CASE WHEN {k} % 2 = 0 THEN {k} % 30 || ' Main St' END AS address FROM {t})"""
STAGED, KNOWN = _PEOPLE.format(k="s_suppkey", n="s_nationkey", t="supplier"), _PEOPLE.format(k="c_custkey", n="c_nationkey", t="customer")


def people(spark: SparkSession, sf_dir: str, name: str, key: str, nation: str) -> DataFrame:
    k, n = F.col(key), F.col(nation)
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return read(spark, sf_dir, name).select(
        k.alias("id"), F.when(k % 3 == 0, "Catherine").when(k % 3 == 1, "Katherine").otherwise("Bob").alias("first_name"), F.when(k % 4 == 0, "Q").alias("middle_name"), said("M", F.substring(F.md5(n.cast("string").cast("binary")), 1, 7)).alias("last_name"),
        said("p", n, "-", k % 9).alias("slug"), F.when(k % 7 == 0, said("m", k % 50, "@x.org")).when(k % 7 == 1, "").alias("email"), F.when(k % 5 == 0, said(k % 40)).alias("phone"), F.when(k % 2 == 0, said(k % 30, " Main St")).alias("address"),
    )


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return people(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), people(spark, sf_dir, "customer", "c_custkey", "c_nationkey")


_SIM = "len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))"
_PERSON = "SELECT *, lower(coalesce(first_name, '') || ' ' || coalesce(middle_name, '') || ' ' || last_name) AS name, list_distinct(" + _GRAMS.format(c="coalesce(first_name, '') || ' ' || coalesce(middle_name, '') || ' ' || last_name") + ") AS g FROM "


@query(f"""WITH a AS ({_PERSON}{STAGED}), b AS ({_PERSON}{KNOWN}),
p AS (SELECT a.id AS staged_id, b.id AS known_id, {_SIM} AS s, CASE WHEN a.email = b.email AND a.email <> '' THEN 'exact_email' WHEN a.phone = b.phone AND a.phone <> '' THEN 'exact_phone'
  WHEN lower(trim(a.address)) = lower(trim(b.address)) AND trim(a.address) <> '' THEN 'exact_address'
  WHEN lower(a.first_name) = lower(b.first_name) AND lower(a.last_name) = lower(b.last_name) AND coalesce(lower(a.middle_name), '') = coalesce(lower(b.middle_name), '') THEN 'exact_name'
  WHEN a.slug = b.slug THEN 'exact_slug' WHEN {_SIM} > 0.8 THEN 'high_similarity' WHEN {_SIM} > 0.6 THEN 'medium_similarity' END AS match_type FROM a, b)
SELECT staged_id::BIGINT AS staged_id, known_id::BIGINT AS known_id, match_type, round(s, 6) AS name_similarity FROM p WHERE match_type IS NOT NULL""")
def match_classes(spark, sf_dir):
    return candidates.matched(*_sides(spark, sf_dir))


@query(f"""WITH s AS (SELECT *, regexp_replace(slug, '-[0-9]+$', '') AS base FROM {STAGED}), k AS (SELECT *, regexp_replace(slug, '-[0-9]+$', '') AS base FROM {KNOWN}),
m AS (SELECT s.id, k.id AS known_id, k.slug, CASE WHEN s.email = k.email AND s.email <> '' THEN 'email' WHEN s.phone = k.phone AND s.phone <> '' THEN 'phone' WHEN s.address = k.address AND s.address <> '' THEN 'address' END AS matched_by FROM s JOIN k USING (base)),
i AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS n FROM s WHERE id NOT IN (SELECT id FROM m WHERE matched_by IS NOT NULL)),
t AS (SELECT base, max(regexp_extract(slug, '([0-9]+)$', 1)::INT) AS top FROM k GROUP BY 1)
SELECT id, 'update' AS action, known_id, matched_by, slug FROM m WHERE matched_by IS NOT NULL UNION ALL
SELECT id, 'insert', NULL, NULL, base || CASE n WHEN 0 THEN '' ELSE '-' || (n + coalesce(top, 0)) END FROM i LEFT JOIN t USING (base)""")
def resolved_filings(spark, sf_dir):
    return candidates.resolved(*_sides(spark, sf_dir))


@query(f"""WITH s AS (SELECT *, regexp_replace(slug, '-[0-9]+$', '') AS base FROM {STAGED}), k AS (SELECT *, regexp_replace(slug, '-[0-9]+$', '') AS base FROM {KNOWN}),
m AS (SELECT s.id, k.id AS known_id FROM s JOIN k USING (base) WHERE s.email = k.email AND s.email <> '' OR s.phone = k.phone AND s.phone <> '' OR s.address = k.address AND s.address <> ''),
c AS (SELECT known_id, min(id) AS id FROM m GROUP BY 1), f AS (SELECT s.*, k.email AS e, k.phone AS p, k.address AS a FROM c JOIN s USING (id) JOIN k ON k.id = known_id),
i AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM m))
SELECT 'updated' AS kind, count(*) AS n FROM c UNION ALL SELECT 'dupes', (SELECT count(*) FROM m) - count(*) FROM c UNION ALL SELECT 'inserted', count(*) FROM i UNION ALL SELECT 'unmatched', count(*) FROM i WHERE base IN (SELECT base FROM k) UNION ALL
SELECT 'overwritten', (count(*) FILTER (email <> '' AND e <> '' AND email <> e)) + (count(*) FILTER (phone <> '' AND p <> '' AND phone <> p)) + (count(*) FILTER (address <> '' AND a <> '' AND address <> a)) FROM f""")
def resolution_counts(spark, sf_dir):
    out = None
    for kind, rows in candidates.resolution(*_sides(spark, sf_dir)).items():
        n = F.coalesce(F.sum("further"), F.lit(0)) if kind == "dupes" else F.count("*")
        one = rows.agg(F.lit(kind).alias("kind"), n.alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey::VARCHAR AS bill FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 5 = 0")
def changed_in_a_map(spark, sf_dir):
    """Hashes that come as one JSON object a region, against those that are kept, some stale and some never set."""
    n = read(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").cast("string").alias("bill"), F.md5(F.col("n_name").cast("binary")).alias("hash"))
    maps = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("bill", "hash")))).alias("said"))
    kept = n.select("bill", F.when(F.col("bill").cast("int") % 4 == 0, "stale").when(F.col("bill").cast("int") % 5 > 0, F.col("hash")).alias("hash"))
    return merge.changed(kept, merge.entries(maps, "said", "bill", "hash"), "bill", "hash")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN abs(2025 - (1990 + k)) WHEN 1 THEN k % 7 WHEN 2 THEN 2025 - 2001 + k % 7 WHEN 3 THEN 0 END::INT AS years FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)")
def careers_as_json(spark, sf_dir):
    """Careers in one object or an array of them, by the number in an event's payload; a number alone is no career."""
    v = F.parse_json("props")
    k = F.variant_get(v, "$.k", "int").cast("string")
    e = read(spark, sf_dir, "events").select("event_id", k.alias("k"), "props")
    year, end = F.expr("1990 + int(k)").cast("string"), F.expr("2001 + int(k) % 7").cast("string")
    one = F.concat(F.lit('{"title":"Candidate","span":"'), year, F.lit('-present"}'))
    array = F.concat(F.lit('[{"title":"Candidate","span":"1950-1960"},{"title":"Mayor","span":"2001-'), end, F.lit('"}]'))
    two = F.concat(F.lit('[{"title":"Mayor","span":"2001-'), end, F.lit('"},{"title":"Judge","span":"2001"}]'))
    n = F.col("event_id") % 5
    career = F.when(n == 0, one).when(n == 1, array).when(n == 2, two).when(n == 3, F.col("k"))
    return e.select("event_id", names.career_years(career, F.lit(2025)).alias("years"))


@query("""SELECT o_orderkey AS bill_id, lower('mn' || 'hf ' || o_orderkey % 7 || '-2025') AS raw, CASE o_orderkey % 5 WHEN 1 THEN 'introduced' WHEN 2 THEN 'in_consideration' WHEN 4 THEN 'became_law' ELSE 'unknown' END AS status,
CASE WHEN o_orderkey % 3 = 0 THEN 'federal' ELSE 'state' END AS political_scope, CASE WHEN o_orderkey % 4 = 0 THEN 'house' WHEN o_orderkey % 4 = 1 THEN 'senate' END AS chamber, o_orderstatus AS last_action, o_orderdate::DATE AS last_action_date
FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0""")
def imported_bills(spark, sf_dir):
    k = F.col("o_orderkey")
    last = F.struct(F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"), F.col("o_orderstatus").alias("action"))
    first = F.struct(F.lit("01/02/1990").alias("date"), F.lit("filed").alias("action"))
    bills = read(spark, sf_dir, "orders").select(
        k.alias("bill_id"), F.when(k % 3 == 0, "US").otherwise("MN").alias("state"), F.concat(F.lit("HF "), (k % 7).cast("string")).alias("bill_number"), F.col("o_orderpriority").alias("title"), (k % 5).cast("int").alias("status"),
        F.when(k % 4 == 0, "H").when(k % 4 == 1, "S").otherwise("J").alias("body"), F.when(k % 10 == 0, F.array().cast("array<struct<date: string, action: string>>")).otherwise(F.array(first, last)).alias("history"),
    )
    known = bills.filter("bill_id % 2 = 1").select("bill_id")
    return candidates.new_bills(bills, known, 2025).select("bill_id", F.concat(F.lit("mnhf "), (F.col("bill_id") % 7).cast("string"), F.lit("-2025")).alias("raw"), "status", "political_scope", "chamber", "last_action", "last_action_date")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'new ' || c_custkey ELSE c_name END AS url, c_mktsegment AS email FROM customer")
def merged_contacts(spark, sf_dir):
    k = F.col("c_custkey")
    people = read(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("url"), F.col("c_mktsegment").alias("email"))
    scraped = read(spark, sf_dir, "customer").filter(k % 2 == 0).select(k.alias("id"), F.concat(F.lit("new "), k.cast("string")).alias("url"), F.lit(None).cast("string").alias("email"), F.when(k % 3 == 0, F.lit(1)).alias("validated_at"), F.when(k % 3 == 1, F.lit(1)).alias("merged_at"))
    return candidates.merge_contacts(people, scraped, ["url", "email"], F.lit(2))[0]


@query("SELECT 'e-' || o_orderkey AS slug FROM orders WHERE year(o_orderdate) = 1997 AND (o_orderkey % 4 = 0 OR o_orderkey % 4 = 2 AND o_custkey % 2 = 0)")
def elections_of_state(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("e-"), F.col("o_orderkey").cast("string")).alias("slug"), F.when(k == 0, "MN").when(k == 1, "TX").alias("state"), F.when((k == 2) & (F.col("o_custkey") % 2 == 1), "St. Paul").when(k == 3, "Duluth").alias("municipality"), F.to_date("o_orderdate").alias("election_date"))
    return candidates.elections_of(rows, state="MN", year=1997).select("slug")


@query("""WITH m AS (SELECT p_partkey AS i, p_partkey % 6 AS k, CASE WHEN p_partkey % 6 IN (0, 2, 3) THEN p_size % 5 END AS c FROM part WHERE p_partkey % 6 <> 5)
SELECT 'mn-2024-q' || i || coalesce('-' || c, '') AS slug, 'Q' || i || ' ' || coalesce(r_name, '') AS measure_code, r_name AS county, CASE WHEN k IN (2, 3) THEN '45' END AS municipality_fips, CASE WHEN k IN (3, 4) THEN '0625' END AS school_district,
CASE k WHEN 0 THEN 'county' WHEN 1 THEN 'state' WHEN 2 THEN 'city' ELSE 'district' END AS election_scope FROM m LEFT JOIN region ON r_regionkey = c""")
def ballot_measures(spark, sf_dir):
    k, none = F.col("p_partkey") % 6, F.lit("no data")
    rows = read(spark, sf_dir, "part").select(
        F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("number"), F.when(k == 5, none).otherwise(F.col("p_name")).alias("title"), F.when(k.isin(0, 2, 3), (F.col("p_size") % 5).cast("string")).otherwise(none).alias("county_id"),
        F.when(k.isin(2, 3), "45").otherwise(none).alias("fips"), F.when(k.isin(3, 4), "0625").otherwise(none).alias("school"),
    )
    counties = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("county_id"), F.col("r_name").alias("county"), F.concat(F.lit("270"), F.col("r_regionkey").cast("string")).alias("county_fips"))
    return candidates.measures(rows, counties, "MN", 2024).drop("title", "county_fips")


@query("""WITH p AS (SELECT c_custkey AS i, c_nationkey % 3 AS g, c_acctbal / 1000.0 AS x, (c_custkey % 7)::DOUBLE AS y FROM customer),
d AS (SELECT a.g AS ga, b.g AS gb, avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2) FILTER (a.i <> b.i) AS d FROM p a, p b GROUP BY 1, 2),
s AS (SELECT g, count(*) AS n FROM p GROUP BY 1),
r AS (SELECT ga, min(d) FILTER (ga <> gb) / max(d) FILTER (ga = gb) AS q FROM d GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS n, round(sum(q) / 3 / (1 + (SELECT sqrt(sum((n - (SELECT count(*) FROM p) / 3.0) ** 2) / 3) FROM s)), 6) AS quality FROM r""")
def group_quality(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("g"), F.array(F.col("c_acctbal") / 1000.0, (F.col("c_custkey") % 7).cast("double")).alias("v"))
    return groups.group_quality(rows, "g", "v", 3).select("n", F.round("quality", 6).alias("quality"))


@query(V + "SELECT statement, arg_max(position, n) AS position, max(n) AS n FROM (SELECT statement, position, count(*) * 10 + CASE position WHEN 'support' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END AS n FROM v GROUP BY 1, 2) GROUP BY 1")
def leading_position(spark, sf_dir):
    """Enum rank as a tie-break: of equally frequent positions support comes before neutral before oppose."""
    rank = F.when(F.col("position") == "support", 2).when(F.col("position") == "neutral", 1).otherwise(0)
    n = cast_votes(spark, sf_dir).groupBy("statement", "position").agg((F.count("*") * 10 + F.first(rank)).alias("n"))
    return n.groupBy("statement").agg(F.max_by("position", "n").alias("position"), F.max("n").alias("n"))
