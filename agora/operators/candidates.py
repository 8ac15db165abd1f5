"""Candidates, races and bills: winners, results with ranked choice, matching of new persons with known ones, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import overlap, slugify, trigrams
from agora.operators.merge import numbered_slugs, unmatched, upsert
from agora.operators.search import fuzzy_pairs
from agora.operators.storage import components, cut, met


def primary_winners(results: DataFrame, races: DataFrame) -> DataFrame:
    """Who goes on from each race: race, num_elect, scope and the winners' array by rank.

    ``results``: race, candidate, votes; ``races``: race, num_elect, scope. Twice ``num_elect`` go on; without that
    number two of a local race, else one. Ties go to the smaller candidate, null votes last.
    """
    rank = F.row_number().over(Window.partitionBy("race").orderBy(F.desc_nulls_last("votes"), "candidate"))
    most = F.coalesce(F.col("num_elect") * 2, F.when(F.col("scope") == "local", 2).otherwise(1))
    through = results.withColumn("rank", rank).join(races, "race").filter(F.col("rank") <= most)
    held = F.array_sort(F.collect_list(F.struct("rank", "candidate")))
    return through.groupBy("race", "num_elect", "scope").agg(held.alias("_w")).select("race", "num_elect", "scope", F.transform("_w", lambda w: w["candidate"]).alias("winners"))


def first_choices(rows: DataFrame, prefix: str) -> DataFrame:
    """Results with ranked choice, one row per office and candidate: office, candidate, ref_key, votes, total_votes.

    ``rows``: office, candidate, votes, total. The first choice's row comes before second, third and other ones. A total
    of 0 is none, unless it is of first choices. Rows on questions are left out. Ties by votes.
    """
    low = F.lower("office")
    choice = F.when(F.col("office").contains("First Choice"), 1).when(F.col("office").contains("Second Choice"), 2).when(F.col("office").contains("Third Choice"), 3).otherwise(4)
    first = low.contains("first choice")
    best = rows.filter(~low.contains("question")).groupBy("office", "candidate").agg(F.min(F.struct(choice.alias("c"), (-F.col("votes")).alias("v"), "votes", "total")).alias("b"))
    total = F.when(first, F.col("b.total")).otherwise(F.nullif(F.col("b.total"), F.lit(0)))
    return best.select("office", "candidate", slugify(F.concat_ws("-", F.lit(prefix), "office", "candidate")).alias("ref_key"), F.col("b.votes").alias("votes"), total.alias("total_votes"))


def merge_results(source: DataFrame, candidates: DataFrame, races: DataFrame) -> dict[str, DataFrame]:
    """A source's results merged into what is known: ``candidates`` and ``races`` anew, ``unmatched`` and ``stats``.

    ``source``: ref_key, votes, total_votes; ``candidates``: ref_key, race, votes; ``races``: race, total_votes. Several
    rows of a key or race: the greatest votes, the greatest total. A null keeps what is known.
    """
    new = source.groupBy("ref_key").agg(F.max("votes").alias("votes"), F.max("total_votes").alias("total_votes"))
    met = candidates.select("ref_key", "race").join(new, "ref_key")
    after = upsert(candidates, met.select("ref_key", "votes"), ["ref_key"])
    totals = upsert(races, met.groupBy("race").agg(F.max("total_votes").alias("total_votes")), ["race"])
    missing = unmatched(new, candidates, ["ref_key"])
    stats = new.agg(F.count("*").alias("n_rows")).crossJoin(met.agg(F.count("*").alias("n_matched"), F.countDistinct("race").alias("n_races")))  # one row each
    return {"candidates": after, "races": totals, "unmatched": missing, "stats": stats.withColumn("n_unmatched", F.col("n_rows") - F.col("n_matched"))}


#: Kinds of matches, the surest first.
MATCHES = ("exact_email", "exact_phone", "exact_address", "exact_name", "exact_slug", "high_similarity", "medium_similarity")


def match_rank(kind: Column) -> Column:
    """A kind's place in ``MATCHES``, from 1; unknown kinds come last."""
    place = F.array_position(F.array(*map(F.lit, MATCHES)), kind)
    return F.when(place > 0, place).otherwise(len(MATCHES) + 1).cast("int")


def described() -> tuple[Column, dict[str, Column]]:
    """A person's whole name, which similarity looks at, and the values that two persons are the same by, in the order of ``MATCHES``."""
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    name = F.concat(F.lower(F.coalesce("first_name", F.lit(""))), F.lit(" "), F.lower(F.coalesce("middle_name", F.lit(""))), F.lit(" "), F.lower("last_name"))
    whole = F.when(F.col("first_name").isNotNull() & F.col("last_name").isNotNull(), F.to_json(F.array(F.lower("first_name"), part("middle_name"), F.lower("last_name"))))
    facets = {"email": F.col("email"), "phone": F.col("phone"), "address": part("address"), "name": whole, "slug": F.col("slug")}
    return name, facets


def classified(staged: DataFrame, known: DataFrame) -> DataFrame:
    """Which staged and known persons may be one, by classes: relation, id, other, match_type, name_similarity, (facet)_class.

    Both: id, first_name, middle_name, last_name, slug, email, phone, address. Empty values match nothing. Persons of one class
    are not held against each other one by one: each person has a row (``staged`` or ``known``) with the classes it is in, the least
    known id with the same e-mail, phone, address, name and slug, and as ``alike_class`` the least id of its own side with
    the same whole name. Names of different classes that are alike are rows ``alike``: least staged id, least known id,
    match_type and similarity. A pair's match is the first of ``MATCHES`` by which its classes are the same or alike. Similar
    names come from shared trigrams.
    """
    name, facets = described()
    keys = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in facets.items())), lambda k: k["value"] != "")
    classes = known.select("id", F.explode(keys).alias("k")).groupBy("k").agg(F.min("id").alias("_class"))
    texts = [f.select("id", name.alias("name")).filter("name is not null").groupBy("name").agg(F.min("id").alias("alike_class")) for f in (staged, known)]

    def members(f: DataFrame, relation: str, own: DataFrame) -> DataFrame:
        of = f.select("id", F.explode(keys).alias("k")).join(classes, "k").groupBy("id").agg(*(F.min(F.when(F.col("k.kind") == k, F.col("_class"))).alias(f"{k}_class") for k in facets))
        return f.select(F.lit(relation).alias("relation"), "id", name.alias("name")).join(of, "id", "left").join(own, "name", "left").drop("name")

    alike = fuzzy_pairs(texts[0], texts[1], "name", "name", 0.6).join(texts[0].toDF("left_text", "id"), "left_text").join(texts[1].toDF("right_text", "other"), "right_text")
    kind = F.when(F.col("similarity") > 0.8, MATCHES[5]).otherwise(MATCHES[6])
    pairs = alike.select(F.lit("alike").alias("relation"), "id", "other", kind.alias("match_type"), F.round("similarity", 6).alias("name_similarity"))
    people = members(staged, "staged", texts[0]).unionByName(members(known, "known", texts[1]))
    return people.unionByName(pairs, allowMissingColumns=True).select("relation", "id", "other", "match_type", "name_similarity", *(f"{k}_class" for k in (*facets, "alike")))


def matched(staged: DataFrame, known: DataFrame) -> DataFrame:
    """Every pair of a staged and a known person that may be one: staged_id, known_id, match_type, name_similarity.

    Both as in ``classified``. A pair is made where the first of its values is the same, or else where its names are alike, so pairs need
    not be made distinct.
    """
    name, facets = described()
    side = lambda f, p: f.select(F.col("id").alias(f"{p}_id"), F.coalesce(name, F.lit("")).alias(f"{p}_text"), *(F.nullif(v, F.lit("")).alias(f"{p}_{k}") for k, v in facets.items()))
    a, b = side(staged, "staged"), side(known, "known")
    same = lambda c: F.coalesce(F.col(f"staged_{c}") == F.col(f"known_{c}"), F.lit(False))
    out = None
    for i, c in enumerate(facets):
        left, right = (f.withColumn("_v", F.col(f"{p}_{c}")).filter("_v is not null") for f, p in ((a, "staged"), (b, "known")))
        # names are held against each other once a value, then their persons are paired
        texts = [f.select("_v", f"{p}_text").distinct().withColumn(f"_{p}", trigrams(F.col(f"{p}_text"))) for f, p in ((left, "staged"), (right, "known"))]
        alike = F.when((F.col("staged_text") != "") & (F.col("known_text") != ""), F.round(overlap(F.col("_staged"), F.col("_known")), 6))
        names = met(*texts, ["_v"], ["known_text"]).select("_v", "staged_text", "known_text", F.lit(MATCHES[i]).alias("match_type"), alike.alias("name_similarity"))
        found = met(right, left.join(names, ["_v", "staged_text"]), ["_v", "known_text"], ["staged_id"])
        for earlier in list(facets)[:i]:
            found = found.filter(~same(earlier))
        found = found.select("staged_id", "known_id", "match_type", "name_similarity")
        out = found if out is None else out.unionByName(found)
    near = fuzzy_pairs(a, b, "staged_text", "known_text", 0.6).toDF("staged_text", "known_text", "s")
    near = near.select("staged_text", "known_text", F.when(F.col("s") > 0.8, MATCHES[5]).otherwise(MATCHES[6]).alias("match_type"), F.round("s", 6).alias("name_similarity"))
    found = met(b, a.join(near, "staged_text"), ["known_text"], ["staged_id"])
    for c in facets:
        found = found.filter(~same(c))
    return out.unionByName(found.select("staged_id", "known_id", "match_type", "name_similarity"))


def links(rows: DataFrame, others: DataFrame, fields: tuple[str, ...] = ("email", "phone", "address")) -> DataFrame:
    """Per id of ``rows`` that any of ``others`` matches: n_(field), how many match by that field and none before it; (field)_class,
    the least of those with its value; ``first``, the least of all. Both: id, slug and ``fields``; a match has the same slug but
    for a number at its end, and a field that is the same and not blank.

    No pairs are made: rows with the same values of some fields are counted together, and what was counted twice is taken
    off again, so there are seven rows a person for three fields.
    """
    sets = range(1, 1 << len(fields))
    has = lambda m: [c for i, c in enumerate(fields) if m >> i & 1]
    base = F.regexp_replace("slug", "-[0-9]+$", "")

    def key(m: int) -> Column:
        said = base.isNotNull()
        for c in has(m):
            said = said & (F.col(c) != "")
        return F.when(said, F.struct(F.lit(m).alias("m"), base.alias("base"), *(F.when(F.lit(c in has(m)), F.col(c)).alias(c) for c in fields)))

    keys = F.explode(F.array_compact(F.array(*map(key, sets)))).alias("k")
    counted = others.select("id", keys).groupBy("k").agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    n = lambda i: F.sum(F.col("_n") * F.element_at(F.create_map(*(F.lit(x) for m in sets for x in (m, (-1) ** (len(has(m)) - 1) if m >> i == 1 else 0))), F.col("k.m")))
    return rows.select("id", keys).join(counted, "k").groupBy("id").agg(
        F.min("_first").alias("first"), *(n(i).alias(f"n_{c}") for i, c in enumerate(fields)), *(F.min(F.when(F.col("k.m") == 1 << i, F.col("_first"))).alias(f"{c}_class") for i, c in enumerate(fields))
    )


def resolve(staged: DataFrame, known: DataFrame, fields: tuple[str, ...] = ("email", "phone", "address")) -> DataFrame:
    """What becomes of each person, a row each: side (staged or known), id, action, slug, n_(field), (field)_class.

    Both: id, slug and ``fields``; known persons are candidates for a staged one as in ``links``, and every matching one is updated.
    A staged person updates the known ones or is inserted under a free slug; a known one is updated or kept. Classes are the
    least known ids with the same slug and value: a staged person matches the known ones of its email's class by e-mail,
    else those of its phone's by phone, and so on; n_(field) are the numbers of these matches.
    """
    classes = [f"{c}_class" for c in fields]
    met, hit, own = links(staged, known, fields), links(known, staged, fields), links(known, known, fields).select("id", *classes)
    new = staged.join(met, "id", "left_anti").select("id", F.regexp_replace("slug", "-[0-9]+$", "").alias("_base"))
    slugs = numbered_slugs(new, "_base", "id", known.select("slug")).select("id", "slug")
    mine = staged.select("id").join(met, "id", "left").join(slugs, "id", "left")
    theirs = known.select("id", "slug").join(hit.drop(*classes), "id", "left").join(own, "id", "left")
    tell = lambda f, side, yes, no: f.select(F.lit(side).alias("side"), "id", F.when(F.col("first").isNull(), no).otherwise(yes).alias("action"), "slug", *(F.coalesce(f"n_{c}", F.lit(0)).cast("bigint").alias(f"n_{c}") for c in fields), *classes)
    return tell(mine, "staged", "update", "insert").unionByName(tell(theirs, "known", "updated", "kept"))


def resolved(staged: DataFrame, known: DataFrame, fields: tuple[str, ...] = ("email", "phone", "address")) -> DataFrame:
    """What becomes of each staged person: id, action (update or insert), known_id, matched_by, slug.

    Both: id, slug and ``fields``; known persons are candidates for a staged one as in ``links``. Every matching one is updated, a row
    each, by the first field that is the same. Without any the person is inserted under a free slug.
    """
    base = F.regexp_replace("slug", "-[0-9]+$", "")
    side = lambda f, p: f.select(base.alias("_base"), *(F.col(c).alias(f"{p}_{c}") for c in ("id", "slug")), *(F.nullif(c, F.lit("")).alias(f"{p}_{c}") for c in fields))
    a, b = side(staged, "s"), side(known, "k")
    out = None
    for i, c in enumerate(fields):
        at = lambda f, p: f.withColumn("_v", F.col(f"{p}_{c}")).filter("_base is not null and _v is not null")  # noqa: E731, B023
        found = met(at(a, "s"), at(b, "k"), ["_base", "_v"], ["k_id"])
        for before in fields[:i]:
            found = found.filter(~F.coalesce(F.col(f"s_{before}") == F.col(f"k_{before}"), F.lit(False)))
        one = found.select(F.col("s_id").alias("id"), F.lit("update").alias("action"), F.col("k_id").alias("known_id"), F.lit(c).alias("matched_by"), F.col("k_slug").alias("slug"))
        out = one if out is None else out.unionByName(one)
    new = staged.join(links(staged, known, fields), "id", "left_anti").select("id", base.alias("_base"))
    inserts = numbered_slugs(new, "_base", "id", known.select("slug"))
    return out.unionByName(inserts.select("id", F.lit("insert").alias("action"), F.lit(None).cast(known.schema["id"].dataType).alias("known_id"), F.lit(None).cast("string").alias("matched_by"), "slug"))


def resolution(staged: DataFrame, known: DataFrame, fields: tuple[str, ...] = ("email", "phone", "address")) -> dict[str, DataFrame]:
    """All outputs of a resolution: ``updated``, the known rows with the staged values that are not
    blank; ``overwritten``, known_id, field, before and after of values that were another; ``inserted``, staged rows with
    their slugs; ``dupes``, known_id, the staged id that counts (the least) and how many further ones match; ``unmatched``, inserted ones with namesakes."""
    hit = cut(links(known, staged, fields))
    base = F.regexp_replace("slug", "-[0-9]+$", "")
    new = cut(staged.join(links(staged, known, fields), "id", "left_anti"))
    slugs = numbered_slugs(new.select("id", base.alias("_base")), "_base", "id", known.select("slug")).select("id", "slug")
    chosen = hit.select(F.col("id").alias("known_id"), F.col("first").alias("id"))
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    told = chosen.join(staged.select("id", F.struct(*(said(F.col(c)).alias(c) for c in fields)).alias("_n")), "id").select(F.col("known_id").alias("id"), "_n")
    both = known.join(told, "id")
    inserted = new.drop("slug").join(slugs, "id")
    change = F.array(*(F.struct(F.lit(c).alias("field"), said(F.col(c)).alias("before"), F.col(f"_n.{c}").alias("after")) for c in fields))
    further = sum((F.col(f"n_{c}") for c in fields[1:]), F.col(f"n_{fields[0]}")) - 1
    return {
        "updated": both.select(*(F.coalesce(F.col(f"_n.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in known.columns)),
        "overwritten": both.select(F.col("id").alias("known_id"), F.explode(change).alias("c")).select("known_id", "c.*").filter("before <> after"),
        "inserted": inserted,
        "dupes": hit.select(F.col("id").alias("known_id"), F.col("first").alias("id"), further.alias("further")).filter("further > 0"),
        "unmatched": inserted.withColumn("_base", base).join(known.select(base.alias("_base")).distinct(), "_base", "left_semi").drop("_base"),
    }


def same_persons(filings: DataFrame) -> DataFrame:
    """Filings with the slug of the person they are of: those of one base that share an e-mail or an address, straight or
    through others, are one person's. ``filings``: id, base, email, address; blank ones are none, case and blanks around
    don't count. Persons of a base are numbered by their least filing; ``repeated``: it isn't this one, ``first_id``."""
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = filings.withColumns({"_email": plain("email"), "_address": plain("address")})
    alike = [rows.filter(F.col(c).isNotNull()).groupBy("base", c).agg(F.min("id").alias("b")).join(rows, ["base", c]).select(F.col("id").alias("a"), "b") for c in ("_email", "_address")]
    edges = alike[0].union(alike[1]).union(rows.select(F.col("id").alias("a"), F.col("id").alias("b")))
    of = components(edges).withColumnRenamed("component", "first_id")
    persons = numbered_slugs(filings.join(of.select(F.col("first_id").alias("id")).distinct(), "id").select("base", F.col("id").alias("first_id")), "base", "first_id")
    return of.join(persons.select("first_id", "slug"), "first_id").select("id", "slug", "first_id", (F.col("id") != F.col("first_id")).alias("repeated"))


def bill_status(code: Column) -> Column:
    return F.when(code == 1, "introduced").when(code == 2, "in_consideration").when(code == 4, "became_law").otherwise("unknown")


def new_bills(bills: DataFrame, known: DataFrame, year: int) -> DataFrame:
    """Bills that aren't known yet and have a history, as they are stored.

    ``bills``: bill_id, state, bill_number, title, status, body, history (array of struct date, action); ``known``: bill_id.
    """
    last = F.element_at("history", -1)
    there = bills.join(known.select("bill_id").distinct(), "bill_id", "left_anti").filter(F.size("history") > 0)
    return there.select(
        "bill_id", slugify(F.concat("state", "bill_number", F.lit(f"-{year}"))).alias("slug"), "title", bill_status(F.col("status")).alias("status"),
        F.when(F.col("state") == "US", "federal").otherwise("state").alias("political_scope"), F.when(F.col("body") == "H", "house").when(F.col("body") == "S", "senate").alias("chamber"),
        last["action"].alias("last_action"), F.to_date(last["date"], "M/d/y").alias("last_action_date"),
    )


def merge_contacts(people: DataFrame, scraped: DataFrame, fields: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """Scraped contacts that are validated and not merged yet go into ``people`` (id and ``fields``); both tables anew.

    ``scraped``: id, validated_at, merged_at and ``fields``. A null keeps what is known; of several rows the latest validated.
    """
    ready = F.col("validated_at").isNotNull() & F.col("merged_at").isNull()
    latest = scraped.filter(ready).groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("validated_at", *fields)).alias("_w")).select("id", "_w.*")
    after = people.join(latest.select("id", F.struct(*fields).alias("_w")), "id", "left")
    after = after.select(*(F.coalesce(F.col(f"_w.{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in people.columns))
    return after, scraped.withColumn("merged_at", F.when(ready, now).otherwise(F.col("merged_at")))


def elections_of(elections: DataFrame, *, state: str | None = None, year: int | None = None, query: Column | None = None) -> DataFrame:
    """Elections of a state, and national ones always: those of no state and no municipality; by date."""
    test = F.lit(True) if state is None else (F.col("state") == state) | (F.col("state").isNull() & F.col("municipality").isNull())
    test = test & (F.lit(True) if year is None else F.year("election_date") == year) & (F.lit(True) if query is None else query)
    return elections.filter(test).orderBy("election_date", "slug")


def measures(rows: DataFrame, counties: DataFrame, state: str, year: int, nothing: str = "no data") -> DataFrame:
    """Ballot measures as they are stored. ``rows``: number, title, county_id, fips, school; ``counties``: county_id, county, county_fips.

    Rows without a number or title are left out. A measure is as wide as its codes say: none the state, a county alone the
    county, a county and a municipality the city, all else a district.
    """
    said = lambda c: F.nullif(F.col(c), F.lit(nothing))
    good = (F.col("number") != "") & (F.col("title") != "") & (F.col("title") != nothing)
    slug = slugify(F.concat(F.lit(f"{state.lower()}-{year}-"), F.lower("number"), F.coalesce(F.concat(F.lit("-"), F.lower(said("county_id"))), F.lit(""))))
    have = [F.col(c).isNotNull() for c in ("county_fips", "municipality_fips", "school_district")]
    scope = F.when(~have[0] & ~have[1] & ~have[2], "state").when(have[0] & ~have[1] & ~have[2], "county").when(have[0] & have[1] & ~have[2], "city").otherwise("district")
    out = rows.filter(good).join(F.broadcast(counties), "county_id", "left").withColumns({"slug": slug, "municipality_fips": said("fips"), "school_district": said("school")})
    code = F.concat("number", F.lit(" "), F.coalesce("county", F.lit("")))
    return out.select("slug", "title", code.alias("measure_code"), "county", "county_fips", "municipality_fips", "school_district", scope.alias("election_scope"))
