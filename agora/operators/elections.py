"""Results of contests: shares, ranks, winners, runoffs, ballots, and which contests a place has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import leading_int, percent


def shares(results: DataFrame, race: str, votes: str) -> DataFrame:
    """Each row with its race's total and its share in percent (one decimal, half up)."""
    total = F.sum(votes).over(Window.partitionBy(race))
    return results.withColumn("total_votes", total).withColumn("vote_percent", percent(F.col(votes), F.col("total_votes")))


def recovered_totals(results: DataFrame, race: str, votes: str, stated: str) -> DataFrame:
    """A race's total: the stated one if there is any, else the sum of its rows."""
    of = results.groupBy(race).agg(F.max(stated).alias("_stated"), F.sum(votes).alias("_sum"))
    return of.select(race, F.coalesce("_stated", "_sum").alias("total_votes"))


def ranked(results: DataFrame, race: str, votes: str, tie: str) -> DataFrame:
    """Rank in the race by votes (nulls last, ties by id) and the number of candidates."""
    w = Window.partitionBy(race)
    return results.withColumn("rank", F.row_number().over(w.orderBy(F.col(votes).desc_nulls_last(), F.col(tie)))).withColumn("n_candidates", F.count("*").over(w))


def leaders(results: DataFrame, race: str, votes: str, tie: str, seats: Column | int = 2) -> DataFrame:
    """The first ``seats`` of each race; a column makes that number the race's own (null: 1)."""
    seats = F.coalesce(seats, F.lit(1)) if isinstance(seats, Column) else F.lit(seats)
    return ranked(results, race, votes, tie).filter(F.col("rank") <= seats)


def winners(results: DataFrame, race: str, votes: str, tie: str, seats: int = 2) -> DataFrame:
    """Per race the ids of its first ``seats``, in order."""
    top = leaders(results, race, votes, tie, seats).groupBy(race).agg(F.sort_array(F.collect_list(F.struct("rank", tie))).alias("_t"))
    return top.select(race, F.transform("_t", lambda s: s[tie]).alias("winner_ids"))


def runoffs(results: DataFrame, race: str, votes: str, tie: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """Races of ``least`` candidates or more in which nobody has ``share`` of the votes: race, n_candidates, best_share."""
    of = results.groupBy(race).agg(F.countDistinct(tie).alias("n_candidates"), F.max(votes).alias("_m"), F.sum(votes).alias("_s"))
    of = of.withColumn("best_share", F.col("_m") / F.nullif(F.col("_s"), F.lit(0)))
    return of.filter((F.col("n_candidates") >= least) & (F.col("best_share") < share)).select(race, "n_candidates", F.round("best_share", 6).alias("best_share"))


def post_primary(races: DataFrame, results: DataFrame, race: str, votes: str, tie: str, reported: Column, seats: Column | None = None) -> DataFrame:
    """After a primary, per fully reported race and candidate: advances to the general election, goes to a runoff, or neither."""
    final = races.filter(reported)
    seats = F.lit(1) if seats is None else F.coalesce(seats, F.lit(1))
    r = ranked(results.join(final.select(race, seats.alias("_seats")), race), race, votes, tie)
    w = Window.partitionBy(race)
    open_race = (F.col("n_candidates") > 2) & (F.max(votes).over(w) < 0.5 * F.sum(votes).over(w))
    r = r.withColumn("_open", F.coalesce(open_race, F.lit(False)))
    outcome = F.when(F.col("_open") & (F.col("rank") <= 2), "runoff").when(~F.col("_open") & (F.col("rank") <= F.col("_seats")), "general")
    return r.withColumn("outcome", outcome).filter("outcome is not null").select(race, tie, "rank", "outcome")


def general_title(title: Column) -> Column:
    """A primary's title as that of the general race, its party left out."""
    said = F.trim(title)
    for old, new in ((" Primary", " General"), (" Democratic -", ""), (" Republican -", "")):
        said = F.replace(said, F.lit(old), F.lit(new))
    return said


def general_slug(slug: Column) -> Column:
    """A primary's slug as that of the general race, its party left out; primaries of both parties have the same."""
    first = F.regexp_replace(slug, "(?is)^(.*?)-primary", "$1-general")
    return F.rtrim(F.regexp_replace(F.regexp_replace(first, "(?i)-democratic-", "-"), "(?i)-republican-", "-"), F.lit("- "))


def after_primary(races: DataFrame, entries: DataFrame, kept: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a primary leads to: ``runoff_races``, ``runoff_candidates``, ``general_races``, ``general_candidates``, ``winners``.

    ``races``: race_id, title, slug, office_id, party, num_elect, winner_ids, reporting, precincts, total_votes;
    ``entries``: race_id, candidate_id, votes; ``kept``: slugs of races that are there already and aren't made again.
    A fully reported race of more than two candidates whose best has under half of its votes goes to a runoff of two. Each
    primary has a general race, both parties' the same one, for which the first race_id stands. To it go the winners that
    are set, else as many as are elected; races that go to a runoff and those that aren't counted send nobody yet. Ties
    go to the lesser candidate_id.
    """
    whole = F.coalesce(F.col("reporting") == F.col("precincts"), F.lit(False))
    known = races.select("slug").limit(0) if kept is None else kept.select("slug").distinct()
    order = F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc_nulls_last("votes"), "candidate_id"))
    placed = entries.withColumn("place", order)
    share = F.max(F.when(F.col("votes") > 0, F.col("votes") / F.nullif(F.col("total_votes"), F.lit(0))))
    counted = placed.join(races.filter(whole).select("race_id", "total_votes"), "race_id").groupBy("race_id").agg(share.alias("best"), F.count_distinct("candidate_id").alias("n"))
    runoff = counted.filter((F.col("best") < 0.5) & (F.col("n") > 2)).select("race_id")
    runoff_slug, party = F.concat(F.rtrim(F.col("slug"), F.lit("- ")), F.lit("-runoff")), [c for c in ("office_id", "party") if c in races.columns]
    runoffs = races.join(runoff, "race_id").select(F.col("race_id").alias("source_race_id"), runoff_slug.alias("slug"), F.concat(F.trim("title"), F.lit(" - Runoff")).alias("title"), *party)
    two = placed.filter((F.col("place") <= 2) & (F.col("votes") > 0))
    to_runoff = runoffs.select(F.col("source_race_id").alias("race_id"), "slug").join(two, "race_id").select("slug", "candidate_id").distinct()

    own = races.select("race_id", general_title(F.col("title")).alias("title"), general_slug(F.col("slug")).alias("slug"), *party[:1], "num_elect")
    first = own.groupBy("slug").agg(F.min(F.struct("race_id", *(c for c in own.columns if c not in ("race_id", "slug")))).alias("r"))
    generals = first.join(known, "slug", "left_anti").select("slug", F.col("r.race_id").alias("source_race_id"), *(F.col(f"r.{c}").alias(c) for c in own.columns if c not in ("race_id", "slug")))
    through = races.filter(whole & F.col("total_votes").isNotNull()).join(runoff, "race_id", "left_anti")
    given = through.filter(F.size(F.coalesce("winner_ids", F.array().cast(races.schema["winner_ids"].dataType))) > 0).select("race_id", F.posexplode("winner_ids").alias("place", "candidate_id"))
    chosen = placed.join(through.join(given.select("race_id").distinct(), "race_id", "left_anti").select("race_id", F.coalesce("num_elect", F.lit(1)).alias("_n")), "race_id").filter(F.col("place") <= F.col("_n"))
    advancing = given.unionByName(chosen.select("race_id", "place", "candidate_id"))
    winners = two.join(runoff, "race_id").select("race_id", "place", "candidate_id").unionByName(chosen.select("race_id", "place", "candidate_id"))
    return {
        "runoff_races": runoffs.join(known, "slug", "left_anti"),
        "runoff_candidates": to_runoff,
        "general_races": generals,
        "general_candidates": own.select("race_id", "slug").join(advancing, "race_id").select("slug", "candidate_id").distinct(),
        "winners": winners.groupBy("race_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate_id"))), lambda w: w["candidate_id"]).alias("winner_ids")),
    }


def wins_and_losses(races: DataFrame, entries: DataFrame, race: str, who: str, winner_ids: str = "winner_ids") -> DataFrame:
    """Per candidate: decided races won and lost; races without winners count for neither."""
    decided = races.filter(F.size(F.coalesce(F.col(winner_ids), F.array().cast("array<bigint>"))) > 0)
    both = entries.select(race, who).distinct().join(decided, race).withColumn("_won", F.array_contains(winner_ids, F.col(who)))
    return both.groupBy(who).agg(F.count(F.when(F.col("_won"), 1)).alias("wins"), F.count(F.when(~F.col("_won"), 1)).alias("losses"))


def ballot_order(priority: Column, district: Column, seat: Column, title: Column, id: Column) -> list[Column]:
    """Sort keys of a ballot: priority, district and seat in natural order, title backwards."""
    blank = F.lit("")
    return [priority.asc_nulls_last(), leading_int(district).asc_nulls_last(), F.coalesce(district, blank).asc(), leading_int(seat).asc_nulls_last(), F.coalesce(seat, blank).asc(), title.desc_nulls_last(), id.asc()]


def nearest(rows: DataFrame, key: str, date: str, as_of: Column, tie: str) -> DataFrame:
    """Per key the row whose date is nearest: those to come first."""
    past = F.when(F.to_date(date) >= as_of, 0).otherwise(1)
    w = Window.partitionBy(key).orderBy(past, F.abs(F.datediff(F.to_date(date), as_of)), tie)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def races_for_places(places: DataFrame, races: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Races that a place votes in. ``kinds``: a race's scope -> the columns of ``places`` that make its key.

    Every place is spread to its few jurisdictions, and those meet races by equality: no join on a tree of ORs. Races
    have ``scope`` and ``key`` (parts joined by a bar).
    """
    keys = [F.struct(F.lit(scope).alias("scope"), F.when(F.concat(F.lit(""), *(F.col(c).cast("string") for c in cols)).isNotNull(), F.concat_ws("|", *(F.col(c).cast("string") for c in cols))).alias("key")) for scope, cols in kinds.items()]
    spread = places.withColumn("_j", F.explode(F.array(*keys))).filter("_j.key is not null").select("*", "_j.scope", "_j.key").drop("_j")
    return spread.join(races, ["scope", "key"])


def measures_for_place(measures: DataFrame, place: dict[str, object]) -> DataFrame:
    """Measures whose every location column is null or the place's."""
    test = F.lit(True)
    for column, value in place.items():
        test = test & (F.col(column).isNull() | F.col(column).eqNullSafe(F.lit(value)))
    return measures.filter(test)
