"""Vote analytics on any table of votes: tallies, orders, participation, consensus and division."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VoteCols:
    """Names of the columns that the operators read, and the values of a position."""

    unit: str = "statement"
    group: str = "conversation"
    participant: str = "user_id"
    session: str = "session_id"
    position: str = "position"
    ts: str = "ts"
    order: str = "event_id"
    values: tuple[str, str, str] = ("support", "neutral", "oppose")


def _count(test: Column, name: str) -> Column:
    return F.count(F.when(test, 1)).alias(name)


def tally(votes: DataFrame, c: VoteCols = VoteCols(), units: DataFrame | None = None) -> DataFrame:
    """Votes per unit in all and of each kind; units of ``units`` without votes count 0. Votes are summed before the join."""
    support, neutral, oppose = c.values
    p = F.col(c.position)
    out = votes.groupBy(c.unit).agg(F.count("*").alias("n_votes"), _count(p == support, "n_support"), _count(p == neutral, "n_neutral"), _count(p == oppose, "n_oppose"))
    if units is None:
        return out
    return units.select(c.unit).distinct().join(out, c.unit, "left").fillna(0, ["n_votes", "n_support", "n_neutral", "n_oppose"])


def latest(votes: DataFrame, c: VoteCols = VoteCols()) -> DataFrame:
    """Each participant's last vote on a unit (ties: the greatest ``order``), as an aggregate without a sort."""
    rest = [x for x in votes.columns if x not in (c.unit, c.participant)]
    last = F.max_by(F.struct(*rest), F.struct(c.ts, c.order)).alias("_v")
    return votes.groupBy(c.unit, c.participant).agg(last).select(c.unit, c.participant, "_v.*").select(*votes.columns)


def ordered(tallies: DataFrame, mode: str, unit: str = "statement", compat: bool = False) -> list[Column]:
    """Sort keys: newest, most_votes, most_agree or controversial (support x oppose over all squared; compat: oppose squared)."""
    a = F.col("n_oppose") if compat else F.col("n_support")
    heat = a * F.col("n_oppose") / F.nullif(F.col("n_votes") * F.col("n_votes"), F.lit(0))
    key = {"newest": F.col("created_at") if "created_at" in tallies.columns else F.col(unit), "most_votes": F.col("n_votes"), "most_agree": F.col("n_support"), "controversial": heat}[mode]
    return [key.desc_nulls_first() if compat else key.desc_nulls_last(), F.col(unit).asc()]


def controversy(tallies: DataFrame) -> DataFrame:
    heat = F.col("n_support") * F.col("n_oppose") / F.nullif(F.col("n_votes") * F.col("n_votes"), F.lit(0))
    return tallies.withColumn("controversy", F.round(heat, 6))


def public_votes(votes: DataFrame, c: VoteCols = VoteCols(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of each position; null, not 0, over no rows."""
    sums = [F.sum(F.when(F.col(c.position) == v, 1).otherwise(0)).alias(v) for v in c.values]
    return votes.groupBy(*keys).agg(*sums)


def statistics(votes: DataFrame, c: VoteCols = VoteCols()) -> DataFrame:
    """Per group: participants (user, else session), votes, units with votes, votes per participant (0 without any)."""
    who = F.coalesce(F.col(c.participant).cast("string"), F.col(c.session).cast("string")) if c.session in votes.columns else F.col(c.participant)
    out = votes.groupBy(c.group).agg(F.countDistinct(who).alias("participants"), F.count("*").alias("votes"), F.countDistinct(c.unit).alias("statements"))
    return out.withColumn("avg_votes", F.when(F.col("participants") > 0, F.round(F.col("votes") / F.col("participants"), 6)).otherwise(0.0))


def distribution(votes: DataFrame, bucket: int, c: VoteCols = VoteCols()) -> DataFrame:
    """How many participants cast how many votes, in buckets of ``bucket``, with shares of all; null participants are one."""
    per = votes.groupBy(c.participant).agg(F.count("*").alias("n"))
    out = per.groupBy(F.expr(f"n div {int(bucket)} * {int(bucket)}").alias("bucket")).agg(F.count("*").alias("participants"))
    total = F.sum("participants").over(Window.partitionBy())  # over the buckets, which are few
    return out.select("bucket", "participants", F.round(F.col("participants") * 100.0 / total, 6).alias("percent"))


def percent_voted(votes: DataFrame, c: VoteCols = VoteCols()) -> DataFrame:
    """Per unit: the share of its group's participants that voted on it, in percent."""
    of_unit = votes.groupBy(c.group, c.unit).agg(F.countDistinct(c.participant).alias("voters"))
    of_group = votes.groupBy(c.group).agg(F.countDistinct(c.participant).alias("participants"))
    return of_unit.join(of_group, c.group).withColumn("percent_voted", F.round(F.col("voters") * 100.0 / F.col("participants"), 6))


def scores(tallies: DataFrame) -> DataFrame:
    """Consensus (the largest share, less under ten votes) and division (how even support and oppose are, likewise)."""
    s, n, o, total = (F.col(x) for x in ("n_support", "n_neutral", "n_oppose", "n_votes"))
    weight = F.least(total / 10.0, F.lit(1.0))
    sided = s + o
    kinds = (s > 0).cast("int") + (n > 0).cast("int") + (o > 0).cast("int")
    consensus = F.when(total > 0, F.greatest(s, n, o) / total * weight)
    even = (1 - 2 * F.abs(s / sided - 0.5)) * sided / total * weight
    return tallies.withColumns({"consensus": F.round(consensus, 6), "division": F.round(F.when((kinds >= 2) & (sided > 0), even).otherwise(0.0), 6)})


def view_gap(views: DataFrame, votes: DataFrame, c: VoteCols = VoteCols()) -> DataFrame:
    """Per unit with votes: distinct viewers, and those of them who never voted on it."""
    seen = views.select(c.unit, c.participant).distinct()
    voted = votes.select(c.unit, c.participant).distinct().withColumn("_voted", F.lit(1))
    gap = seen.join(voted, [c.unit, c.participant], "left").groupBy(c.unit).agg(F.count("*").alias("viewers"), F.count(F.when(F.col("_voted").isNull(), 1)).alias("non_voters"))
    return votes.select(c.unit).distinct().join(gap, c.unit, "left").fillna(0, ["viewers", "non_voters"])


def net_votes(votes: DataFrame, units: DataFrame, c: VoteCols = VoteCols()) -> DataFrame:
    """Support less oppose per unit, 0 without votes."""
    sign = F.when(F.col(c.position) == c.values[0], 1).when(F.col(c.position) == c.values[2], -1).otherwise(0)
    return units.select(c.unit).distinct().join(votes.groupBy(c.unit).agg(F.sum(sign).alias("net")), c.unit, "left").select(c.unit, F.coalesce("net", F.lit(0)).alias("net"))
