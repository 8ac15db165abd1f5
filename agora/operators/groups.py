"""Opinion groups: participants clustered by how they voted, and what each group has in common."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, ranked
from .votes import VoteCols, latest

SEED, ROUNDS, TOLERANCE = 11, 100, 1e-4


def positions(votes: DataFrame, c: VoteCols = VoteCols()) -> DataFrame:
    """Sparse rows (participant, unit, x) of the latest votes: 1 support, -1 oppose, 0 neutral."""
    sign = F.when(F.col(c.position) == c.values[0], 1.0).when(F.col(c.position) == c.values[2], -1.0).otherwise(0.0)
    return latest(votes, c).select(c.participant, c.unit, sign.alias("x"))


def group_quality(rows: DataFrame, group: str, vector: str, k: int) -> DataFrame:
    """How far apart groups are for their width, one row: n, quality.

    Per group the least mean squared distance of pairs with another group, over that of pairs within (1 for a group of
    one; groups of equal vectors don't count), averaged over ``k`` and lowered by 1 / (1 + the deviation of sizes). No
    pairs are made: the mean squared distance follows from means and mean squared lengths.
    """
    at = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    of = at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c"), F.sum("q").alias("q")).join(sizes, group)
    other = of.select(F.col(group).alias("_other"), F.col("c").alias("_c"), F.col("q").alias("_q"))
    dot = F.aggregate(F.zip_with("c", "_c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    own = F.aggregate(F.transform("c", lambda a: a * a), F.lit(0.0), lambda a, x: a + x)
    within = F.when(F.col("n") <= 1, 1.0).otherwise(2.0 * F.col("n") / (F.col("n") - 1) * (F.col("q") - own))
    apart = of.join(other, F.col(group) != F.col("_other")).withColumn("d", F.col("q") + F.col("_q") - 2 * dot)  # k rows each
    ratio = apart.groupBy(group).agg(F.min("d").alias("d"), F.first(within).alias("w")).filter("w > 1e-12")
    score = ratio.agg(F.sum(F.col("d") / F.col("w")).alias("s"))
    mean = F.sum("n") / k
    spread = sizes.agg(F.sum("n").alias("n"), F.sqrt((F.sum(F.col("n") * F.col("n")) - F.sum("n") * mean) / k).alias("sd"))
    return score.crossJoin(spread).select("n", (F.coalesce("s", F.lit(0.0)) / k / (1 + F.col("sd"))).alias("quality"))


def _seeds(rows: DataFrame, people: DataFrame, k: int, c: VoteCols) -> list:
    """Participants to start from: one by chance, then each with a chance in proportion to its squared distance from the nearest before."""
    chance = lambda i: (F.pmod(F.xxhash64(F.col(c.participant).cast("string"), F.lit(SEED + i)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    left = people.withColumn("_d", F.lit(1.0))
    chosen: list = []
    for i in range(k):
        # of exponential waiting times with these rates the least one's is each with a chance in proportion to its rate
        best = left.filter("_d > 1e-12").orderBy(-F.log(chance(i)) / F.col("_d"), c.participant).select(c.participant).first()
        if best is None:
            break
        chosen.append(best[0])
        own = rows.filter(F.col(c.participant) == F.lit(best[0])).select(c.unit, F.col("x").alias("_y"))
        size = own.agg(F.coalesce(F.sum(F.col("_y") * F.col("_y")), F.lit(0.0)).alias("_s"))
        dot = rows.join(own, c.unit).groupBy(c.participant).agg(F.sum(F.col("x") * F.col("_y")).alias("_dot"))
        near = people.join(dot, c.participant, "left").crossJoin(F.broadcast(size)).select(c.participant, (F.col("q") + F.col("_s") - 2 * F.coalesce("_dot", F.lit(0.0))).alias("_e"))
        left = left.join(near, c.participant).withColumn("_d", F.least(F.when(F.lit(i == 0), F.col("_e")).otherwise(F.col("_d")), F.col("_e"))).drop("_e")
    return chosen


def _moves(sizes: list[int], least: int) -> list[tuple[int, int, int]]:
    """(from, to, how many): groups of over twice the least size give to those under it, in order, until one kind is used up."""
    sizes, out = list(sizes), []
    large, small = [i for i, n in enumerate(sizes) if n > 2 * least], [i for i, n in enumerate(sizes) if n < least]
    while large and small:
        a, b = large[0], small[0]
        n = min(sizes[a] - least, least - sizes[b])
        out.append((a, b, n))
        sizes[a], sizes[b] = sizes[a] - n, sizes[b] + n
        large, small = large[sizes[a] <= 2 * least :], small[sizes[b] >= least :]
    return out


def _balanced(assigned: DataFrame, t: int, k: int, least: int, c: VoteCols) -> DataFrame:
    """The members of a group that is too large which are nearest to one that is too small go there, exactly as many as it takes."""
    counts = dict(assigned.groupBy(F.col(f"g{t}")).count().collect())  # k rows
    for a, b, n in _moves([counts.get(i, 0) for i in range(k)], least):
        nearest = ranked(assigned.filter(F.col(f"g{t}") == a).select(c.participant, F.lit(1).alias("_one"), F.get(f"d{t}", F.lit(b)).alias("_d")), ["_one"], [F.col("_d"), F.col(c.participant)])
        going = nearest.filter(F.col("rank") <= n).select(c.participant, F.lit(b).alias("_to"))
        assigned = assigned.join(going, c.participant, "left").withColumn(f"g{t}", F.coalesce("_to", f"g{t}")).drop("_to")
    return assigned


def _lloyd(rows: DataFrame, people: DataFrame, n: int, tries: list[int], c: VoteCols) -> DataFrame:
    """Per participant its group for each number of groups tried, columns g2, g3, ...: rounds for all of them at once.

    Centres are rows (unit, array of all centres' values). Each participant also has a vote of 1 on no unit at all, whose
    centre values are minus half a centre's squared length: so a participant's votes times a centre's values are the more
    the nearer it is, and their sums on no unit are the groups' sizes. Neither votes nor centres pass through the driver.
    """
    seeds = _seeds(rows, people, max(tries), c)
    tries = [t for t in tries if t <= len(seeds)] or [max(1, min(len(seeds), tries[0]))]
    slots = [(t, i) for t in tries for i in range(t)]
    none = F.lit(None).cast(rows.schema[c.unit].dataType)
    own = rows.select(c.participant, F.struct(F.col(c.unit).alias("u")).alias("_u"), "x").unionByName(people.select(c.participant, F.struct(none.alias("u")).alias("_u"), F.lit(1.0).alias("x")))
    own = cut(own.repartition(c.participant))
    first = [F.sum(F.when(F.col(c.participant) == F.lit(seeds[i]), F.col("x")).otherwise(0.0)) for _, i in slots]
    sums = cut(own.filter(F.col(c.participant).isin(*seeds)).groupBy("_u").agg(F.array(*first).alias("s")))
    centres = None

    def centre_table(sums: DataFrame, sizes: list[float], lengths: list[float]) -> DataFrame:
        value = [F.when(F.col("_u.u").isNull(), -lengths[s] / 2).otherwise(F.get("s", F.lit(s)) / max(sizes[s], 1.0)) for s in range(len(slots))]
        return sums.select("_u", F.array(*value).alias("m"))

    def assign(centres: DataFrame) -> DataFrame:
        dots = own.join(centres, "_u").groupBy(c.participant).agg(F.array(*(F.sum(F.col("x") * F.get("m", F.lit(s))) for s in range(len(slots)))).alias("p"))
        mine = {t: F.slice("p", 1 + next(s for s, (u, _) in enumerate(slots) if u == t), t) for t in tries}
        return dots.select(c.participant, *((F.array_position(p, F.array_max(p)) - 1).cast("int").alias(f"g{t}") for t, p in mine.items()), *(F.transform(p, lambda x: -x).alias(f"d{t}") for t, p in mine.items()))

    def summed(assigned: DataFrame) -> DataFrame:
        of = [F.sum(F.when(F.col(f"g{t}") == i, F.col("x")).otherwise(0.0)) for t, i in slots]
        return cut(own.join(assigned.select(c.participant, *(f"g{t}" for t in tries)), c.participant).groupBy("_u").agg(F.array(*of).alias("s")))

    def told(sums: DataFrame, centres: DataFrame | None) -> tuple[list[float], list[float], float]:
        """Sizes, squared lengths of the new centres, and how far the one that moved most has moved."""
        both = sums.join(centres, "_u", "left") if centres is not None else sums.withColumn("m", F.lit(None).cast("array<double>"))
        unit, new, old = F.col("_u.u").isNotNull(), lambda s: F.get("s", F.lit(s)), lambda s: F.coalesce(F.get("m", F.lit(s)), F.lit(0.0))
        of = lambda f: F.array(*(F.coalesce(F.sum(F.when(unit, f(s))), F.lit(0.0)) for s in range(len(slots))))
        r = both.agg(F.max(F.when(~unit, F.col("s"))).alias("n"), of(lambda s: new(s) * new(s)).alias("nn"), of(lambda s: new(s) * old(s)).alias("no"), of(lambda s: old(s) * old(s)).alias("oo")).first()
        sizes = [max(x, 1.0) for x in r["n"]]
        lengths = [x / z / z for x, z in zip(r["nn"], sizes, strict=True)]
        return list(r["n"]), lengths, max(x - 2 * y / z + o for x, y, z, o in zip(lengths, r["no"], sizes, r["oo"], strict=True))

    sizes, lengths, _ = told(sums, None)
    for _ in range(ROUNDS):
        centres = centre_table(sums, sizes, lengths)
        assigned = assign(centres)
        after = summed(assigned)
        sizes, lengths, moved = told(after, centres)
        full = [t for t in tries if _moves([int(sizes[s]) for s, (u, _) in enumerate(slots) if u == t], n // (2 * t))]
        if full:
            assigned = cut(assigned)
            for t in full:
                assigned = cut(_balanced(assigned, t, t, n // (2 * t), c))
            after = summed(assigned)
            sizes, lengths, moved = told(after, centres)
        sums = after
        if moved < TOLERANCE:
            break
    return cut(assigned.select(c.participant, *(f"g{t}" for t in tries)))


def _sparse_quality(rows: DataFrame, people: DataFrame, groups: DataFrame, t: int, c: VoteCols) -> float:
    """``group_quality`` of sparse rows; k x k numbers pass through the driver, no centre."""
    of = groups.select(c.participant, F.col(f"g{t}").alias("g"))
    sizes = {r["g"]: (r["n"], r["q"]) for r in people.join(of, c.participant).groupBy("g").agg(F.count("*").alias("n"), F.avg("q").alias("q")).collect()}
    sums = rows.join(of, c.participant).groupBy("g", c.unit).agg(F.sum("x").alias("s"))
    dots = {(r["g"], r["h"]): r["p"] for r in sums.join(sums.select(F.col("g").alias("h"), c.unit, F.col("s").alias("_s")), c.unit).groupBy("g", "h").agg(F.sum(F.col("s") * F.col("_s")).alias("p")).collect()}
    dot = lambda a, b: dots.get((a, b), 0.0) / sizes[a][0] / sizes[b][0]
    total = 0.0
    for a, (n, q) in sizes.items():
        within = 1.0 if n <= 1 else 2.0 * n / (n - 1) * (q - dot(a, a))
        apart = [q + sizes[b][1] - 2 * dot(a, b) for b in sizes if b != a]
        if within > 1e-12 and apart:
            total += min(apart) / within
    mean = sum(n for n, _ in sizes.values()) / t
    spread = math.sqrt(max(0.0, sum(n * n for n, _ in sizes.values()) - mean * mean * t) / t) if len(sizes) == t else math.sqrt((sum((n - mean) ** 2 for n, _ in sizes.values()) + (t - len(sizes)) * mean**2) / t)
    return total / t / (1 + spread)


def opinion_groups(votes: DataFrame, k: int | None = None, c: VoteCols = VoteCols()) -> DataFrame:
    """Per participant: its group, from 0 by size (ties: the least participant).

    k: 2 to 5, the one of the best ``group_quality``; 2 for fewer than ten participants. Seeds are drawn by hashes, so
    reruns agree; after each assignment groups of under half the mean size are filled up from those of over the mean size.
    """
    rows = cut(positions(votes, c))
    people = cut(rows.groupBy(c.participant).agg(F.sum(F.col("x") * F.col("x")).alias("q")))
    n = people.count()
    if not n:
        return people.select(c.participant, F.lit(0).alias("group"))
    tries = [k] if k else [2] if n < 10 else [2, 3, 4, 5]
    found = _lloyd(rows.filter("x <> 0"), people, n, tries, c)
    held = [int(x[1:]) for x in found.columns if x != c.participant]
    best = held[0] if len(held) == 1 else max(held, key=lambda t: (_sparse_quality(rows, people, found, t, c), -t))
    out = found.select(c.participant, F.col(f"g{best}").alias("_g"))
    order = out.groupBy("_g").agg(F.count("*").alias("_n"), F.min(c.participant).alias("_first"))
    order = order.withColumn("group", F.row_number().over(Window.orderBy(F.desc("_n"), "_first")) - 1)  # five rows at most
    return out.join(F.broadcast(order), "_g").select(c.participant, "group")


def characteristic_votes(votes: DataFrame, groups: DataFrame, c: VoteCols = VoteCols(), top: int = 10) -> DataFrame:
    """Per group its most telling units: mean vote, consensus (1 less the spread) and significance (voters over members).

    Neutral votes are left out. Thresholds of 0.3 and 0.5 are lowered by a fifth until some unit passes; where none ever
    does, as nobody agrees on anything, the first three stand. Order: consensus times significance to nine digits, then the
    unit, so that the order in which votes were added up decides nothing.
    """
    sign = F.when(F.col(c.position) == c.values[0], 1.0).when(F.col(c.position) == c.values[2], -1.0)
    mine = latest(votes, c).withColumn("_s", sign).filter("_s is not null").join(groups, c.participant)
    size = groups.groupBy("group").agg(F.count("*").alias("members"))
    of = mine.groupBy("group", c.unit).agg(F.avg("_s").alias("mean"), F.coalesce(F.stddev_samp("_s"), F.lit(0.0)).alias("_sd"), F.count("*").alias("voters"))
    of = of.join(size, "group").withColumns({"consensus": 1 - F.least("_sd", F.lit(1.0)), "significance": F.col("voters") / F.col("members")})
    weak = (F.col("consensus") > 0.7) & (F.col("significance") <= 0.5)
    of = of.withColumn("consensus", F.when(weak, F.col("consensus") * F.col("significance") / 0.5).otherwise(F.col("consensus")))
    steps = lambda value, bar: F.when(value >= bar, 0.0).otherwise(F.ceil(F.log(value / bar) / math.log(0.8)))
    level = F.when((F.col("consensus") > 0) & (F.col("significance") > 0), F.greatest(steps(F.col("consensus"), 0.3), steps(F.col("significance"), 0.5)))
    w = Window.partitionBy("group")
    of = of.withColumn("_l", level).withColumn("_m", F.min("_l").over(w)).filter(F.col("_m").isNull() | (F.col("_l") == F.col("_m")))
    rank = F.row_number().over(w.orderBy(F.round(F.col("consensus") * F.col("significance"), 9).desc(), c.unit))
    return of.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("_m").isNull(), 3).otherwise(top)).select("group", "rank", c.unit, "mean", "consensus", "significance")
