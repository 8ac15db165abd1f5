"""Opinion groups, slugs and persons bound to tables: data in which the right answer is known, and SQL that says it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import candidates, groups, merge, postings

from .catalog import query, read

#: Suppliers of three camps vote on 40 statements through what they sold, a few against their camp; the last vote counts.
CAMPS = """WITH v AS (SELECT l_suppkey AS user_id, l_partkey % 40 AS statement, l_orderkey * 10 + l_linenumber AS event_id, CASE WHEN ((l_partkey % 40) % 3 = l_suppkey % 3) <> ((l_orderkey * 7 + l_linenumber) % 11 = 0) THEN 1.0 ELSE -1.0 END AS x,
  row_number() OVER (PARTITION BY l_suppkey, l_partkey % 40 ORDER BY l_orderkey * 10 + l_linenumber DESC, l_partkey DESC) AS r FROM lineitem),
last AS (SELECT * FROM v WHERE r = 1),
camps AS (SELECT user_id % 3 AS camp, row_number() OVER (ORDER BY count(DISTINCT user_id) DESC, min(user_id)) - 1 AS g FROM last GROUP BY 1)
"""


def camp_votes(spark, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    statement = F.col("l_partkey") % 40
    support = (statement % 3 == F.col("l_suppkey") % 3) != ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 11 == 0)
    order = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id")
    return line.select(F.col("l_suppkey").alias("user_id"), statement.alias("statement"), order, F.col("l_partkey").alias("ts"), F.when(support, "support").otherwise("oppose").alias("position")).withColumn("ts", F.col("event_id") * 1_000_000 + F.col("ts"))


@query(CAMPS + "SELECT user_id, g::INT AS \"group\" FROM (SELECT DISTINCT user_id FROM last) JOIN camps ON user_id % 3 = camp")
def camps_found(spark, sf_dir):
    return groups.opinion_groups(camp_votes(spark, sf_dir), 3)


@query(
    CAMPS
    + """, m AS (SELECT g, count(*) AS members FROM (SELECT DISTINCT user_id FROM last) JOIN camps ON user_id % 3 = camp GROUP BY 1),
s AS (SELECT g, statement, avg(x) AS mean, 1 - least(coalesce(stddev_samp(x), 0), 1) AS c0, count(*) / any_value(members) AS significance FROM last JOIN camps ON user_id % 3 = camp JOIN m USING (g) GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN c0 > 0.7 AND significance <= 0.5 THEN c0 * significance / 0.5 ELSE c0 END AS consensus FROM s),
ok AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(consensus * significance, 9) DESC, statement) AS rank FROM t WHERE consensus >= 0.3 AND significance >= 0.5)
SELECT g::INT AS "group", count(*) AS n, round(sum(mean), 6) AS mean, round(sum(consensus), 6) AS consensus, round(sum(significance), 6) AS significance FROM ok WHERE rank <= 10 GROUP BY 1"""
)
def camps_agree(spark, sf_dir):
    v = camp_votes(spark, sf_dir)
    told = groups.characteristic_votes(v, groups.opinion_groups(v, 3))
    return told.groupBy("group").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 6).alias(c) for c in ("mean", "consensus", "significance")))


@query("SELECT 0 AS \"group\", row_number() OVER (ORDER BY statement) AS rank, statement, mean FROM (SELECT r_regionkey AS statement, avg(CASE WHEN (n_nationkey + r_regionkey) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS mean FROM nation, region GROUP BY 1) QUALIFY row_number() OVER (ORDER BY statement) <= 3")
def split_opinions(spark, sf_dir):
    """Nations vote on regions so evenly that no threshold is ever met: three stand."""
    both = read(spark, sf_dir, "nation").crossJoin(F.broadcast(read(spark, sf_dir, "region")))  # five regions
    position = F.when((F.col("n_nationkey") + F.col("r_regionkey")) % 2 == 0, "support").otherwise("oppose")
    votes = both.select(F.col("n_nationkey").alias("user_id"), F.col("r_regionkey").alias("statement"), F.lit(1).alias("ts"), F.col("n_nationkey").alias("event_id"), position.alias("position"))
    told = groups.characteristic_votes(votes, votes.select("user_id", F.lit(0).alias("group")).distinct())
    return told.select("group", "rank", "statement", "mean")


_BASE = "lower(c_mktsegment) || CASE c_nationkey % 3 WHEN 0 THEN '' ELSE '-' || c_nationkey % 3 END"
FILINGS = f"""WITH RECURSIVE f AS (SELECT c_custkey AS id, {_BASE} AS base, CASE WHEN c_custkey % 4 < 2 THEN 'm' || c_custkey % 61 || '@x.org' END AS email, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 53 || ' main st' END AS address FROM customer),
e AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.base = b.base AND (a.email = b.email OR a.address = b.address)),
reach(a, b) AS (SELECT id, id FROM f UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
p AS (SELECT a AS id, min(b) AS first_id FROM reach GROUP BY 1),
n AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS nth FROM p JOIN f USING (id) WHERE id = first_id),
top AS (SELECT n1.base, coalesce(max(try_cast(replace(n2.base, n1.base || '-', '') AS INT)), 0) AS top FROM (SELECT DISTINCT base FROM f) n1 LEFT JOIN (SELECT DISTINCT base FROM f) n2 ON starts_with(n2.base, n1.base || '-') GROUP BY 1),
s AS (SELECT id AS first_id, n.base || CASE nth WHEN 0 THEN '' ELSE '-' || (nth + top) END AS slug FROM n JOIN top USING (base))
"""


def filings(spark, sf_dir: str) -> DataFrame:
    c, key = read(spark, sf_dir, "customer"), F.col("c_custkey")
    base = F.concat(F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("-"), (F.col("c_nationkey") % 3).cast("string"))))
    email = F.when(key % 4 < 2, F.concat(F.when(key % 8 == 0, "M").otherwise("m"), (key % 61).cast("string"), F.lit("@x.org "))).when(key % 4 == 2, "")
    return c.select(key.alias("id"), base.alias("base"), email.alias("email"), F.when(key % 3 > 0, F.concat((key % 53).cast("string"), F.lit(" Main St"))).alias("address"))


@query(FILINGS + "SELECT id, slug, first_id, id <> first_id AS repeated FROM p JOIN s USING (first_id)")
def filed_persons(spark, sf_dir):
    return candidates.same_persons(filings(spark, sf_dir))


@query("SELECT count(*) AS n, count(*) AS n_slugs, 0 AS n_taken FROM customer WHERE c_custkey % 5 > 0")
def slugs_are_unique(spark, sf_dir):
    """Customers' slugs beside those that a fifth of them have already, whose numbers get in the way: all differ, none is taken."""
    rows = filings(spark, sf_dir)
    taken = rows.filter("id % 5 = 0").select(F.when(F.col("id") % 10 == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), (F.col("id") % 7).cast("string"))).alias("slug"))
    slugs = merge.numbered_slugs(rows.filter("id % 5 > 0"), "base", "id", taken)
    met = slugs.join(taken.distinct().withColumn("there", F.lit(1)), "slug", "left")
    return met.agg(F.count("*").alias("n"), F.countDistinct("slug").alias("n_slugs"), F.count("there").cast("int").alias("n_taken"))


_TEXTS = """WITH w AS (SELECT conv_id * 1000 + turn AS id, unnest(list_filter(string_split_regex(lower(role || ' ' || text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term, generate_subscripts(list_filter(string_split_regex(lower(role || ' ' || text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), 1) AS p FROM conversations),
h AS (SELECT id, term, p, CASE WHEN p = 1 THEN 1.0 ELSE 0.1 END AS wt, row_number() OVER (PARTITION BY id, term ORDER BY p) AS j FROM w WHERE term IN ('user', 'er', 'tion')),
a AS (SELECT * FROM h WHERE j <= 256), u AS (SELECT * FROM a WHERE term = 'er'), v AS (SELECT * FROM a WHERE term = 'tion')
"""


def talk_index(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    return postings.index(rows, "id", {"role": "A", "text": "D"})


@query(_TEXTS + "SELECT u.id, round(1 - product(1 - sqrt(u.wt * v.wt * CASE WHEN abs(u.p - v.p) > 100 THEN 1e-30 ELSE 1.0 / (1.005 + 0.05 * exp(abs(u.p - v.p) / 1.5 - 2)) END)), 6) AS rank FROM u JOIN v USING (id) GROUP BY 1")
def ranked_by_nearness(spark, sf_dir):
    met = postings.matches(talk_index(spark, sf_dir), ["er", "tion"])
    return met.select("id", F.round(postings.rank_all(F.col("hits")), 6).alias("rank"))


@query(_TEXTS + ", t AS (SELECT id, term, sum(wt / (j * j)) AS s, max(wt) AS top, arg_max(j, wt * 1000 - j) AS first FROM a GROUP BY ALL) SELECT id, round(sum((top + s - top / (first * first)) / 1.64493406685) / 2, 6) AS rank FROM t WHERE term IN ('user', 'er') GROUP BY 1")
def ranked_by_any_word(spark, sf_dir):
    met = postings.matches(talk_index(spark, sf_dir), ["user", "er"], every=False)
    return met.select("id", F.round(postings.rank_any(F.col("hits")), 6).alias("rank"))


@query(
    _TEXTS
    + """, e AS (SELECT id, term, p, max(CASE WHEN term = 'er' THEN p END) OVER x AS e, max(CASE WHEN term = 'tion' THEN p END) OVER x AS t FROM a WHERE term <> 'user' WINDOW x AS (PARTITION BY id ORDER BY p ROWS UNBOUNDED PRECEDING)),
c AS (SELECT id, p, least(e, t) AS b, row_number() OVER (PARTITION BY id, least(e, t) ORDER BY p) AS r FROM e WHERE e IS NOT NULL AND t IS NOT NULL),
s AS (SELECT id, sum(2 / 20.0 / (1 + greatest(p - b - 1, 0))) AS s FROM c WHERE r = 1 GROUP BY 1) SELECT id, round(s / (s + 1), 6) AS rank FROM s"""
)
def ranked_by_covers(spark, sf_dir):
    met = postings.matches(talk_index(spark, sf_dir), ["er", "tion"])
    return met.select("id", F.round(postings.cover_density(F.col("hits")), 6).alias("rank"))
