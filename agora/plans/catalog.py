"""The operators bound to the star-schema tables: a query and its SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import text as tx
from agora.operators import elections, groups, merge, reporting, search, spatial, storage, timeseries, votes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cast_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as votes: statement and conversation from the payload, position from the type."""
    e = read(spark, sf_dir, "events")
    statement = F.get_json_object("props", "$.k").cast("int")
    position = F.when(F.col("event_type").isin("signup", "purchase"), "support").when(F.col("event_type").isin("view", "click"), "neutral").otherwise("oppose")
    return e.select("event_id", "ts", "user_id", "event_type", statement.alias("statement"), (statement % 5).alias("conversation"), position.alias("position"))


#: The same in SQL, as the head of a statement.
V = """WITH v AS (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS statement,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 5 AS conversation,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'support' WHEN event_type IN ('view', 'click') THEN 'neutral' ELSE 'oppose' END AS position FROM events),
t AS (SELECT statement, count(*) AS n_votes, count(*) FILTER (position = 'support') AS n_support, count(*) FILTER (position = 'neutral') AS n_neutral,
  count(*) FILTER (position = 'oppose') AS n_oppose FROM v GROUP BY 1)
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as election results: race l_orderkey, candidate l_suppkey, votes."""
    return results_of(read(spark, sf_dir, "lineitem"))


def results_of(line: DataFrame) -> DataFrame:
    return line.groupBy(F.col("l_orderkey").alias("race"), F.col("l_suppkey").alias("candidate")).agg(F.sum("l_quantity").cast("bigint").alias("votes"))


R = """WITH r AS (SELECT l_orderkey AS race, l_suppkey AS candidate, CAST(sum(l_quantity) AS BIGINT) AS votes FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY votes DESC NULLS LAST, candidate) AS rank, count(*) OVER (PARTITION BY race) AS n_candidates FROM r)
"""


# votes


@query(V + "SELECT * FROM t")
def vote_tally(spark, sf_dir):
    return votes.tally(cast_votes(spark, sf_dir))


@query(V + "SELECT u.statement, coalesce(n_votes, 0) AS n_votes, coalesce(n_support, 0) AS n_support, coalesce(n_neutral, 0) AS n_neutral, coalesce(n_oppose, 0) AS n_oppose FROM (SELECT DISTINCT statement + 50 AS statement FROM v) u LEFT JOIN t USING (statement)")
def vote_tally_all_units(spark, sf_dir):
    v = cast_votes(spark, sf_dir)
    return votes.tally(v, units=v.select((F.col("statement") + 50).alias("statement")))


@query(V + "SELECT *, round(n_support * n_oppose / (n_votes * n_votes), 6) AS controversy FROM t ORDER BY controversy DESC NULLS LAST, statement LIMIT 10")
def vote_sort_controversial(spark, sf_dir):
    t = votes.tally(cast_votes(spark, sf_dir))
    return votes.controversy(t).orderBy(F.desc_nulls_last("controversy"), "statement").limit(10)


@query(V + "SELECT * FROM t ORDER BY n_support DESC, statement LIMIT 10")
def vote_sort_most_agree(spark, sf_dir):
    t = votes.tally(cast_votes(spark, sf_dir))
    return t.orderBy(*votes.ordered(t, "most_agree")).limit(10)


@query(V + "SELECT conversation, count(*) FILTER (position = 'support') AS support, count(*) FILTER (position = 'neutral') AS neutral, count(*) FILTER (position = 'oppose') AS oppose FROM v GROUP BY 1")
def public_votes(spark, sf_dir):
    return votes.public_votes(cast_votes(spark, sf_dir), keys=("conversation",))


@query(V + "SELECT sum(CASE WHEN position = 'support' THEN 1 ELSE 0 END)::BIGINT AS support, sum(CASE WHEN position = 'neutral' THEN 1 ELSE 0 END)::BIGINT AS neutral, sum(CASE WHEN position = 'oppose' THEN 1 ELSE 0 END)::BIGINT AS oppose FROM v WHERE statement < 0")
def public_votes_of_none(spark, sf_dir):
    return votes.public_votes(cast_votes(spark, sf_dir).filter("statement < 0"))


@query(V + "SELECT conversation, count(DISTINCT user_id) AS participants, count(*) AS votes, count(DISTINCT statement) AS statements, round(count(*) / count(DISTINCT user_id), 6) AS avg_votes FROM v GROUP BY 1")
def conversation_stats(spark, sf_dir):
    return votes.statistics(cast_votes(spark, sf_dir))


@query(V + "SELECT statement, user_id, position FROM (SELECT *, row_number() OVER (PARTITION BY statement, user_id ORDER BY ts DESC, event_id DESC) AS n FROM v) WHERE n = 1")
def latest_votes(spark, sf_dir):
    return votes.latest(cast_votes(spark, sf_dir)).select("statement", "user_id", "position")


_SPINE = """, s AS (SELECT unnest(generate_series(date_trunc('{unit}', min(ts)), date_trunc('{unit}', max(ts)) + INTERVAL {more} {unit}, INTERVAL {step} {unit})) AS bucket FROM v)"""


@query(V + _SPINE.format(unit="day", more=0, step=1) + "SELECT bucket, count(v.event_id) AS total FROM s LEFT JOIN v ON date_trunc('day', ts) <= bucket GROUP BY 1")
def votes_over_time(spark, sf_dir):
    return timeseries.cumulative_counts(cast_votes(spark, sf_dir), "1 day")


@query(V + _SPINE.format(unit="day", more=1, step=2) + "SELECT bucket, count(v.statement) AS total FROM s LEFT JOIN (SELECT statement, min(ts) AS ts FROM v GROUP BY 1) v ON date_trunc('day', ts) <= bucket GROUP BY 1")
def statements_over_time(spark, sf_dir):
    """Statements by their first vote, on the votes' own buckets of two days."""
    return timeseries.cumulative_distinct(cast_votes(spark, sf_dir), "statement", "2 days")


@query(V + _SPINE.format(unit="day", more=0, step=1) + "SELECT bucket, count(DISTINCT user_id) AS total FROM s LEFT JOIN v ON date_trunc('day', ts) <= bucket GROUP BY 1")
def participation_over_time(spark, sf_dir):
    return timeseries.cumulative_distinct(cast_votes(spark, sf_dir), "user_id", "1 day")


@query(V + "SELECT bucket, participants, round(participants * 100.0 / sum(participants) OVER (), 6) AS percent FROM (SELECT n // 5 * 5 AS bucket, count(*) AS participants FROM (SELECT user_id, count(*) AS n FROM v GROUP BY 1) GROUP BY 1)")
def vote_distribution(spark, sf_dir):
    return votes.distribution(cast_votes(spark, sf_dir), 5)


@query(V + "SELECT conversation, statement, voters, participants, round(voters * 100.0 / participants, 6) AS percent_voted FROM (SELECT conversation, statement, count(DISTINCT user_id) AS voters FROM v GROUP BY 1, 2) JOIN (SELECT conversation, count(DISTINCT user_id) AS participants FROM v GROUP BY 1) USING (conversation)")
def percent_voted(spark, sf_dir):
    return votes.percent_voted(cast_votes(spark, sf_dir))


_SCORES = """, c AS (SELECT statement, round(greatest(n_support, n_neutral, n_oppose) / n_votes * least(n_votes / 10, 1), 6) AS consensus,
  round(CASE WHEN n_support + n_oppose > 0 AND (n_support > 0)::INT + (n_neutral > 0)::INT + (n_oppose > 0)::INT >= 2
    THEN (1 - 2 * abs(n_support / (n_support + n_oppose) - 0.5)) * (n_support + n_oppose) / n_votes * least(n_votes / 10, 1) ELSE 0 END, 6) AS division FROM t)"""


@query(V + _SCORES + "SELECT * FROM c ORDER BY consensus DESC, statement LIMIT 5")
def consensus_top(spark, sf_dir):
    return votes.scores(votes.tally(cast_votes(spark, sf_dir))).select("statement", "consensus", "division").orderBy(F.desc("consensus"), "statement").limit(5)


@query(V + _SCORES + "SELECT * FROM c ORDER BY division DESC, statement LIMIT 5")
def divisive_top(spark, sf_dir):
    return votes.scores(votes.tally(cast_votes(spark, sf_dir))).select("statement", "consensus", "division").orderBy(F.desc("division"), "statement").limit(5)


@query(V + """, seen AS (SELECT DISTINCT statement, user_id FROM v WHERE event_type = 'view'), cast_ AS (SELECT DISTINCT statement, user_id FROM v WHERE event_type <> 'view')
SELECT statement, count(s.user_id) AS viewers, count(s.user_id) FILTER (c.user_id IS NULL) AS non_voters FROM (SELECT DISTINCT statement FROM cast_) u LEFT JOIN seen s USING (statement) LEFT JOIN cast_ c USING (statement, user_id) GROUP BY 1""")
def view_gap(spark, sf_dir):
    v = cast_votes(spark, sf_dir)
    return votes.view_gap(v.filter("event_type = 'view'"), v.filter("event_type <> 'view'"))


@query(V + "SELECT statement, (n_support - n_oppose)::BIGINT AS net FROM t")
def net_vote(spark, sf_dir):
    v = cast_votes(spark, sf_dir)
    return votes.net_votes(v, v)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, sf_dir):
    return timeseries.counts_per(read(spark, sf_dir, "events"), "day", keys=("event_type",))


@query("SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def sentiment_counts(spark, sf_dir):
    return read(spark, sf_dir, "labels").filter("quality is not null").groupBy("quality").agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn)::BIGINT AS last_turn FROM conversations GROUP BY 1")
def turns_by_role(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").cast("bigint").alias("last_turn"))


@query()
def opinion_groups(spark, sf_dir):
    return groups.opinion_groups(cast_votes(spark, sf_dir))


@query()
def characteristic_votes(spark, sf_dir):
    v = cast_votes(spark, sf_dir)
    return groups.characteristic_votes(v, groups.opinion_groups(v))


# results


@query(R + "SELECT race, candidate, votes, sum(votes) OVER (PARTITION BY race)::BIGINT AS total_votes, round(CAST(votes * 100.0 / nullif(sum(votes) OVER (PARTITION BY race), 0) AS DECIMAL(24,8)), 1)::DOUBLE AS vote_percent FROM r")
def vote_pct(spark, sf_dir):
    return elections.shares(results(spark, sf_dir), "race", "votes")


@query(R + "SELECT race, coalesce(max(CASE WHEN candidate % 7 = 0 THEN votes + 10 END), sum(votes))::BIGINT AS total_votes FROM r GROUP BY 1")
def race_total_recovery(spark, sf_dir):
    r = results(spark, sf_dir).withColumn("stated", F.when(F.col("candidate") % 7 == 0, F.col("votes") + 10))
    return elections.recovered_totals(r, "race", "votes", "stated")


@query(R + "SELECT race, candidate, votes, rank::INT AS rank, n_candidates FROM k WHERE rank <= 2")
def top_two(spark, sf_dir):
    return elections.leaders(results(spark, sf_dir), "race", "votes", "candidate")


@query(R + "SELECT race, candidate, rank::INT AS rank, n_candidates FROM k")
def rank_with_total(spark, sf_dir):
    return elections.ranked(results(spark, sf_dir), "race", "votes", "candidate").select("race", "candidate", "rank", "n_candidates")


@query(R + "SELECT race, candidate, rank::INT AS rank FROM k WHERE rank <= coalesce(nullif(race % 4, 0), 1)")
def top_num_elect(spark, sf_dir):
    seats = F.nullif(F.col("race") % 4, F.lit(0))
    return elections.leaders(results(spark, sf_dir), "race", "votes", "candidate", seats).select("race", "candidate", "rank")


@query(R + "SELECT race, array_to_string(list(candidate ORDER BY rank), ',') AS winners FROM k WHERE rank <= 2 GROUP BY 1")
def winners_array(spark, sf_dir):
    return elections.winners(results(spark, sf_dir), "race", "votes", "candidate").select("race", F.array_join(F.transform("winner_ids", lambda x: x.cast("string")), ",").alias("winners"))


@query(R + "SELECT race, count(DISTINCT candidate) AS n_candidates, round(max(votes) / sum(votes), 6) AS best_share FROM r GROUP BY 1 HAVING count(DISTINCT candidate) > 2 AND max(votes) / sum(votes) < 0.5")
def runoff_having(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    return elections.runoffs(results_of(storage.dealt(line.select("l_orderkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_suppkey"], line.count())), "race", "votes", "candidate")


@query(R + """, o AS (SELECT k.*, n_candidates > 2 AND max(votes) OVER w < 0.5 * sum(votes) OVER w AS open FROM k JOIN orders ON o_orderkey = race WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY race))
SELECT race, candidate, rank::INT AS rank, CASE WHEN open AND rank <= 2 THEN 'runoff' ELSE 'general' END AS outcome FROM o WHERE (open AND rank <= 2) OR (NOT open AND rank <= 1)""")
def post_primary(spark, sf_dir):
    races = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("race"), "o_orderstatus")
    return elections.post_primary(races, results(spark, sf_dir), "race", "votes", "candidate", F.col("o_orderstatus") == "F")


@query(R + """, w AS (SELECT race, list(candidate) AS ids FROM k WHERE rank <= 1 AND race % 3 > 0 GROUP BY 1)
SELECT candidate, count(*) FILTER (list_contains(ids, candidate)) AS wins, count(*) FILTER (NOT list_contains(ids, candidate)) AS losses FROM r JOIN w USING (race) GROUP BY 1""")
def wins_losses(spark, sf_dir):
    r = results(spark, sf_dir)
    return elections.wins_and_losses(elections.winners(r.filter("race % 3 > 0"), "race", "votes", "candidate", 1), r, "race", "candidate")


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END ASC NULLS LAST, TRY_CAST(nullif(regexp_extract(p_brand, '([0-9]+)$', 1), '') AS INT) ASC NULLS LAST, p_brand, p_type DESC, p_partkey)::INT AS place FROM part QUALIFY place <= 50")
def ballot_order(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumns({"priority": F.when(F.col("p_size") % 3 != 0, F.col("p_size")), "district": tx.trailing_int(F.col("p_brand")).cast("string")})
    order = elections.ballot_order(F.col("priority"), F.col("district"), F.lit(None).cast("string"), F.col("p_type"), F.col("p_partkey"))
    return reporting.page(p, order, 50).select("p_partkey", (F.col("place") + 1).cast("int").alias("place"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderdate::DATE >= DATE '1997-01-01' THEN 0 ELSE 1 END, abs(o_orderdate::DATE - DATE '1997-01-01'), o_orderkey) = 1")
def nearest_election(spark, sf_dir):
    return elections.nearest(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", F.lit("1997-01-01").cast("date"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def next_election(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter(F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp")).orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderdate")


@query("""WITH j AS (SELECT c_custkey, 'nation' AS scope, n_nationkey::VARCHAR AS key FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
SELECT c_custkey, 'region', n_regionkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
SELECT c_custkey, 'segment', n_nationkey::VARCHAR || '|' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'nation' WHEN 1 THEN 'region' ELSE 'segment' END AS scope,
  CASE s_suppkey % 3 WHEN 0 THEN s_nationkey::VARCHAR WHEN 1 THEN (s_nationkey % 5)::VARCHAR ELSE s_nationkey::VARCHAR || '|BUILDING' END AS key FROM supplier)
SELECT c_custkey, count(*) AS n_races, min(s_suppkey) AS first_race FROM j JOIN r USING (scope, key) GROUP BY 1""")
def races_for_address(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    places = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    n, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 3
    scope = F.when(k == 0, "nation").when(k == 1, "region").otherwise("segment")
    key = F.when(k == 0, n).when(k == 1, (F.col("s_nationkey") % 5).cast("string")).otherwise(F.concat(n, F.lit("|BUILDING")))
    races = read(spark, sf_dir, "supplier").select("s_suppkey", scope.alias("scope"), key.alias("key"))
    ballots = races.groupBy("scope", "key").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))  # a place votes in all races of a key or in none
    found = elections.races_for_places(places, ballots, {"nation": ["n_nationkey"], "region": ["n_regionkey"], "segment": ["n_nationkey", "c_mktsegment"]})
    return found.groupBy("c_custkey").agg(F.sum("n").alias("n_races"), F.min("first").alias("first_race"))


@query("SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS b, CASE WHEN p_size % 3 = 0 THEN p_type END AS t FROM part) WHERE (b IS NULL OR b = 'Brand#11') AND (t IS NULL OR t = (SELECT min(p_type) FROM part))")
def measures_for_address(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    kind = p.agg(F.min("p_type")).first()[0]
    m = p.withColumns({"b": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), "t": F.when(F.col("p_size") % 3 == 0, F.col("p_type"))})
    return elections.measures_for_place(m, {"b": "Brand#11", "t": kind}).select("p_partkey")


# joins and reports


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders, coalesce(m, 0)::BIGINT AS n_urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority LIKE '1%') AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def embed_activity(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    children = {"n_orders": (o, "o_custkey"), "n_urgent": (o.filter(F.col("o_orderpriority").startswith("1")), "o_custkey")}
    return reporting.counts_of_children(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", children)


@query("SELECT o_custkey, count(DISTINCT o_orderkey) // count(DISTINCT l_suppkey) AS submissions FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def guide_submission_count(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.expr("count(distinct o_orderkey) div count(distinct l_suppkey)").alias("submissions"))


@query("SELECT c_mktsegment, sum(q)::BIGINT AS total FROM (SELECT c_mktsegment, c_custkey, count(*) // count(DISTINCT o_orderpriority) AS q FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def org_total(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    per = o.groupBy("o_custkey").agg(F.expr("count(*) div count(distinct o_orderpriority)").alias("q"))
    return c.join(per, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("q").alias("total"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def count_by_state(spark, sf_dir):
    per = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return per.join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "n")


@query("SELECT o_custkey, max(o_orderdate) AS last_submission FROM orders GROUP BY 1")
def last_submission(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_submission"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def first_per_group(spark, sf_dir):
    return reporting.latest_per(read(spark, sf_dir, "orders"), ("o_custkey",), "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS match_type, count(*) AS n FROM orders GROUP BY 1")
def match_summary(spark, sf_dir):
    kind = F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low")
    return read(spark, sf_dir, "orders").groupBy(kind.alias("match_type")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place, true AS has_previous, true AS has_next FROM orders QUALIFY place BETWEEN 20 AND 29")
def page_after_cursor(spark, sf_dir):
    return reporting.page(read(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 10, 19).select("o_orderkey", F.col("place").cast("bigint").alias("place"), "has_previous", "has_next")


@query("SELECT event_type, le::DOUBLE AS le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([10, 50, 100, 500]) AS le) GROUP BY 1, 2")
def histogram(spark, sf_dir):
    return reporting.histogram(read(spark, sf_dir, "events"), "value", [10, 50, 100, 500], ("event_type",))


@query("SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey")
def dedupe_bridge(spark, sf_dir):
    li, p = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), read(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type").distinct()


@query("SELECT l_orderkey, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS tags FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def lateral_tags(spark, sf_dir):
    return dedupe_bridge(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("p_type")), "|").alias("tags"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_endorsed(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_unmatched(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.unmatched(read(spark, sf_dir, "orders").select("o_orderkey"), li, ["o_orderkey"])


@query("SELECT o_orderkey, tag FROM orders JOIN (SELECT unnest(['F', 'O']) AS o_orderstatus, unnest(['1-URGENT', '2-HIGH']) AS o_orderpriority, unnest(['a', 'b']) AS tag) USING (o_orderstatus, o_orderpriority)")
def param_join(spark, sf_dir):
    given = spark.createDataFrame([("F", "1-URGENT", "a"), ("O", "2-HIGH", "b")], "o_orderstatus string, o_orderpriority string, tag string")
    return read(spark, sf_dir, "orders").join(F.broadcast(given), ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "tag")


@query(V + "SELECT statement, p_name, n_votes FROM t JOIN part ON p_partkey = statement")
def json_join(spark, sf_dir):
    t = votes.tally(cast_votes(spark, sf_dir))
    return t.join(read(spark, sf_dir, "part"), F.col("statement") == F.col("p_partkey")).select("statement", "p_name", "n_votes")


@query("SELECT author_type, author_id, name FROM (SELECT 'customer' AS author_type, c_custkey AS author_id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) JOIN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'customer' ELSE 'supplier' END AS author_type, o_custkey AS author_id FROM orders GROUP BY ALL) USING (author_type, author_id)")
def polymorphic_author(spark, sf_dir):
    people = read(spark, sf_dir, "customer").select(F.lit("customer").alias("author_type"), F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"))
    firms = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("author_type"), F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"))
    asked = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "customer").otherwise("supplier").alias("author_type"), F.col("o_custkey").alias("author_id")).distinct()
    return people.unionByName(firms).join(asked, ["author_type", "author_id"])


@query("SELECT key, kind, count(*) AS n FROM (SELECT l_suppkey AS key, 'line' AS kind FROM lineitem UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT o_custkey, 'order' FROM orders) GROUP BY 1, 2")
def union_results(spark, sf_dir):
    parts = [(read(spark, sf_dir, t), c, k) for t, c, k in (("lineitem", "l_suppkey", "line"), ("supplier", "s_suppkey", "supplier"), ("orders", "o_custkey", "order"))]
    frames = [f.select(F.col(c).alias("key"), F.lit(k).alias("kind")) for f, c, k in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).groupBy("key", "kind").agg(F.count("*").alias("n"))


# filters


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11' AND p_size >= 10")
def optional_filters(spark, sf_dir):
    wanted = {"p_brand": "Brand#11", "p_type": None, "least": 10}
    p = read(spark, sf_dir, "part")
    tests = [F.col(c) == v for c, v in wanted.items() if c != "least" and v is not None] + ([F.col("p_size") >= wanted["least"]] if wanted["least"] is not None else [])
    for t in tests:
        p = p.filter(t)
    return p.select("p_partkey", "p_name")


@query("SELECT DISTINCT p_name FROM part WHERE p_name ILIKE '%E'")
def ilike_suffix(spark, sf_dir):
    return read(spark, sf_dir, "part").filter(F.col("p_name").ilike("%E")).select("p_name").distinct()


@query("SELECT count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS a, nullif(o_orderpriority, '1-URGENT') AS b FROM orders) WHERE a IS NOT DISTINCT FROM NULL AND b IS DISTINCT FROM '2-HIGH'")
def null_safe_eq(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("a"), F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("b"))
    return o.filter(F.col("a").eqNullSafe(F.lit(None)) & ~F.col("b").eqNullSafe(F.lit("2-HIGH"))).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-06-01' AND (l_returnflag = 'N' OR l_shipdate + INTERVAL 90 DAY >= TIMESTAMP '1996-06-01') GROUP BY 1")
def temporal_validity(spark, sf_dir):
    as_of = F.lit("1996-06-01").cast("timestamp")
    start, end = F.col("l_shipdate"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate") + F.expr("interval 90 days"))
    return read(spark, sf_dir, "lineitem").filter((start <= as_of) & (end.isNull() | (end >= as_of))).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE list_contains(string_split(replace('BUILDING, MACHINERY', ' ', ''), ','), c_mktsegment)")
def csv_membership(spark, sf_dir):
    listed = F.split(F.regexp_replace(F.lit("BUILDING, MACHINERY"), " ", ""), ",")
    return read(spark, sf_dir, "customer").filter(F.array_contains(listed, F.col("c_mktsegment"))).select("c_custkey")


# merges

_OLD = "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0"
_NEW = "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'new ' || c_name END AS c_name, CASE WHEN c_custkey % 5 > 0 THEN 'X' END AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.filter(k % 2 == 0).select("c_custkey", F.when(k % 3 > 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    return old, c.filter(k % 3 == 0).select("c_custkey", F.when(k % 4 > 0, F.concat(F.lit("new "), "c_name")).alias("c_name"), F.when(k % 5 > 0, "X").alias("c_mktsegment"))


@query(f"SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (c_custkey)")
def upsert_coalesce(spark, sf_dir):
    return merge.upsert(*_sides(spark, sf_dir), ["c_custkey"])


@query(f"SELECT c_custkey, CASE WHEN n.k IS NOT NULL THEN n.c_name ELSE o.c_name END AS c_name, CASE WHEN n.k IS NOT NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment FROM ({_OLD}) o FULL JOIN (SELECT *, 1 AS k FROM ({_NEW})) n USING (c_custkey)")
def upsert_overwrite(spark, sf_dir):
    return merge.upsert(*_sides(spark, sf_dir), ["c_custkey"], "overwrite")


@query(f"SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, CASE WHEN o.k IS NOT NULL THEN o.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment FROM (SELECT *, 1 AS k FROM ({_OLD})) o FULL JOIN ({_NEW}) n USING (c_custkey)")
def upsert_by_policy(spark, sf_dir):
    return merge.upsert(*_sides(spark, sf_dir), ["c_custkey"], {"c_mktsegment": "keep"})


@query(f"{_OLD} UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey % 2 <> 0")
def insert_if_absent(spark, sf_dir):
    return merge.insert_absent(*_sides(spark, sf_dir), ["c_custkey"])


@query("SELECT l_orderkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE l_orderkey % 10 > 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 0")
def replace_children(spark, sf_dir):
    old = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    all_new = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_suppkey"))
    return merge.replace_children(old, all_new.filter("l_orderkey % 10 = 0"), "l_orderkey", ["l_suppkey"])


@query(f"SELECT c_custkey FROM ({_OLD}) WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_NEW}))")
def delete_by_key(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return merge.delete(old, new, ["c_custkey"]).select("c_custkey")


@query(f"SELECT c_custkey FROM ({_OLD}) o JOIN ({_NEW}) n USING (c_custkey) WHERE o.c_name IS DISTINCT FROM n.c_name")
def hash_cdc(spark, sf_dir):
    return merge.changed(*_sides(spark, sf_dir), "c_custkey", "c_name")


@query(f"SELECT c_custkey, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'old' ELSE 'both' END AS found_in FROM (SELECT *, 1 AS k FROM ({_OLD})) o FULL JOIN (SELECT *, 1 AS k FROM ({_NEW})) n USING (c_custkey)")
def full_outer_compare(spark, sf_dir):
    return merge.compared(*_sides(spark, sf_dir), ["c_custkey"])


@query(f"SELECT count(*) AS n_rows, count(o.k) AS n_matched, count(*) - count(o.k) AS n_unmatched, count(*) FILTER (o.k IS NOT NULL AND o.c_name IS DISTINCT FROM n.c_name) AS n_updated FROM ({_NEW}) n LEFT JOIN (SELECT *, 1 AS k FROM ({_OLD})) o USING (c_custkey)")
def merge_stats(spark, sf_dir):
    return merge.statistics(*_sides(spark, sf_dir), ["c_custkey"], ~F.col("_o.c_name").eqNullSafe(F.col("_n.c_name")))


@query("SELECT p_partkey, b || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS slug FROM (SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS b, row_number() OVER (PARTITION BY lower(replace(p_name, ' ', '-')) ORDER BY p_partkey) - 1 AS n FROM part)")
def unique_slugs(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", tx.slugify(F.col("p_name")).alias("base"))
    return merge.numbered_slugs(p, "base", "p_partkey").select("p_partkey", "slug")


# text


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 -]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '-') AS slug FROM documents")
def slugify(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query(r"SELECT page_id, nullif(trim(regexp_extract(regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1), '(?i)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def clean_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.clean_url(F.col("url")).alias("url"))


@query("SELECT p_partkey, levenshtein(p_brand, 'Brand#12')::INT AS distance FROM part WHERE levenshtein(p_brand, 'Brand#12') <= 1")
def levenshtein_search(spark, sf_dir):
    return search.edit_search(read(spark, sf_dir, "part"), "p_brand", "Brand#12", 1).select("p_partkey", "distance")


_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(rf"SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE list_contains(w, 'the') AND (list_contains(w, 'idiot') OR list_contains(w, 'license')) AND NOT list_contains(w, 'apache')")
def websearch_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(search.websearch(F.col("text"), "the idiot or license -apache")).select("doc_id")


@query(rf"SELECT word, count(*) AS n_texts FROM (SELECT unnest(list_distinct({_WORDS})) AS word FROM benchmark) WHERE word NOT IN {search.STOP_WORDS} GROUP BY 1 HAVING count(*) > 1 ORDER BY n_texts DESC, word LIMIT 10")
def common_words(spark, sf_dir):
    return search.common_words(read(spark, sf_dir, "benchmark"), "text")


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH a AS (SELECT DISTINCT p_name AS x, {_GRAMS.format(c='p_name')} AS g FROM part), b AS (SELECT DISTINCT p_type AS x, {_GRAMS.format(c='p_type')} AS g FROM part),
u AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT p.x AS left_text, q.x AS right_text, round(len(list_intersect(p.g, q.g)) / (len(p.g) + len(q.g) - len(list_intersect(p.g, q.g))), 6) AS similarity FROM u p, u q
WHERE len(list_intersect(p.g, q.g)) / (len(p.g) + len(q.g) - len(list_intersect(p.g, q.g))) > 0.4""")
def fuzzy_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("x")).unionByName(p.select(F.col("p_type").alias("x"))).distinct()
    return search.fuzzy_pairs(names, names, "x", "x", 0.4).withColumn("similarity", F.round("similarity", 6))


@query("SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'rose')")
def nickname_search(spark, sf_dir):
    return search.nickname_search(read(spark, sf_dir, "part").select("p_name").distinct(), "p_name", "red", [("red", "rose")])


@query("SELECT c_custkey, a FROM (SELECT c_custkey, c_acctbal AS x, (c_custkey % 100)::DOUBLE AS y FROM customer), (VALUES ('low', 0, 10, 2000, 60), ('high', 1500, 30, 9000, 95)) r(a, x0, y0, x1, y1) WHERE x > x0 AND x < x1 AND y > y0 AND y < y1 AND y <> y0")
def points_in_areas(spark, sf_dir):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    areas = spark.createDataFrame([("low", box(0.0, 10.5, 2000.0, 59.5)), ("high", box(1500.0, 30.5, 9000.0, 94.5))], "a string, ring array<struct<x: double, y: double>>")
    points = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    return spatial.join_points(points, areas, 500.0).select("c_custkey", "a")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
