"""Versioned tables, sinks that take a batch once, series as streams, first rows of windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from agora.operators import timeseries
from agora.sources.versioned import VersionedTable
from agora.streaming import cumulative
from agora.streaming import votes as stream

ROWS = "id int, name string, n int"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/table")


def held(table):
    return sorted(map(tuple, table.read().collect()))


def test_table_is_changed_from_itself(spark, table):
    make = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    assert table.read(ROWS).count() == 0
    assert table.upsert(make((1, "a", 1), (2, "b", 2)), ["id"])
    before = table.read()
    table.upsert(make((2, None, 5), (3, "c", 3)), ["id"])
    assert held(table) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    assert sorted(map(tuple, before.collect())) == [(1, "a", 1), (2, "b", 2)]  # a reader of the old version goes on
    table.upsert(make((2, None, 6)), ["id"], "overwrite")
    table.replace_children(make((9, "c", 7), (9, "c", 8)), "name", ["id", "n"])
    assert held(table) == [(1, "a", 1), (2, None, 6), (9, "c", 7), (9, "c", 8)]
    table.delete(make((9, "", 0)).select("id"), ["id"])
    assert held(table) == [(1, "a", 1), (2, None, 6)] and table.state()["version"] == 5
    table.clean()
    assert held(table) == [(1, "a", 1), (2, None, 6)]


def test_failed_write_leaves_the_table_as_it_was(spark, table):
    table.upsert(spark.createDataFrame([(1, "a", 1)], ROWS), ["id"])
    bad = spark.createDataFrame([(1, "b", 0)], ROWS).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad, ["id"])
    assert held(table) == [(1, "a", 1)] and table.state()["version"] == 1


def test_batch_counts_once(spark, table):
    put = table.sink(["id"])
    put(spark.createDataFrame([(1, "a", 1)], ROWS), 0)
    put(spark.createDataFrame([(1, "b", 2)], ROWS), 1)
    put(spark.createDataFrame([(1, "a", 1)], ROWS), 0)  # sent again
    put(spark.createDataFrame([(1, "z", 9)], ROWS), 1)
    assert held(table) == [(1, "b", 2)] and table.state()["version"] == 2
    table.sink(["id"], source="other")(spark.createDataFrame([(2, "c", 3)], ROWS), 0)
    assert held(table) == [(1, "b", 2), (2, "c", 3)]


def files(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")


def test_stream_of_totals_equals_the_batch(spark, tmp_path, table):
    """Rows out of order over several batches: the table ends as the cumulative counts of all rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cumulative.STATE_STORE)
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    batches = [[("a", day(5)), ("a", day(5, 3)), ("b", day(2))], [("a", day(9)), ("a", day(1)), (None, day(1)), ("b", None)], [("a", day(3)), ("b", day(2, 9)), ("c", day(7))]]
    files(spark, tmp_path, batches, "k string, ts timestamp")
    rows = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.run_once(cumulative.cumulative_totals(rows, "k"), table.sink(["key", "bucket"]), f"{tmp_path}/checkpoint").awaitTermination()
    want = set()
    for k in "abc":
        mine = [(k, t) for b in batches for x, t in b if x == k and t]
        series = timeseries.cumulative_counts(spark.createDataFrame(mine, "k string, ts timestamp"))
        days = {dt.datetime(t.year, t.month, t.day) for _, t in mine}
        want |= {(k, r["bucket"], r["total"]) for r in series.collect() if r["bucket"].replace(tzinfo=None) in days}
    assert set(held(table)) == want and table.state()["version"] >= 2


def test_votes_are_updated_and_first_rows_kept(spark, tmp_path, table):
    vote = "unit int, who string, position string, ts timestamp, id int"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [[(1, "x", "support", at(2), 1), (1, "y", "oppose", at(2), 2)], [(1, "x", "neutral", at(1), 3), (1, "y", "support", at(3), 4)]]
    files(spark, tmp_path, batches, vote)
    rows = spark.readStream.schema(vote).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.run_once(stream.latest_votes(rows, "unit", "who", "position", "ts", "id"), table.sink(["unit", "who"]), f"{tmp_path}/c1").awaitTermination()
    assert {(r["who"], r["position"]) for r in table.read().collect()} == {("x", "support"), ("y", "support")}
    seen = []
    stream.run_once(stream.first_per_window(rows, ["unit", "who"]), lambda f, i: seen.extend(f.collect()), f"{tmp_path}/c2", "append").awaitTermination()
    assert sorted(r["who"] for r in seen) == ["x", "y"]
