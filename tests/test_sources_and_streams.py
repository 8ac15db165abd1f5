import json
import zipfile

from pyspark.sql import functions as F

from agora.operators import merge, reporting, spatial
from agora.sources import readers
from agora.streaming import votes as stream


def test_results_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Race,Choice,Total\n Mayor , Ann ,"1,234"\nMayor,Overvotes,7\nMayor,Bo,x\n')
    names = {"Race": "office_name", "Choice": "candidate_name", "total": "votes", "County": "county"}
    rows = readers.results_csv(spark, str(tmp_path), names, ("votes",)).collect()
    assert sorted(map(tuple, rows)) == [("Mayor", "Ann", 1234, None), ("Mayor", "Bo", None, None)]


def test_separated(spark, tmp_path):
    (tmp_path / "a.txt").write_text("MN;1; x\nMN;1\n;2;\n")
    assert sorted(map(tuple, readers.separated(spark, str(tmp_path), ["a", "b", "c"]).collect()), key=repr) == [("MN", "1", "x"), (None, "2", None)]


def test_results_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<ElectionResult><Race name="R" key="1" precinctsReported="2" precinctsParticipating="3"><Candidate name="A" key="9" earlyBallotsCast="4" ballotsCast="5" totalVoters="6"/><Candidate name="B" key="8" earlyBallotsCast="1" totalVoters="6"/></Race></ElectionResult>')
    rows = sorted(readers.results_xml(spark, str(tmp_path)).select("candidate_name", "votes_for_candidate", "total_votes").collect())
    assert [tuple(r) for r in rows] == [("A", 9, 10), ("B", 1, 10)]


def test_decoded(spark):
    frame = spark.createDataFrame([(bytearray("né".encode()),), (bytearray(b"n\xe9 \x80\x9f"),)], "b binary")
    assert {r[0] for r in frame.select(readers.decoded(F.col("b"))).collect()} == {"né", "né €Ÿ"}


def test_zipped_json(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i, (name, doc) in enumerate([("x/bill/1.json", {"id": 1, "t": "old"}), ("x/vote/1.json", {"id": 3}), ("x/bill/2.json", {"id": 1, "t": "new"})]):
            z.writestr(name, json.dumps(doc))
    assert [tuple(r) for r in readers.zipped_json(spark, str(tmp_path / "a.zip"), "id int, t string").collect()] == [(1, "new")]


def test_upsert_with_null_keys_and_empty_sides(spark):
    old = spark.createDataFrame([(1, None, "a"), (None, "k", "b")], "id int, x string, y string")
    new = spark.createDataFrame([(None, None, "c"), (2, "z", None)], "id int, x string, y string")
    assert sorted(map(tuple, merge.upsert(old, new, ["id"]).collect()), key=repr) == sorted([(1, None, "a"), (None, "k", "c"), (2, "z", None)], key=repr)
    assert merge.upsert(old, new.limit(0), ["id"]).count() == 2
    assert merge.statistics(old.limit(0), new, ["id"]).first()["n_unmatched"] == 2


def test_numbered_slugs_go_on_from_those_taken(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, base string")
    taken = spark.createDataFrame([("a",), ("a-3",)], "slug string")
    assert {r["id"]: r["slug"] for r in merge.numbered_slugs(rows, "base", "id", taken).collect()} == {1: "a-4", 2: "a-5", 3: "b"}


def test_last_page_and_cursor(spark):
    rows = reporting.page(spark.range(5), [F.col("id")], 3, 2).collect()
    assert [(r["id"], r["place"], r["has_previous"], r["has_next"]) for r in rows] == [(3, 3, True, False), (4, 4, True, False)]
    assert rows[0]["cursor"] == "Q3Vyc29yOjM"
    assert spark.range(1).select(reporting.place_of(F.lit("Q3Vyc29yOjM"))).first()[0] == 3


def test_point_in_ring(spark):
    ring = F.from_json(F.lit('[{"x":0,"y":0},{"x":4,"y":0},{"x":4,"y":4},{"x":2,"y":1},{"x":0,"y":4}]'), "array<struct<x: double, y: double>>")
    points = [(1.0, 1.0, True), (2.0, 3.0, False), (5.0, 1.0, False), (3.5, 3.0, True)]
    frame = spark.createDataFrame(points, "x double, y double, want boolean")
    assert all(r[0] == r[1] for r in frame.select(spatial.in_ring(F.col("x"), F.col("y"), ring), "want").collect())


def test_streams(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = stream.counts_per_window(rows, "1 day", keys=("event_type",)).writeStream.outputMode("complete").format("memory").queryName("per_day").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(source).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("per_day").collect())) == sorted(map(tuple, batch.collect()))
    seen = []
    pings = rows.select(F.col("user_id").alias("embed"), F.concat(F.lit("http://x/"), "event_type", F.lit("?a=1")).alias("url"), "ts")
    stream.run_once(stream.last_seen(pings, "embed", "url", "ts"), lambda f, i: seen.append(f.count()), str(tmp_path)).awaitTermination()
    assert sum(seen) == spark.read.parquet(source).select("user_id", "event_type").distinct().count()
