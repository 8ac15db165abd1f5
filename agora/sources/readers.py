"""Readers of messy source files into typed rows, with Spark's own sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What bytes 80 to 9F mean in code page 1252, in order; five have no meaning.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
#: Contest rows that sum others up.
SUMMARY_ROWS = ("Cast Votes", "Undervotes", "Overvotes")


def whole_number(text: Column) -> Column:
    """"1,234" -> 1234; null if it isn't one."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("bigint")


def results_csv(spark: SparkSession, path: str, names: dict[str, str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header whose columns are found by name; ``names``: header (any case) -> column. Absent ones are null; summary rows go."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    have = {c.strip().lower(): c for c in raw.columns}
    out = []
    for header, column in names.items():
        source = F.col(f"`{have[header.lower()]}`") if header.lower() in have else F.lit(None).cast("string")
        out.append((whole_number(source) if column in numbers else source).alias(column))
    rows = raw.select(*out)
    return rows.filter(~F.coalesce(F.col("candidate_name").isin(*SUMMARY_ROWS), F.lit(False))) if "candidate_name" in rows.columns else rows


def separated(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Lines without a header and a fixed number of fields; lines with another number go."""
    fields = F.split(F.col("value"), f"\\Q{sep}\\E", -1)
    rows = spark.read.text(path).filter(F.size(fields) == len(columns))
    return rows.select(*(F.nullif(F.trim(F.get(fields, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(columns)))


def results_xml(spark: SparkSession, path: str) -> DataFrame:
    """Race and Candidate elements as rows; a race's total is the sum of its candidates' early and late ballots."""
    schema = "_name string, _key string, _precinctsReported bigint, _precinctsParticipating bigint, Candidate array<struct<_name: string, _key: string, _earlyBallotsCast: bigint, _ballotsCast: bigint, _totalVoters: bigint>>"
    races = spark.read.format("xml").option("rowTag", "Race").schema(schema).load(path)
    votes = lambda c: F.coalesce(c["_earlyBallotsCast"], F.lit(0)) + F.coalesce(c["_ballotsCast"], F.lit(0))
    total = F.aggregate(F.transform(F.coalesce("Candidate", F.array()), votes), F.lit(0).cast("bigint"), lambda a, b: a + b)
    rows = races.withColumn("total_votes", total).withColumn("c", F.explode_outer("Candidate"))
    return rows.select(
        F.col("_name").alias("office_name"), F.col("_key").alias("office_key"), F.col("c._name").alias("candidate_name"), F.col("c._key").alias("candidate_key"),
        F.col("_precinctsReported").alias("precincts_reporting"), F.col("_precinctsParticipating").alias("precincts_total"),
        votes(F.col("c")).alias("votes_for_candidate"), "total_votes", F.col("c._totalVoters").alias("total_voters"),
    )


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are, else code page 1252."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin)


def zipped_json(spark: SparkSession, path: str, schema: str, inside: str = "/bill/", key: str = "id") -> DataFrame:
    """JSON members of zip files whose name has ``inside`` in it, one row each; of equal keys the last member stays."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, name in enumerate(z.namelist()):
                        if inside in f"/{name}" and name.endswith(".json"):
                            yield pd.DataFrame({"_path": [path], "_i": [i], "json": [z.read(name).decode()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    docs = files.mapInPandas(members, "_path string, _i long, json string").withColumn("d", F.from_json("json", schema))
    last = F.max_by("d", F.struct("_path", "_i")).alias("d")
    return docs.groupBy(F.col(f"d.{key}").alias("_key")).agg(last).select("d.*")
