"""A training corpus from raw documents in five stages, each one operator of the library, each on all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import lines, minhash, mixing, packing, quality
from agora.llm.catalog import tokenizer_path
from agora.llm.common import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list or its base rule rejects go, null and empty texts among them.

    Repeated rows are judged each. Without labels only the base rule rejects; an empty table gives none.
    """
    ws = Workspace(spark, "pipeline-quality")
    return quality.filter_documents(docs, quality.learn_from_texts(docs, table(spark, sf_dir, "labels"), ws))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A source's boilerplate lines go; n_chars follows the text. No document goes: null texts stay null, repeated rows stay."""
    out = lines.drop_lines(docs, Workspace(spark, "pipeline-lines"), site=F.col("source"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id; of rows with equal ids one.

    Texts without words, null or not, are nobody's copies and stay, as rows with a null id do.
    """
    return minhash.keep_one(docs, Workspace(spark, "pipeline-dedup"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: none, one or two rows each.

    Texts without words are taken at their source's rate too; a null source is one source; repeated rows are taken each.
    """
    return mixing.mix_documents(docs, Workspace(spark, "pipeline-mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null or empty text is a piece of one id."""
    return packing.pack(docs, Workspace(spark, "pipeline-pack"), tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learning, rounding at random and packing have no SQL; the tests look at columns, ids and empty input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of ``sf_dir``; each result is written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
