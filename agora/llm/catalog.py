"""The queries of the subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, lines, lm, minhash, mixing, neighbours, packing, passages, quality, secrets, toxicity, warc, whitening
from .common import Workspace, table

Query = Callable[[SparkSession, str], DataFrame]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "op6")
    measured = quality.measured(docs, ws)
    return quality.verdicts(measured, quality.learn(measured, table(spark, sf_dir, "labels"), ws))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express: its statistics and its base rule."""
    measured = quality.measured(table(spark, sf_dir, "documents"), Workspace(spark, "op6"))
    return quality.verdicts(measured, quality.DecisionList()).drop("kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.cleaned(table(spark, sf_dir, "documents"), Workspace(spark, "op8"))
    return out.select("row.doc_id", "row.source", "n_lines", "n_dropped", "text")


def host_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's operator by host: the lines of the pages' html."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))
    return lines.cleaned(pages, Workspace(spark, "host-lines")).select("row.page_id", "n_lines", "n_dropped", "text")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op5"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op2"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), Workspace(spark, "op3"))
    return warc.read(archives)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), Workspace(spark, "op7"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Workspace(spark, "op9"), tokenizer_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.copies(table(spark, sf_dir, "documents"), Workspace(spark, "op10"))
    return mix.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), Workspace(spark, "op11"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), Workspace(spark, "op12"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), Workspace(spark, "op13"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    all_of = (op1_secrets, op2_toxicity, op3_warc, op4_repeated_passages, op5_near_dedup, op6_quality_rules, quality_statistics, op7_nearest, op8_line_dedup, host_line_dedup, op9_packing, op10_mixing, op11_lm_scores, op12_alignment, op13_whitening)
    return {f.__name__: f for f in all_of}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

QUALITY_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) >= 8)
), repeated AS (
  SELECT doc_id, unnest(range(i, i + 8)) AS place
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM repeated GROUP BY doc_id
), text_lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM base
), counts AS (
  SELECT b.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(b.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(b.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b JOIN text_lines USING (doc_id) LEFT JOIN covered c USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
"""

LINES_SQL = r"""
WITH split AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS x FROM documents
), held AS (
  SELECT DISTINCT doc_id, source, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line
  FROM (SELECT doc_id, source, unnest(x) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
hot AS (
  SELECT h.source, list(line) AS lines FROM (SELECT source, line, count(*) AS n FROM held GROUP BY ALL) h
  JOIN totals t ON h.source IS NOT DISTINCT FROM t.source WHERE n >= 2 AND n > 0.05 * total GROUP BY h.source
), kept AS (
  SELECT s.doc_id, s.source, s.x, s.text,
    list_filter(s.x, lambda l: NOT coalesce(list_contains(hot.lines, trim(l, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), false)) AS k
  FROM split s LEFT JOIN hot ON s.source IS NOT DISTINCT FROM hot.source
)
SELECT doc_id, source, coalesce(len(x), 1)::BIGINT AS n_lines, coalesce(len(x) - len(k), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(k, chr(10)), '') END AS text
FROM kept
"""

_HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
HOST_LINES_SQL = f"WITH documents AS (SELECT page_id AS doc_id, {_HOST} AS source, html AS text FROM pages) SELECT doc_id AS page_id, n_lines, n_dropped, text FROM ({LINES_SQL})"

NEAR_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS s FROM base
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM sets JOIN least ON doc_id = a
"""


def oracle_sql() -> dict[str, str]:
    return {"quality_statistics": QUALITY_SQL, "op8_line_dedup": LINES_SQL, "host_line_dedup": HOST_LINES_SQL, "op5_near_dedup": NEAR_SQL}
