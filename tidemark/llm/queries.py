"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fusion, language, leakage, provenance, stripes, tokenizer
from tidemark.operators.heavy import number_within_key
from tidemark.session import spread, table


def tokenizer_file(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file: folder spark.tidemark.tokenizers, or where the box keeps them."""
    folder = spark.conf.get("spark.tidemark.tokenizers", "/opt/tokenizers")
    if not os.path.exists(os.path.join(folder, name)):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.foreign_files(table(spark, folder, "texts"), table(spark, folder, "file_stats"))


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.origins(table(spark, folder, "texts"), table(spark, folder, "file_stats"))


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.fused_scores(table(spark, folder, "file_stats"), "module", "path", fusion.file_scores())


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.top_of_group(_fused(spark, folder), "module", "path")


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All files, numbered within their module by the fused score."""
    fused = _fused(spark, folder).select("module", "path", "fused", (-F.col("fused")).alias("__down"))
    return number_within_key(fused, "module", ["__down", "path"], "place", "of").select("module", "path", F.round("fused", 6).alias("fused"), "place", "of")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return stripes.strong_partners(table(spark, folder, "change_items"), table(spark, folder, "changes"))


def p5_partners(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs that share a counted change, with degree, lift and log-likelihood ratio."""
    rows = stripes.partners(table(spark, folder, "change_items"), table(spark, folder, "changes"))
    return rows.select("item_a", "item_b", "shared", "changes_a", "changes_b", "counted_a", "counted_b", F.round("degree", 6).alias("degree"), F.round("lift", 4).alias("lift"), F.round("llr", 3).alias("llr"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(table(spark, folder, "documents"), tokenizer.ByteBpe.read(tokenizer_file(spark)))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Texts decoded from their ids."""
    bpe = tokenizer.ByteBpe.read(tokenizer_file(spark))
    return tokenizer.encode(table(spark, folder, "documents"), bpe).select("doc_id", F.size("ids").cast("long").alias("n_ids"), bpe.decode(F.col("ids")).alias("text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_shares(spark, folder).select("doc_id", "item_id")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(table(spark, folder, "documents"))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of all documents, each with its language and confidence."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    found = language.identify(spread(docs.select("doc_id", "text"), "doc_id"), language.fit(docs))
    rows = found.select("doc_id", F.posexplode("segments").alias("place", "s"))
    return rows.select("doc_id", "place", F.col("s.lang").alias("lang"), F.round("s.confidence", 4).alias("confidence"), F.col("s.sentences").alias("sentences"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_reasons, p4_found, p4_ranking, p5_found, p5_partners, p6_ids, p6_decoded, p7_found, p7_shares, p8_found, p8_segments)
}

_FUSED = """
WITH f AS (
  SELECT module AS g, path AS i, max(revisions)::DOUBLE AS revisions, max(loc)::DOUBLE AS loc, max(complexity.total)::DOUBLE AS complexity, max(score) AS score
  FROM file_stats WHERE module IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2
), l AS (UNPIVOT f ON revisions, loc, complexity, score INTO NAME s VALUE x), m AS (
  SELECT g, s, quantile_disc(x, 0.5) AS m FROM l GROUP BY 1, 2
), d AS (
  SELECT l.g, l.s, quantile_disc(abs(x - m), 0.5) AS mad, avg(abs(x - m)) AS ad FROM l JOIN m ON l.g = m.g AND l.s = m.s GROUP BY 1, 2
), z AS (
  SELECT l.g, l.i, l.s, CASE WHEN mad > 0 THEN (x - m) / (mad * 1.4826) WHEN ad > 0 THEN (x - m) / (ad * 1.2533) ELSE 0 END AS z
  FROM l JOIN m ON l.g = m.g AND l.s = m.s JOIN d ON l.g = d.g AND l.s = d.s
), b AS (SELECT g, i, greatest(1e-6, 1 / (1 + exp(-z))) AS n FROM z), w AS (
  SELECT f.g, f.i, exp((coalesce(sum(ln(n)), 0) + (4 - count(n)) * ln(1e-9)) / 4) AS fused FROM f LEFT JOIN b ON f.g = b.g AND f.i = b.i GROUP BY 1, 2
)"""

_PAIRS = """
WITH held AS (SELECT DISTINCT change_id, item FROM change_items WHERE change_id IS NOT NULL AND item IS NOT NULL),
valid AS (SELECT DISTINCT change_id FROM changes WHERE size <= 50 AND change_id IS NOT NULL), used AS (SELECT * FROM held WHERE change_id IN (SELECT change_id FROM valid)),
stats AS (SELECT item, count(*) AS n, count(*) FILTER (change_id IN (SELECT change_id FROM valid)) AS c FROM held GROUP BY 1),
pairs AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS shared FROM used x JOIN used y ON x.change_id = y.change_id AND x.item < y.item GROUP BY 1, 2),
wide AS (
  SELECT item_a, item_b, shared, a.n AS changes_a, b.n AS changes_b, a.c AS counted_a, b.c AS counted_b, (SELECT count(*) FROM valid) AS total
  FROM pairs JOIN stats a ON a.item = item_a JOIN stats b ON b.item = item_b
)"""

SQL = {
    "p4_found": _FUSED
    + """
SELECT module, path FROM (
  SELECT g AS module, i AS path, row_number() OVER (PARTITION BY g ORDER BY fused DESC, i) AS k, count(*) OVER (PARTITION BY g) AS n FROM w
) WHERE k = 1 AND n >= 20""",
    "p4_ranking": _FUSED
    + """
SELECT g AS module, i AS path, round(fused, 6) AS fused, row_number() OVER (PARTITION BY g ORDER BY fused DESC, i) AS place, count(*) OVER (PARTITION BY g) AS of FROM w""",
    "p5_found": _PAIRS
    + """
SELECT item_a, item_b FROM wide WHERE shared >= 3 AND 20 * shared >= 3 * (changes_a + changes_b) AND shared * total >= 2 * counted_a * counted_b""",
    "p5_partners": _PAIRS
    + """, cells AS (
  SELECT *, (counted_a - shared)::DOUBLE AS k12, (counted_b - shared)::DOUBLE AS k21, (total - counted_a - counted_b + shared)::DOUBLE AS k22 FROM wide
)
SELECT item_a, item_b, shared, changes_a, changes_b, counted_a, counted_b, round(2 * shared / (changes_a + changes_b), 6) AS degree,
  round(shared * total / (counted_a * counted_b), 4) AS lift,
  round(greatest(0, 2 * (shared * ln(shared / (counted_a * counted_b / total))
    + CASE WHEN k12 > 0 THEN k12 * ln(k12 / (counted_a * (total - counted_b) / total)) ELSE 0 END
    + CASE WHEN k21 > 0 THEN k21 * ln(k21 / (counted_b * (total - counted_a) / total)) ELSE 0 END
    + CASE WHEN k22 > 0 THEN k22 * ln(k22 / ((total - counted_a) * (total - counted_b) / total)) ELSE 0 END)), 3) AS llr
FROM cells""",
}
