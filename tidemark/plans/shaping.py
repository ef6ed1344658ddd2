"""Queries of the general record-shaping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import manifests, revisions
from tidemark.operators.heavy import number_within_key
from tidemark.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.targets(table(spark, folder, "manifests"))


def p2_packages(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.packages(table(spark, folder, "manifests"))


def p2_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return manifests.dependencies(table(spark, folder, "manifests"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    return revisions.path_activity(t("commit_files"), t("commits"), t("change_items"), t("changes"))


def p3_lines_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct (path, sha) numbered within its path, whatever the path's size."""
    rows = table(spark, folder, "commit_files").where(F.col("path").isNotNull()).select("path", "sha").distinct()
    return number_within_key(rows, "path", ["sha"], "n", "of")


QUERIES = {"p2_found": p2_found, "p2_packages": p2_packages, "p2_dependencies": p2_dependencies, "p3_found": p3_found, "p3_lines_numbered": p3_lines_numbered}

#: The oracle's parser accepts trailing commas, which the strict grammar does not.
STRICT = r"""body IS NOT NULL AND json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) = 'OBJECT'
  AND NOT regexp_matches(regexp_replace(body, '"([^"\\]|\\.)*"', '""', 'g'), ',\s*[}\]]')"""

SQL = {
    "p2_found": """
WITH RECURSIVE records AS (
  SELECT DISTINCT manifest_id, body::JSON AS j FROM manifests
  WHERE {strict}
), walk AS (
  SELECT manifest_id, j -> '$.exports' AS v, 'exports' AS json_path, CAST(NULL AS VARCHAR) AS first, 0 AS depth
  FROM records WHERE json_type(j -> '$.exports') IS NOT NULL
  UNION ALL
  SELECT w.manifest_id,
         CASE WHEN json_type(w.v) = 'ARRAY' THEN json_extract(w.v, '$[' || c.key || ']')
              ELSE json_extract(w.v, '$."' || c.key || '"') END,
         w.json_path || ' > ' || c.key, coalesce(w.first, c.key), w.depth + 1
  FROM walk w, LATERAL (SELECT unnest(CASE json_type(w.v) WHEN 'OBJECT' THEN json_keys(w.v)
    WHEN 'ARRAY' THEN list_transform(range(json_array_length(w.v)::BIGINT), lambda i: i::VARCHAR) ELSE [] END) AS key) c
  WHERE w.depth < 8 AND json_type(w.v) IN ('OBJECT', 'ARRAY')
), dotted AS (
  SELECT manifest_id, json_type(j -> '$.exports') = 'OBJECT' AND len(list_filter(json_keys(j -> '$.exports'), lambda k: k LIKE '.%')) > 0 AS dots
  FROM records WHERE json_type(j -> '$.exports') = 'OBJECT'
), exported AS (
  SELECT w.manifest_id, json_path, w.v ->> '$' AS target,
         CASE WHEN coalesce(dots, false) THEN coalesce(first = '.', false) ELSE true END AS root
  FROM walk w LEFT JOIN dotted USING (manifest_id) WHERE json_type(w.v) = 'VARCHAR'
), rooted AS (SELECT DISTINCT manifest_id FROM exported WHERE root), direct AS (
  SELECT r.manifest_id, f.name AS json_path, json_extract_string(j, '$.' || f.name) AS target
  FROM records r, (VALUES ('main'), ('module'), ('types')) f(name)
  WHERE json_type(json_extract(j, '$.' || f.name)) = 'VARCHAR'
)
SELECT DISTINCT manifest_id, json_path, target, root::INTEGER AS in_root FROM exported
UNION
SELECT manifest_id, json_path, target, CASE WHEN manifest_id IN (SELECT manifest_id FROM rooted) THEN 0 ELSE 1 END FROM direct""",
    "p2_packages": """
WITH records AS (
  SELECT DISTINCT manifest_id, body::JSON AS j FROM manifests
  WHERE {strict}
), s AS (
  SELECT manifest_id, f.name, json_extract(j, '$.' || f.name) AS v FROM records, (VALUES ('name'), ('version'), ('main'), ('module'), ('types')) f(name)
), t AS (SELECT manifest_id, name, CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE v ->> '$' END AS v FROM s)
SELECT manifest_id, max(v) FILTER (name = 'name') AS name, max(v) FILTER (name = 'version') AS version,
  max(v) FILTER (name = 'main') AS main, max(v) FILTER (name = 'module') AS module, max(v) FILTER (name = 'types') AS types
FROM t GROUP BY manifest_id""",
    "p2_dependencies": """
WITH records AS (
  SELECT DISTINCT manifest_id, body::JSON AS j FROM manifests
  WHERE {strict}
), f AS (
  SELECT manifest_id, f.name AS field, json_extract(j, '$.' || f.name) AS v
  FROM records, (VALUES ('dependencies'), ('devDependencies'), ('peerDependencies'), ('optionalDependencies')) f(name)
), k AS (SELECT manifest_id, field, v, unnest(json_keys(v)) AS name FROM f WHERE json_type(v) = 'OBJECT')
SELECT DISTINCT manifest_id, field, name, json_extract_string(v, '$."' || name || '"') AS range
FROM k WHERE json_type(json_extract(v, '$."' || name || '"')) = 'VARCHAR'""",
    "p3_found": """
WITH touched AS (
  SELECT path, count(DISTINCT sha) AS n FROM commit_files WHERE sha IN (SELECT sha FROM commits WHERE NOT move_only) GROUP BY path
), counted AS (SELECT DISTINCT change_id FROM changes WHERE size <= 50), held AS (
  SELECT DISTINCT change_id, item FROM change_items WHERE change_id IN (SELECT change_id FROM counted)
), wide AS (SELECT x.item AS path, count(DISTINCT y.item) AS n FROM held x JOIN held y ON x.change_id = y.change_id AND x.item <> y.item GROUP BY 1)
SELECT p.path, coalesce(touched.n, 0)::BIGINT AS revisions, coalesce(wide.n, 0)::BIGINT AS breadth
FROM (SELECT DISTINCT path FROM commit_files WHERE path IS NOT NULL) p LEFT JOIN touched USING (path) LEFT JOIN wide USING (path)""",
    "p3_lines_numbered": """
SELECT path, sha, (row_number() OVER (PARTITION BY path ORDER BY sha))::BIGINT AS n, (count(*) OVER (PARTITION BY path))::BIGINT AS "of"
FROM (SELECT DISTINCT path, sha FROM commit_files WHERE path IS NOT NULL)""",
}
SQL = {name: sql.replace("{strict}", STRICT) for name, sql in SQL.items()}
