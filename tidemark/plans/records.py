"""Queries on commits, texts, paths and streams, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths, subjects
from tidemark.functions.numbers import rounded
from tidemark.operators import coupling, graph, grouping, lineage, mechanical, textual
from tidemark.plans.measures import PRELUDE, history_of, import_edges
from tidemark.plans.shaping import STRICT
from tidemark.session import durable, table
from tidemark.streaming import activity


def subject_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "commits").where(F.col("sha").isNotNull()).select("sha", "subject").distinct()
    s = F.col("subject")
    return rows.select("sha", subjects.subject_kind(s).alias("kind"), subjects.pull_request_of(s).alias("pull_request"), subjects.ticket_of(s).alias("ticket"))


def path_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "commit_files").where(F.col("path").isNotNull()).select("path").distinct()
    p = F.col("path")
    return rows.select(
        "path", paths.extension_of(p).alias("extension"), paths.directory_of(p).alias("directory"), F.size(paths.directories_of(p)).cast("long").alias("depth"),
        paths.is_source(p).alias("source"), paths.is_contract(p).alias("contract"), paths.is_test(p).alias("test"), paths.is_config(p).alias("config"), paths.is_indentation_significant(p).alias("indented"),
    )


def glob_matches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "commit_files").where(F.col("path").isNotNull()).select("path").distinct()
    return rows.where(paths.matches_any(F.col("path"), ["packages/*/src/**/*.ts", "tools/**", "CHANGELOG.md"]))


def complexity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "texts").where(F.col("item").isNotNull()).select("item", "text").distinct()
    c = rows.select("item", textual.complexity(F.col("text")).alias("c"))
    return c.select("item", "c.loc", "c.total", rounded("c.mean").alias("mean"), "c.max")


def accepted_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "texts").where(F.col("item").isNotNull()).select("item", "text").distinct()
    return rows.where(paths.is_source(F.col("item")) & textual.accepted(F.col("text"))).select("item").distinct()


def copy_families(spark: SparkSession, folder: str) -> DataFrame:
    history, texts = history_of(spark, folder), table(spark, folder, "texts")
    families = durable(textual.copy_families(coupling.couplings(history), texts))
    return textual.family_facts(families, texts, history).withColumn("files", F.array_join("files", " "))


def package_of(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "commit_files").where(F.col("path").isNotNull()).select("path")
    homes = table(spark, folder, "manifests").where(F.col("path").isNotNull()).select(paths.directory_of(F.col("path")).alias("directory"))
    return textual.nearest_ancestor(files, homes)


def workspace_names(spark: SparkSession, folder: str) -> DataFrame:
    """Importable package names with the number of packages that carry them; more than one is ambiguous."""
    from tidemark.operators.manifests import packages

    rows = packages(table(spark, folder, "manifests")).where(F.col("name").isNotNull())
    return rows.groupBy("name").agg(F.count_distinct("manifest_id").alias("packages"))


def _commits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "commits"), table(spark, folder, "commit_files")


def logical_changes(spark: SparkSession, folder: str) -> DataFrame:
    commits, files = _commits(spark, folder)
    return grouping.change_table(grouping.logical_changes(commits, files), commits, files)


def ticket_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Commits of one subject within two weeks of the first such commit: anchored runs."""
    rows = mechanical.commit_rows(table(spark, folder, "commits")).select("sha", "time_s", "subject")
    runs = grouping.runs_of(rows, "subject")
    return runs.groupBy("group").agg(F.count(F.lit(1)).alias("commits"), F.min("sha").alias("first")).select("first", "commits")


def cliques(spark: SparkSession, folder: str) -> DataFrame:
    pairs = coupling.area_pairs(coupling.ranked_touched(history_of(spark, folder)))
    rows = graph.area_cliques(pairs, min_share=0.1)
    return rows.select(F.array_join("members", " ").alias("members"), "size", "partial")


def import_reach(spark: SparkSession, folder: str) -> DataFrame:
    return graph.reach(import_edges(spark, folder), 3).select("start", "node", F.col("hops").cast("long").alias("hops"))


def import_components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(import_edges(spark, folder), "src", "dst")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    stream = activity.table_stream(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return activity.drain(activity.windowed_activity(stream, "ts", "event_type"), mode="complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events")


QUERIES = {
    "subject_kind": subject_kinds,
    "path_facts": path_facts,
    "glob_matches": glob_matches,
    "complexity": complexity,
    "accepted_sources": accepted_sources,
    "copy_families": copy_families,
    "package_of": package_of,
    "workspace_names": workspace_names,
    "named_reverts": lambda spark, folder: mechanical.named_reverts(table(spark, folder, "commits")),
    "confirmed_reverts": lambda spark, folder: mechanical.confirmed_reverts(*_commits(spark, folder)),
    "duplicate_commits": lambda spark, folder: mechanical.duplicates(*_commits(spark, folder)),
    "mechanical_kinds": lambda spark, folder: mechanical.kind_counts(*_commits(spark, folder)),
    "logical_changes": logical_changes,
    "anchored_runs": ticket_runs,
    "lineage": lambda spark, folder: lineage.lives(*reversed(_commits(spark, folder))),
    "rename_families": lambda spark, folder: lineage.renamed_names(table(spark, folder, "commit_files")),
    "import_reach": import_reach,
    "import_components": import_components,
    "cliques": cliques,
    "stream_windows": stream_windows,
}

_FIRST = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY recorded_at, log_pos) AS k FROM commits WHERE sha IS NOT NULL) WHERE k = 1),
files AS (SELECT sha, path, max(blob_old) AS blob_old, max(blob_new) AS blob_new FROM commit_files WHERE sha IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
named AS (SELECT sha AS revert, reverts AS original FROM firsts WHERE reverts IS NOT NULL AND reverts <> sha AND reverts IN (SELECT sha FROM firsts)),
undone AS (
  SELECT revert, original, count(*) AS files FROM (
    SELECT coalesce(m.revert, t.revert) AS revert, coalesce(m.original, t.original) AS original, coalesce(m.blob_old = t.blob_new AND m.blob_new = t.blob_old, false) AS ok
    FROM (SELECT revert, original, path, blob_old, blob_new FROM named JOIN files ON sha = revert) m
    FULL JOIN (SELECT revert, original, path, blob_old, blob_new FROM named JOIN files ON sha = original) t
    ON m.revert = t.revert AND m.original = t.original AND m.path = t.path)
  GROUP BY 1, 2 HAVING bool_and(ok)),
lists AS (
  SELECT sha, list(struct_pack(p := path, o := coalesce(blob_old, ''), n := blob_new) ORDER BY path)::VARCHAR AS l FROM files GROUP BY 1 HAVING bool_and(blob_new IS NOT NULL)),
twice AS (
  SELECT sha, first FROM (SELECT l.sha, first_value(l.sha) OVER (PARTITION BY l ORDER BY time_s, log_pos DESC, l.sha) AS first FROM lists l JOIN firsts USING (sha)) WHERE sha <> first)"""
_EXT = "lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1))"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_CONTRACT = f"({_EXT} IN {_IN(paths.CONTRACT_EXTENSIONS)} OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(\\.schema\\.json|^(openapi|asyncapi|swagger)\\.(.+\\.)?(ya?ml|json))$', 'i'))"
_STEM = "regexp_replace(path, '([^/])\\.[^./]*$', '\\1')"

SQL = {
    "subject_kind": r"""SELECT DISTINCT sha, CASE
  WHEN regexp_matches(subject, '^(fix|hotfix|bugfix|revert)(\(.+\))?!?:', 'i') OR regexp_matches(subject, '^Revert "')
    OR (lower(regexp_extract(subject, '^[A-Za-z]+')) IN ('fix', 'fixes', 'fixed', 'fixing', 'bug', 'bugfix', 'hotfix') AND NOT regexp_matches(subject, '^bug[\s#-]*\d', 'i'))
    OR (regexp_matches(subject, '^[a-z][a-z0-9._/-]*:\s*(fix|fixes|fixed)\b') AND NOT regexp_matches(subject, '^(feat|docs|style|refactor|perf|tests?|build|ci|chore)(\(.+\))?!?:', 'i')) THEN 'fix'
  WHEN regexp_matches(subject, '^(feat|docs|style|refactor|perf|tests?|build|ci|chore)(\(.+\))?!?:', 'i') THEN 'convention' ELSE 'other' END AS kind,
  nullif(regexp_extract(subject, '\(#(\d+)\)\s*$', 1), '') AS pull_request,
  list_filter(regexp_extract_all(' ' || subject, '[^A-Za-z0-9]([A-Z][A-Z0-9]+-\d+)\b', 1), lambda k: regexp_extract(k, '^(.*)-\d+$', 1) NOT IN """
    + _IN(subjects.NOT_TICKETS)
    + r""")[1] AS ticket
FROM commits WHERE sha IS NOT NULL""",
    "path_facts": f"""SELECT path, {_EXT} AS extension, regexp_replace(path, '/?[^/]*$', '') AS directory, len(string_split(path, '/')) - 1 AS depth,
  {_EXT} IN {_IN(paths.SOURCE_EXTENSIONS)} AS source, {_CONTRACT} AS contract,
  NOT {_CONTRACT} AND (regexp_matches({_STEM}, '(\\.test|\\.spec|_test|_spec)$') OR list_has_any(list_slice(string_split(path, '/'), 1, -2), [{', '.join(f"'{d}'" for d in paths.TEST_DIRECTORIES)}])) AS test,
  regexp_matches(path, '\\.config\\.[cm]?[jt]s$') AS config,
  {_EXT} IN {_IN(paths.INDENTED_EXTENSIONS)} OR regexp_extract(path, '([^/]*)$', 1) IN {_IN(paths.INDENTED_NAMES)} AS indented
FROM (SELECT DISTINCT path FROM commit_files WHERE path IS NOT NULL)""",
    "glob_matches": "SELECT DISTINCT path FROM commit_files WHERE regexp_matches(path, '^packages/[^/]*/src/(.*/)?[^/]*\\.ts$') OR path LIKE 'tools/%' OR path = 'CHANGELOG.md'",
    "complexity": r"""SELECT item, loc, total, CASE WHEN loc IS NULL THEN NULL WHEN loc = 0 THEN 0 ELSE floor(total / loc * 10000 + 0.5) / 10000 END AS mean, max FROM (
  WITH t AS (SELECT DISTINCT item, text FROM texts WHERE item IS NOT NULL), i AS (
    SELECT item, text, list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S')), lambda l: regexp_extract(l, '^[\t ]*')) AS ind FROM t),
  s AS (SELECT item, text, list_transform(ind, lambda x: length(replace(x, ' ', ''))) AS tabs, list_transform(ind, lambda x: length(replace(x, chr(9), ''))) AS sp FROM i),
  r AS (SELECT *, list_filter(list_transform(range(2, len(sp) + 1), lambda k: sp[k] - sp[k - 1]), lambda d: d > 0) AS rises FROM s),
  u AS (SELECT *, least(8, greatest(2, coalesce(-list_max(list_transform(list_distinct(rises), lambda d: {'n': len(list_filter(rises, lambda x: x = d)), 'd': -d})).d, 4))) AS unit FROM r),
  v AS (SELECT *, list_transform(range(1, len(sp) + 1), lambda k: tabs[k] + sp[k] // unit) AS lv FROM u)
  SELECT item, len(lv) AS loc, CASE WHEN text IS NOT NULL THEN coalesce(list_sum(lv), 0) END::BIGINT AS total, CASE WHEN text IS NOT NULL THEN coalesce(list_max(lv), 0) END::BIGINT AS max FROM v)""",
    "accepted_sources": f"""SELECT DISTINCT item FROM (SELECT item, item AS path, text FROM texts WHERE item IS NOT NULL)
WHERE {_EXT} IN {_IN(paths.SOURCE_EXTENSIONS)} AND strlen(text) <= 1048576 AND length(text) <= 300 * len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S')))""",
    "package_of": """SELECT path, arg_max(directory, depth) AS home FROM (
  WITH p AS (SELECT DISTINCT path FROM commit_files WHERE path IS NOT NULL), h AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS directory FROM manifests WHERE path IS NOT NULL)
  SELECT p.path, h.directory, len(string_split(h.directory, '/')) AS depth FROM p LEFT JOIN h ON starts_with(p.path, h.directory || '/')) GROUP BY path""",
    "workspace_names": """SELECT name, count(DISTINCT manifest_id) AS packages FROM (
  SELECT manifest_id, CASE WHEN json_type(body, '$.name') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN body ->> '$.name' END AS name FROM (SELECT * FROM manifests WHERE {strict}))
WHERE name IS NOT NULL GROUP BY 1""",
    "named_reverts": f"WITH {_FIRST} SELECT revert, original FROM named",
    "confirmed_reverts": f"WITH {_FIRST} SELECT revert, original, files FROM undone",
    "duplicate_commits": f"WITH {_FIRST} SELECT sha, first FROM twice",
    "mechanical_kinds": f"""WITH {_FIRST}, k AS (
  SELECT CASE WHEN move_only THEN 'moves' WHEN sha IN (SELECT revert FROM undone UNION SELECT original FROM undone) THEN 'reverts' WHEN sha IN (SELECT sha FROM twice) THEN 'duplicates' END AS kind FROM firsts)
SELECT 0::BIGINT AS ignored, 0::BIGINT AS whitespace, count(*) FILTER (kind = 'moves') AS moves, count(*) FILTER (kind = 'reverts') AS reverts, count(*) FILTER (kind = 'duplicates') AS duplicates, count(*) FILTER (kind IS NULL) AS real FROM k""",
    "anchored_runs": f"""WITH RECURSIVE {_FIRST}, times AS (SELECT DISTINCT subject, time_s FROM firsts WHERE subject IS NOT NULL), run AS (
  SELECT subject, min(time_s) AS first FROM times GROUP BY 1
  UNION ALL
  SELECT r.subject, (SELECT min(time_s) FROM times t WHERE t.subject = r.subject AND t.time_s > r.first + 1209600) FROM run r
  WHERE EXISTS (SELECT 1 FROM times t WHERE t.subject = r.subject AND t.time_s > r.first + 1209600))
SELECT min(sha) AS first, count(*) AS commits FROM (
  SELECT sha, f.subject, (SELECT max(first) FROM run r WHERE r.subject = f.subject AND r.first <= f.time_s) AS start FROM firsts f WHERE subject IS NOT NULL) GROUP BY subject, start""",
    "import_reach": PRELUDE
    + """, hop AS (SELECT DISTINCT src AS s, dst AS d FROM edges WHERE src <> dst), r1 AS (SELECT s, d, 1 AS hops FROM hop),
r2 AS (SELECT r1.s, hop.d, 2 AS hops FROM r1 JOIN hop ON r1.d = hop.s WHERE r1.s <> hop.d), r3 AS (SELECT r2.s, hop.d, 3 AS hops FROM r2 JOIN hop ON r2.d = hop.s WHERE r2.s <> hop.d)
SELECT s AS start, d AS node, min(hops)::BIGINT AS hops FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY 1, 2""",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
SQL["workspace_names"] = SQL["workspace_names"].replace("{strict}", STRICT)


def import_scan(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import imports

    texts = table(spark, folder, "texts")
    return imports.resolved(imports.scan(texts), texts.where(F.col("item").isNotNull()).select(F.col("item").alias("path")))


def link_couplings(spark: SparkSession, folder: str) -> DataFrame:
    """What imports say about each coupled pair, by a scan of the texts."""
    from tidemark.operators import imports

    texts = table(spark, folder, "texts")
    found = import_scan(spark, folder)
    links = found.where("state = 'file'").select(F.col("item").alias("src"), F.col("target").alias("dst"))
    pairs = coupling.couplings(history_of(spark, folder)).select("a", "b")
    return imports.linked_pairs(pairs, links, imports.complete_files(imports.scan(texts), texts, found))


def module_depth(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import exports, modules

    history = history_of(spark, folder)
    files = history.facts().select(F.col("path").alias("item"), F.col("module").alias("area"), "test", "loc")
    entries = modules.entry_points(history, globs=["**/src/**/read-*.ts", "**/src/**/read_*.ts"])
    return exports.module_depth(table(spark, folder, "texts"), files, entries)


def exported_names(spark: SparkSession, folder: str) -> DataFrame:
    """What every scanned file exports, stars and re-exports followed."""
    from tidemark.operators import exports

    texts = table(spark, folder, "texts")
    return exports.visible_exports(texts, texts.where(F.col("item").isNotNull()).select(F.col("item").alias("path")))[0]


def life_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Activity of today's files: renames followed, earlier files of a name and mechanical commits left out."""
    from tidemark.operators import hotspots

    commits, files = _commits(spark, folder)
    return hotspots.item_activity(files, commits, history_of(spark, folder), mechanical.kinds(commits, files), lineage.lives(files, commits))


def entry_points(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import entries

    return entries.entry_points(history_of(spark, folder), import_edges(spark, folder), texts=table(spark, folder, "texts"))


def inspected(spark: SparkSession, folder: str) -> DataFrame:
    """The couplings of one package's sources, as a report's slice shows them."""
    from tidemark.plans import report

    history = history_of(spark, folder)
    tables = {"files": report.hotspots.hotspot_scores(history).select("path", "module"), "couplings": coupling.couplings(history)}
    return report.inspect(tables, ["packages/summit-dispatch-registry/src/**"])["couplings"].select("a", "b", "shared")


QUERIES |= {"import_scan": import_scan, "link_couplings": link_couplings, "module_depth": module_depth, "exported_names": exported_names, "life_activity": life_activity, "entry_points": entry_points, "inspect": inspected}

_NAMES = """sources AS (SELECT item AS path, min(text) AS text FROM texts WHERE item IS NOT NULL AND text IS NOT NULL GROUP BY 1),
shown AS (
  SELECT path, unnest(regexp_extract_all(text, '(?m)^export\\s+(?:declare\\s+)?(?:abstract\\s+)?(?:async\\s+)?(?:const|let|var|function\\*?|class|interface|type|enum|namespace)\\s+([\\w$]+)', 1)) AS name FROM sources
  UNION SELECT path, 'default' FROM sources WHERE regexp_matches(text, '(?m)^export\\s+default\\b')
  UNION SELECT path, regexp_extract(x, '([\\w$]+)\\s*$', 1) FROM (SELECT path, unnest(flatten(list_transform(regexp_extract_all(text, '(?m)^export\\s+(?:type\\s+)?\\{([^}]*)\\}', 1), lambda g: string_split(g, ',')))) AS x FROM sources)),
names AS (SELECT path, name FROM shown WHERE name <> '' AND lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('ts', 'tsx', 'mts', 'cts', 'js', 'jsx', 'mjs', 'cjs'))"""
# the given texts hand nothing on, so a name's binding is its own file's
SQL["exported_names"] = f"WITH {_NAMES} SELECT path AS file, name, path || '#' || name AS binding FROM names"
SQL["module_depth"] = PRELUDE + f""", {_NAMES},
entries AS (SELECT path, module AS area FROM facts WHERE NOT test AND NOT regexp_matches(path, '\\.config\\.[cm]?[jt]s$') AND regexp_matches(path, '(^|/)src/(.*/)?read[-_][^/]*\\.ts$')),
behind AS (SELECT module AS area, sum(coalesce(loc, 0))::BIGINT AS lines FROM facts WHERE NOT test AND NOT regexp_matches(path, '\\.config\\.[cm]?[jt]s$') AND path NOT IN (SELECT path FROM entries) GROUP BY 1)
SELECT area, exports, lines, floor(lines / exports * 10000 + 0.5) / 10000 AS depth FROM (
  SELECT area, count(DISTINCT name) AS exports FROM entries JOIN names USING (path)
  WHERE area NOT IN (SELECT area FROM entries LEFT JOIN sources USING (path) WHERE text IS NULL) GROUP BY 1) JOIN behind USING (area) WHERE lines > 0"""
SQL["inspect"] = PRELUDE + """, focus AS (SELECT path FROM facts WHERE path LIKE 'packages/summit-dispatch-registry/src/%')
SELECT a, b, shared FROM coupled WHERE a IN (SELECT path FROM focus) OR b IN (SELECT path FROM focus)"""


def territory_tree(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import territories

    return territories.territories(history_of(spark, folder))


def territory_fit(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import territories

    history = history_of(spark, folder)
    tree = territories.territories(history)
    return territories.containment(history, tree, territories.recommended_level(tree))


def directory_facts(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import territories

    return territories.directory_facts(history_of(spark, folder)).select("directory", "parent", "files", "changes", "single", "folders", "heat")


def detected_modules(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import territories

    homes = table(spark, folder, "manifests").where(F.col("path").isNotNull()).select(paths.directory_of(F.col("path")).alias("directory"))
    return territories.detect_modules(table(spark, folder, "commit_files").select("path"), homes)


QUERIES |= {"territory_tree": territory_tree, "territory_fit": territory_fit, "directory_facts": directory_facts, "detected_modules": detected_modules}

SQL["directory_facts"] = PRELUDE + """, ups AS (
  SELECT path, list_concat(['.'], list_transform(range(1, len(string_split(path, '/'))::BIGINT), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS up FROM facts),
flat AS (SELECT path, up[i] AS directory, coalesce(up[i + 1], '') AS part FROM ups, range(1, 40) r(i) WHERE i <= len(up)),
parts AS (SELECT DISTINCT change_id, directory, part FROM used JOIN flat ON path = item),
eachc AS (SELECT directory, change_id, count(*) AS n FROM parts GROUP BY 1, 2)
SELECT directory, CASE WHEN directory = '.' THEN NULL ELSE coalesce(nullif(regexp_replace(directory, '/?[^/]*$', ''), ''), '.') END AS parent, files,
  coalesce(changes, 0) AS changes, coalesce(single, 0) AS single, coalesce(folders, 0) AS folders, heat
FROM (SELECT directory, count(*) AS files, sum(production_heat)::BIGINT AS heat FROM flat JOIN heats USING (path) GROUP BY 1)
LEFT JOIN (SELECT directory, count(*) AS changes, count(*) FILTER (n = 1) AS single FROM eachc GROUP BY 1) USING (directory)
LEFT JOIN (SELECT directory, count(DISTINCT part) AS folders FROM parts WHERE part <> '' GROUP BY 1) USING (directory)"""


def clique_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of modules that changes touched as a whole, without variants of each other."""
    from tidemark.operators import groups

    touched = durable(coupling.ranked_touched(history_of(spark, folder)))
    rows = groups.clique_groups(touched, coupling.area_pairs(touched), min_share=0.1)
    return rows.select(F.array_join("members", " ").alias("members"), "shared", "partial")


QUERIES |= {"clique_groups": clique_groups}


_COMPONENTS = """WITH RECURSIVE {edges}, both_ways AS (SELECT a, b FROM linked WHERE a <> b UNION SELECT b, a FROM linked WHERE a <> b),
reached AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT b, root FROM reached JOIN both_ways ON a = node)
SELECT node AS {node}, min(root) AS {root} FROM reached GROUP BY 1"""
SQL["rename_families"] = _COMPONENTS.format(edges="linked AS (SELECT DISTINCT renamed_from AS a, path AS b FROM commit_files WHERE renamed_from IS NOT NULL AND path IS NOT NULL)", node="name", root="family")
SQL["import_components"] = PRELUDE + _COMPONENTS.format(edges=", linked AS (SELECT src AS a, dst AS b FROM edges)", node="node", root="component").removeprefix("WITH RECURSIVE ")
# the given tables have no module that holds more than 70 % of the files, so nothing is split further
SQL["detected_modules"] = """WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM commit_files WHERE path IS NOT NULL),
h AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS directory FROM manifests WHERE path IS NOT NULL),
near AS (SELECT path, any_value(parts) AS parts, arg_max(directory, len(string_split(directory, '/'))) AS home FROM p LEFT JOIN h ON starts_with(path, directory || '/') GROUP BY path),
cuts AS (SELECT i, array_to_string(parts[1:i], '/') AS directory FROM near, range(1, 40) r(i) WHERE home IS NULL AND i < len(parts)),
depth AS (SELECT coalesce(min(i), 1) AS d FROM (SELECT i FROM cuts GROUP BY i HAVING count(DISTINCT directory) >= 2))
SELECT path, coalesce(home, CASE WHEN len(parts) = 1 THEN '.' ELSE array_to_string(parts[1:least(d, len(parts) - 1)], '/') END) AS module FROM near, depth"""
