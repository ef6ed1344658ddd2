"""Queries of the change measures over the version-control tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import coupling, hotspots, modules, trends, views
from tidemark.operators.history import History
from tidemark.session import table


def history_of(spark: SparkSession, folder: str) -> History:
    return History(table(spark, folder, "changes"), table(spark, folder, "change_items"), table(spark, folder, "file_stats"))


def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    """``src, dst``: imports that the partner report names, from either side."""
    rows = table(spark, folder, "partners").where(F.col("path").isNotNull() & F.col("partner").isNotNull())
    forward = rows.where(F.col("imports").isin("file→partner", "both")).select(F.col("path").alias("src"), F.col("partner").alias("dst"))
    backward = rows.where(F.col("imports").isin("partner→file", "both")).select(F.col("partner").alias("src"), F.col("path").alias("dst"))
    return forward.unionByName(backward).distinct()


def import_relations(spark: SparkSession, folder: str) -> DataFrame:
    """``a, b, relation``: linked, none or null (unknown) for each reported pair."""
    rows = table(spark, folder, "partners").where(F.col("path").isNotNull() & F.col("partner").isNotNull())
    by = rows.groupBy(F.least("path", "partner").alias("a"), F.greatest("path", "partner").alias("b"))
    linked = F.coalesce(F.bool_or(F.col("imports").isin("file→partner", "partner→file", "both")), F.lit(False))
    none = F.coalesce(F.bool_or(F.col("imports") == "none"), F.lit(False))
    return by.agg(F.when(linked, "linked").when(none, "none").alias("relation"))


def _plain(operator):
    return lambda spark, folder: operator(history_of(spark, folder))


def _activity(spark: SparkSession, folder: str) -> DataFrame:
    return hotspots.item_activity(table(spark, folder, "commit_files"), table(spark, folder, "commits"), history_of(spark, folder))


def _without(spark: SparkSession, folder: str) -> DataFrame:
    history = history_of(spark, folder)
    return coupling.breadth(coupling.without_items(history, coupling.ubiquitous(history)))


def _unstable(spark: SparkSession, folder: str) -> DataFrame:
    rows = modules.unstable_interfaces(history_of(spark, folder), import_edges(spark, folder), fan_in=2)
    return rows.withColumn("dependents", F.array_join(F.transform("dependents", lambda x: F.concat_ws(" ", x["item"], x["shared"])), "; "))


def _verdict(spark: SparkSession, folder: str) -> DataFrame:
    rows = modules.verdict(history_of(spark, folder))
    return rows.withColumn("judged", F.array_join("judged", " ")).withColumn("leaking", F.array_join("leaking", " "))


QUERIES = {
    "counted_changes": lambda spark, folder: history_of(spark, folder).counted(),
    "change_facts": lambda spark, folder: history_of(spark, folder).change_facts(),
    "item_activity": _activity,
    "coupling": _plain(coupling.couplings),
    "breadth": _plain(coupling.breadth),
    "partners": _plain(coupling.partners),
    "ubiquitous": _plain(coupling.ubiquitous),
    "without_ubiquitous": _without,
    "module_coupling": _plain(coupling.module_couplings),
    "strongest_partner": lambda spark, folder: coupling.strongest_partner(history_of(spark, folder).touched()),
    "distant_coupling": lambda spark, folder: coupling.distant_couplings(history_of(spark, folder), import_relations(spark, folder)),
    "crossing_pairs": _plain(coupling.crossing_pairs),
    "cohesion": _plain(modules.cohesion),
    "module_floor": _plain(modules.module_floor),
    "module_partners": lambda spark, folder: modules.module_partners(history_of(spark, folder)).select("area", F.posexplode("partners").alias("place", "p")).select("area", F.col("place").cast("long").alias("place"), "p.partner", "p.shared"),
    "change_radius": _plain(modules.change_radius),
    "area_radius": _plain(modules.area_radius),
    "fix_density": _plain(modules.fix_density),
    "interface_churn": lambda spark, folder: modules.interface_churn(history_of(spark, folder), modules.entry_points(history_of(spark, folder), globs=["**/index.ts", "**/*-index.ts", "**/read*.ts"])),
    "chronic_heat": _plain(hotspots.chronic_heat),
    "territory_pairs": _plain(coupling.territory_pairs),
    "propagation_cost": _plain(modules.propagation_cost),
    "dependency_direction": lambda spark, folder: modules.dependency_direction(history_of(spark, folder), import_edges(spark, folder), volatility=1.1),
    "unstable_interfaces": _unstable,
    "verdict": _verdict,
    "module_standings": _plain(modules.standings),
    "hotspot_score": lambda spark, folder: hotspots.hotspot_scores(history_of(spark, folder)).select("path", F.round("score", 6).alias("score")),
    "hotspots": _plain(hotspots.hotspots),
    "competition_ranks": _plain(hotspots.module_ranks),
    "hub_candidates": _plain(hotspots.hubs),
    "reasons": _plain(hotspots.reasons),
    "item_heat": _plain(hotspots.item_heat),
    "concentration": _plain(hotspots.concentration),
    "heat_bands": _plain(hotspots.heat_bands),
    "series_slices": _plain(hotspots.active_slices),
    "hot_items": _plain(hotspots.hot_items),
    "heat_kind": _plain(hotspots.heat_kinds),
    "trend_items": _plain(hotspots.window_trends),
    "territory_heat": _plain(hotspots.territory_heat),
    "fan_in": lambda spark, folder: hotspots.fan_in(import_edges(spark, folder)),
    "slice_cohesion": _plain(trends.slice_cohesion),
    "theil_sen": _plain(trends.area_lines),
    "erosion_verdict": _plain(trends.erosion),
    "repository_erosion": _plain(trends.repository_erosion),
    "slice_measures": _plain(trends.slice_measures),
    "trend_modules": _plain(trends.module_trends),
    "weak_structure": _plain(views.weak_structure),
    "co_change": lambda spark, folder: views.co_change(history_of(spark, folder), import_relations(spark, folder)),
    "least_cohesive": _plain(views.least_cohesive),
    "overview_hotspots": _plain(views.overview_hotspots),
    "thresholds": _plain(views.thresholds),
    "contract_activity": lambda spark, folder: views.contract_activity(table(spark, folder, "commit_files"), table(spark, folder, "commits"), history_of(spark, folder)),
    "leaking_entry_points": lambda spark, folder: views.leaking_entry_points(history_of(spark, folder), modules.entry_points(history_of(spark, folder), globs=["**/index.ts", "**/*-index.ts", "**/read*.ts"])),
}

_R = lambda x: f"(floor(({x}) * 10000 + 0.5) / 10000)"
_TEST_DIR = "(test|tests|__tests__|spec|specs|e2e|fixtures|__fixtures__|testing|test-utils|test-helpers|__mocks__|mocks|__snapshots__)"
_CONTRACT = lambda p: rf"(regexp_matches({p}, '[^/]\.(tsp|proto|graphql|gql|avsc|thrift|smithy)$', 'i') OR regexp_matches({p}, '\.schema\.json$', 'i') OR regexp_matches({p}, '(^|/)(openapi|asyncapi|swagger)\.([^/]+\.)?(ya?ml|json)$', 'i'))"
_TEST = lambda p: rf"(NOT {_CONTRACT(p)} AND (regexp_matches({p}, '(\.test|\.spec|_test|_spec)(\.[^./]*)?$') OR regexp_matches({p}, '(^|/){_TEST_DIR}/')))"
_DIST = lambda a, b: f"""(len(string_split({a}, '/')) + len(string_split({b}, '/')) - 2 - 2 * (
  SELECT count(*) FROM range(1, least(len(string_split({a}, '/')), len(string_split({b}, '/')))::BIGINT) r(i)
  WHERE list_slice(string_split({a}, '/'), 1, i) = list_slice(string_split({b}, '/'), 1, i)))"""  # noqa: E731

PRELUDE = f"""
WITH RECURSIVE counted AS (SELECT DISTINCT change_id FROM changes WHERE size <= 50 AND change_id IS NOT NULL),
change_facts AS (
  SELECT change_id, max(window_id) AS window_id, max(slice) AS slice, max(time_s) AS time_s, max(subject_kind) AS subject_kind, max(size) AS size
  FROM changes WHERE change_id IS NOT NULL GROUP BY 1),
held AS (SELECT DISTINCT change_id, item FROM change_items WHERE change_id IS NOT NULL AND item IS NOT NULL),
used AS (SELECT * FROM held WHERE change_id IN (SELECT change_id FROM counted)),
facts AS (
  SELECT path, coalesce(min(module), '.') AS module, coalesce(bool_or(test), {_TEST('path')}) AS test, max(loc) AS loc,
    max(complexity.total) AS complexity, max(score) AS score, max(revisions) AS revisions, max(changes) AS changes, max(breadth) AS breadth
  FROM file_stats WHERE path IS NOT NULL GROUP BY path),
touched AS (
  SELECT change_id, item, coalesce(module, '.') AS area, coalesce(test, {_TEST('item')}) AS test FROM used LEFT JOIN facts ON path = item),
per_item AS (SELECT item, count(*) AS n FROM used GROUP BY 1),
pairs AS (
  SELECT p.*, x.n AS changes_a, y.n AS changes_b FROM (
    SELECT x.item AS a, y.item AS b, count(*) AS shared FROM used x JOIN used y ON x.change_id = y.change_id AND x.item < y.item GROUP BY 1, 2) p
  JOIN per_item x ON x.item = a JOIN per_item y ON y.item = b),
coupled AS (SELECT *, shared / ((changes_a + changes_b) / 2) AS exact FROM pairs WHERE shared >= 3 AND shared / ((changes_a + changes_b) / 2) >= 0.3),
area_used AS (SELECT DISTINCT change_id, area FROM touched),
area_n AS (SELECT area, count(*) AS n FROM area_used GROUP BY 1),
area_pairs AS (
  SELECT p.*, x.n AS changes_a, y.n AS changes_b FROM (
    SELECT x.area AS a, y.area AS b, count(*) AS shared FROM area_used x JOIN area_used y ON x.change_id = y.change_id AND x.area < y.area GROUP BY 1, 2) p
  JOIN area_n x ON x.area = a JOIN area_n y ON y.area = b),
area_directed AS (SELECT a AS area, b AS partner, shared FROM area_pairs UNION ALL SELECT b, a, shared FROM area_pairs),
spans AS (SELECT change_id, count(*) AS areas FROM area_used GROUP BY 1),
tests_only AS (SELECT module AS area FROM facts GROUP BY 1 HAVING bool_and(test)),
tally AS (SELECT area, count(*) AS changes, count(*) FILTER (areas = 1) AS local FROM area_used JOIN spans USING (change_id) GROUP BY 1),
floors AS (SELECT count(*) AS counted, greatest(5, ceil(count(*) * 0.01))::BIGINT AS floor FROM counted),
ranked AS (SELECT area FROM tally, floors WHERE changes >= floor AND area IN (SELECT module FROM facts) AND area NOT IN (SELECT area FROM tests_only)),
scored AS (
  SELECT *, CASE WHEN max(revisions) OVER () > 0 THEN ln(1 + revisions) / ln(1 + max(revisions) OVER ()) ELSE 0 END
    * CASE WHEN max(bulk) OVER () > 0 THEN ln(1 + bulk) / ln(1 + max(bulk) OVER ()) ELSE 0 END AS score
  FROM (SELECT path, module, test, coalesce(revisions, 0) AS revisions, coalesce(loc, 0) + coalesce(complexity, 0) AS bulk,
    coalesce(breadth, 0) AS breadth, coalesce(changes, 0) AS changes FROM facts)),
heats AS (SELECT path, module, test, changes * bulk AS heat, CASE WHEN test THEN 0 ELSE changes * bulk END AS production_heat FROM scored),
edges AS (
  SELECT path AS src, partner AS dst FROM partners WHERE imports IN ('file→partner', 'both') AND path IS NOT NULL AND partner IS NOT NULL
  UNION SELECT partner, path FROM partners WHERE imports IN ('partner→file', 'both') AND path IS NOT NULL AND partner IS NOT NULL),
felt AS (
  SELECT DISTINCT src, dst, x.change_id FROM edges JOIN used x ON x.item = src JOIN used y ON y.item = dst AND y.change_id = x.change_id WHERE src <> dst),
relations AS (
  SELECT least(path, partner) AS a, greatest(path, partner) AS b, CASE WHEN coalesce(bool_or(imports IN ('file→partner', 'partner→file', 'both')), false) THEN 'linked'
    WHEN coalesce(bool_or(imports = 'none'), false) THEN 'none' END AS relation
  FROM partners WHERE path IS NOT NULL AND partner IS NOT NULL GROUP BY 1, 2),
slices AS (SELECT slice, count(*) AS changes, count(*) >= 10 AS active FROM change_facts WHERE slice IS NOT NULL AND size <= 50 GROUP BY 1),
slice_raw AS (
  SELECT slice, path, count(*) AS changes, any_value(coalesce(loc, 0) + coalesce(complexity, 0)) AS bulk
  FROM held JOIN change_facts USING (change_id) JOIN facts ON path = item WHERE slice IS NOT NULL AND size <= 50 AND NOT test GROUP BY 1, 2),
slice_scores AS (
  SELECT slice, path, changes, round(ln(1 + changes) / ln(1 + max(changes) OVER (PARTITION BY slice))
    * CASE WHEN max(bulk) OVER (PARTITION BY slice) > 0 THEN ln(1 + bulk) / ln(1 + max(bulk) OVER (PARTITION BY slice)) ELSE 0 END, 12) AS score FROM slice_raw),
hot AS (
  SELECT slice, path, score FROM (
    SELECT *, rank() OVER (PARTITION BY slice ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY slice) AS n FROM slice_scores)
  WHERE k <= ceil(n * 0.1) AND score > 0),
slice_area AS (SELECT DISTINCT slice, change_id, area FROM touched JOIN change_facts USING (change_id) WHERE slice IS NOT NULL),
slice_tally AS (SELECT slice, area, count(*) AS changes, count(*) FILTER (areas = 1) AS local FROM slice_area JOIN spans USING (change_id) GROUP BY 1, 2),
slice_n AS (SELECT slice, greatest(10, 5, ceil(count(*) * 0.01)) AS floor FROM change_facts WHERE slice IS NOT NULL AND size <= 50 GROUP BY 1),
shares AS (SELECT slice, area, changes, local / changes AS share FROM slice_tally JOIN slice_n USING (slice) WHERE changes >= floor AND area NOT IN (SELECT area FROM tests_only)),
lines_ AS (
  SELECT area, points, first, last, slope, (SELECT median(share - slope * slice) FROM shares s WHERE s.area = q.area) AS intercept FROM (
    SELECT area, count(*) AS points, min(slice) AS first, max(slice) AS last,
      (SELECT median((y.share - x.share) / (y.slice - x.slice)) FROM shares x JOIN shares y ON x.area = y.area AND x.slice < y.slice WHERE x.area = s.area) AS slope
    FROM shares s GROUP BY area HAVING count(*) >= 3) q),
radius AS (
  SELECT DISTINCT change_id, area FROM touched WHERE area NOT IN (SELECT module FROM facts GROUP BY module HAVING bool_and(test))),
radius_n AS (SELECT change_id, count(*) AS n FROM radius GROUP BY 1),
slice_radius AS (
  SELECT slice, count(*) AS measured, quantile_disc(n, 0.5)::BIGINT AS median, quantile_disc(n, 0.9)::BIGINT AS p90, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS local
  FROM radius_n JOIN change_facts USING (change_id) WHERE slice IS NOT NULL GROUP BY 1),
slice_measures AS (
  SELECT slice, changes, active, coalesce(measured, 0) AS measured, median, p90, floor(local * 10000 + 0.5) / 10000 AS local FROM slices LEFT JOIN slice_radius USING (slice)),
points AS (
  SELECT 'area' AS of, area AS key, slice::DOUBLE AS x, share AS y, changes::DOUBLE AS n FROM shares
  UNION ALL SELECT 'all', '', slice, local, measured FROM slice_measures WHERE active AND local IS NOT NULL),
ends AS (SELECT of, key, count(*) AS k, min(x) AS lo, max(x) AS hi FROM points GROUP BY 1, 2),
line_parts AS (
  SELECT 'whole' AS part, p.* FROM points p JOIN ends USING (of, key) WHERE k >= 3
  UNION ALL SELECT 'inner', p.* FROM points p JOIN ends USING (of, key) WHERE k >= 5 AND x > lo AND x < hi),
part_slopes AS (SELECT a.part, a.of, a.key, median((b.y - a.y) / (b.x - a.x)) AS slope FROM line_parts a JOIN line_parts b ON a.part = b.part AND a.of = b.of AND a.key = b.key AND a.x < b.x GROUP BY 1, 2, 3),
part_lines AS (
  SELECT part, of, key, any_value(slope) AS slope, median(y - slope * x) AS intercept, min(x) AS lo, max(x) AS hi, count(*) AS k,
    least(0.95, greatest(0.05, sum(y * n) / sum(n))) AS p, sum(n * x) / sum(n) AS middle FROM line_parts JOIN part_slopes USING (part, of, key) GROUP BY 1, 2, 3),
part_moves AS (
  SELECT l.part, l.of, l.key, any_value(l.slope) AS slope, any_value(intercept) AS intercept, any_value(lo) AS lo, any_value(hi) AS hi, any_value(l.k) AS k,
    CASE WHEN any_value(l.slope * (hi - lo)) <= -greatest(0.1, 2 * 1.15 * any_value(hi - lo) / sqrt(sum(n * (x - middle) ** 2 / (p * (1 - p))))) THEN 'eroding'
      WHEN any_value(l.slope * (hi - lo)) >= greatest(0.1, 2 * 1.15 * any_value(hi - lo) / sqrt(sum(n * (x - middle) ** 2 / (p * (1 - p))))) THEN 'improving' ELSE 'holding' END AS moved
  FROM part_lines l JOIN line_parts USING (part, of, key) GROUP BY 1, 2, 3),
judged AS (
  SELECT w.*, CASE WHEN w.moved = i.moved THEN w.moved ELSE 'holding' END AS verdict FROM part_moves w LEFT JOIN part_moves i ON i.part = 'inner' AND i.of = w.of AND i.key = w.key WHERE w.part = 'whole'),
whole_series AS (
  SELECT (SELECT count(*) FROM points WHERE of = 'all') AS windows, intercept + slope * lo AS "from", intercept + slope * hi AS "to", coalesce(verdict, 'unknown') AS verdict,
    CASE WHEN last IS NULL THEN first WHEN last < newest THEN last + 1 END::BIGINT AS inactive_since
  FROM (SELECT max(slice) AS newest, min(slice) AS first, max(slice) FILTER (active) AS last FROM slices) LEFT JOIN judged ON of = 'all' WHERE newest IS NOT NULL)
"""

_S = {
    "counted_changes": "SELECT change_id FROM counted",
    "change_facts": "SELECT change_id, window_id, slice, time_s, subject_kind, size FROM change_facts",
    "item_activity": """SELECT path, count(*) AS revisions, coalesce(sum(added), 0)::BIGINT AS lines_added, coalesce(sum(deleted), 0)::BIGINT AS lines_deleted,
  coalesce(any_value(n), 0)::BIGINT AS changes
FROM (SELECT path, sha, sum(added) AS added, sum(deleted) AS deleted FROM (SELECT DISTINCT sha, path, added, deleted FROM commit_files
  WHERE path IS NOT NULL AND sha IN (SELECT sha FROM commits WHERE NOT move_only)) GROUP BY 1, 2)
LEFT JOIN (SELECT item, count(*) AS n FROM held GROUP BY 1) h ON h.item = path GROUP BY path""",
    "coupling": f"""SELECT a, b, shared, {_R('exact')} AS degree, {_DIST('a', 'b')}::BIGINT AS distance,
  false AS test_pair, coalesce(x.module, '.') <> coalesce(y.module, '.') AS crosses_module,
  CASE WHEN {_CONTRACT('a')} OR {_CONTRACT('b')} THEN 'contract' ELSE 'code' END AS kind
FROM coupled LEFT JOIN facts x ON x.path = a LEFT JOIN facts y ON y.path = b""",
    "breadth": "SELECT item, count(*) AS breadth FROM (SELECT a AS item FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1",
    "partners": f"""SELECT item, place, partner, shared, {_R('p')} AS probability FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, shared DESC, partner) AS place FROM (
    SELECT a AS item, b AS partner, shared, shared / changes_a AS p FROM coupled UNION ALL SELECT b, a, shared, shared / changes_b FROM coupled)) WHERE place <= 5""",
    "ubiquitous": f"""SELECT item, n AS changes, {_R('n / counted')} AS share FROM per_item, floors WHERE n >= 10 AND n > 0.3 * counted""",
    "without_ubiquitous": """SELECT item, count(*) AS breadth FROM (
  SELECT a AS item, b FROM pairs UNION ALL SELECT b, a FROM pairs) p, floors
WHERE item NOT IN (SELECT item FROM per_item, floors WHERE n >= 10 AND n > 0.3 * counted) AND b NOT IN (SELECT item FROM per_item, floors WHERE n >= 10 AND n > 0.3 * counted) GROUP BY 1""",
    "module_coupling": f"""SELECT a, b, shared, {_R('shared / least(changes_a, changes_b)')} AS share FROM area_pairs WHERE shared >= 3
  AND a IN (SELECT area FROM ranked) AND b IN (SELECT area FROM ranked) ORDER BY shared / least(changes_a, changes_b) DESC, shared DESC, a, b LIMIT 200""",
    "strongest_partner": """SELECT area, partner, shared FROM (
  SELECT *, row_number() OVER (PARTITION BY area ORDER BY shared DESC, partner) AS k FROM area_directed WHERE shared >= 3) WHERE k = 1""",
    "crossing_pairs": """SELECT least(ma, mb) AS a, greatest(ma, mb) AS b, count(*) AS couplings, sum(shared)::BIGINT AS shared FROM (
  SELECT shared, coalesce(x.module, '.') AS ma, coalesce(y.module, '.') AS mb FROM coupled LEFT JOIN facts x ON x.path = a LEFT JOIN facts y ON y.path = b)
WHERE ma <> mb GROUP BY 1, 2""",
    "cohesion": f"""SELECT area, files, test_only, coalesce(changes, 0) AS changes, coalesce(local, 0) AS local,
  CASE WHEN changes > 0 THEN {_R('local / changes')} END AS cohesion, NOT test_only AND coalesce(changes, 0) >= floor AS ranked
FROM (SELECT module AS area, count(*) AS files, bool_and(test) AS test_only FROM facts GROUP BY 1) LEFT JOIN tally USING (area), floors""",
    "module_floor": "SELECT counted, floor FROM floors",
    "module_partners": """SELECT area, place - 1 AS place, partner, shared FROM (
  SELECT *, row_number() OVER (PARTITION BY area ORDER BY shared DESC, partner) AS place FROM area_directed WHERE shared >= 3) WHERE place <= 5""",
    "change_radius": f"""SELECT count(*) AS measured, quantile_disc(n, 0.5)::BIGINT AS median, quantile_disc(n, 0.9)::BIGINT AS p90,
  {_R('avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END)')} AS local FROM radius_n""",
    "area_radius": "SELECT area, count(*) AS changes, quantile_disc(n, 0.5)::BIGINT AS median FROM radius JOIN radius_n USING (change_id) GROUP BY 1",
    "fix_density": f"""SELECT area, changes, fixes, spanning, CASE WHEN known AND changes > 0 THEN {_R('fixes / changes')} END AS share FROM (
  WITH r AS (SELECT DISTINCT change_id, area, subject_kind FROM touched JOIN change_facts USING (change_id) WHERE NOT test AND size <= 50),
  n AS (SELECT change_id, count(*) AS k FROM r GROUP BY 1)
  SELECT area, count(*) AS changes, count(*) FILTER (subject_kind = 'fix') AS fixes, count(*) FILTER (subject_kind = 'fix' AND k > 1) AS spanning FROM r JOIN n USING (change_id) GROUP BY 1
  UNION ALL
  SELECT '*', count(*), count(*) FILTER (subject_kind = 'fix'), (SELECT count(DISTINCT change_id) FROM r JOIN n USING (change_id) WHERE subject_kind = 'fix' AND k > 1) FROM change_facts WHERE size <= 50
), (SELECT count(*) FILTER (subject_kind IN ('fix', 'convention')) >= 0.05 * count(*) AS known FROM change_facts WHERE size <= 50)""",
    "interface_churn": f"""SELECT area, interface, implementation, leaked, CASE WHEN has AND implementation > 0 THEN {_R('leaked / implementation')} END AS leakage,
  coalesce(has AND implementation >= 5 AND leaked / implementation >= 0.5, false) AS leaky FROM (
  SELECT area, count(*) FILTER (e) AS interface, count(*) FILTER (r) AS implementation, count(*) FILTER (e AND r) AS leaked FROM (
    SELECT change_id, area, bool_or(e) AS e, bool_or(NOT e) AS r FROM (
      SELECT change_id, area, coalesce(regexp_matches(item, '(^|/)(index|[^/]*-index|read[^/]*)\\.ts$') AND item IN (SELECT path FROM facts WHERE NOT test), false) AS e FROM touched WHERE NOT test)
    GROUP BY 1, 2) GROUP BY 1)
LEFT JOIN (SELECT DISTINCT module AS area, true AS has FROM facts WHERE NOT test AND regexp_matches(path, '(^|/)(index|[^/]*-index|read[^/]*)\\.ts$')) USING (area)""",
    "unstable_interfaces": f"""SELECT item, coalesce(module, '.') AS module, fan_in, changes, typical, coalesce(k, 0) AS changed_dependents, coalesce(l, '') AS dependents FROM (
  SELECT dst AS item, count(*) AS fan_in, floor(median(coalesce(n, 0)))::BIGINT AS typical
  FROM (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND NOT {_TEST('src')} AND NOT {_TEST('dst')}) LEFT JOIN (SELECT item, count(*) AS n FROM held GROUP BY 1) ON item = src GROUP BY 1) h
JOIN (SELECT item, count(*) AS changes FROM held GROUP BY 1) USING (item)
LEFT JOIN (SELECT dst AS item, count(*) AS k, array_to_string(list(src || ' ' || n ORDER BY n DESC, src)[1:5], '; ') AS l FROM (
  SELECT src, dst, count(*) AS n FROM felt WHERE NOT {_TEST('src')} AND NOT {_TEST('dst')} GROUP BY 1, 2) GROUP BY 1) USING (item)
LEFT JOIN (SELECT path, module FROM facts) ON path = item
WHERE fan_in >= 2 AND changes >= 5 AND changes > typical ORDER BY changed_dependents DESC, changes DESC, fan_in DESC, item LIMIT 50""",
    "dependency_direction": f"""SELECT "from", "to", imports, changes_from, changes_to, together, ratio, {_R('log2(ratio) * log2(1 + together)')} AS rank FROM (
  SELECT x.module AS "from", y.module AS "to", count(DISTINCT src) AS imports, coalesce(max(f.n), 0) AS together FROM edges JOIN facts x ON x.path = src JOIN facts y ON y.path = dst
  LEFT JOIN (SELECT v.module AS a, w.module AS b, count(DISTINCT change_id) AS n FROM felt JOIN facts v ON v.path = src JOIN facts w ON w.path = dst WHERE NOT v.test GROUP BY 1, 2) f ON f.a = x.module AND f.b = y.module
  WHERE x.module <> y.module AND NOT x.test AND x.module NOT IN (SELECT area FROM tests_only) AND y.module NOT IN (SELECT area FROM tests_only) GROUP BY 1, 2) l
LEFT JOIN (SELECT area AS "from", changes AS cf FROM tally) USING ("from") JOIN (SELECT area AS "to", changes AS changes_to FROM tally) USING ("to"),
LATERAL (SELECT coalesce(cf, 0) AS changes_from), LATERAL (SELECT {_R('changes_to / greatest(1, changes_from)')} AS ratio), floors
WHERE changes_to >= floor AND changes_to >= 1.1 * changes_from ORDER BY log2(ratio) * log2(1 + together) DESC, imports DESC, "from", "to" LIMIT 50""",
    "propagation_cost": f"""SELECT nodes, edges, CASE WHEN nodes > 1 THEN {_R('reached / (nodes * (nodes - 1))')} END AS cost FROM (
  WITH nodes AS (SELECT item FROM per_item WHERE n >= 3 AND NOT {_TEST('item')}),
  one AS (SELECT a, b FROM coupled WHERE a IN (SELECT item FROM nodes) AND b IN (SELECT item FROM nodes)),
  e AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
  two AS (SELECT a, b FROM e UNION SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b),
  three AS (SELECT a, b FROM two UNION SELECT x.a, y.b FROM two x JOIN e y ON x.b = y.a WHERE x.a <> y.b)
  SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM one) AS edges, (SELECT count(*) FROM three) AS reached)""",
    "verdict": f"""SELECT level, CASE WHEN level = 'unknown' THEN CASE WHEN n = 0 THEN 'no-territories' WHEN (SELECT count(*) FROM counted) = 0 THEN 'quiet-window' ELSE 'too-little-evidence' END END AS reason,
  leak_share, coverage, eroding, judged, leaking FROM (
  SELECT *, CASE WHEN base = 'unknown' OR NOT eroding THEN base WHEN base = 'holds' THEN 'mixed' ELSE 'strained' END AS level FROM (
    SELECT *, CASE WHEN judged = '' OR coverage < 0.5 THEN 'unknown' WHEN leak_share < 0.2 THEN 'holds' WHEN leak_share < 0.5 THEN 'mixed' ELSE 'strained' END AS base FROM (
      SELECT count(*) AS n, {_R("least(1, coalesce(sum(h) FILTER (state <> 'unjudged'), 0))")} AS coverage, {_R("least(1, coalesce(sum(h) FILTER (state = 'leaks'), 0))")} AS leak_share,
        coalesce(string_agg(area, ' ' ORDER BY h DESC, area) FILTER (state <> 'unjudged'), '') AS judged, coalesce(string_agg(area, ' ' ORDER BY h DESC, area) FILTER (state = 'leaks'), '') AS leaking,
        coalesce((SELECT verdict = 'eroding' FROM whole_series), false) AS eroding FROM (
        SELECT m.area, coalesce({_R('heat / nullif((SELECT sum(production_heat) FROM heats), 0)')}, 0) AS h, CASE WHEN changes IS NULL OR changes < floor THEN 'unjudged' WHEN local / changes > 0.75 THEN 'holds'
          WHEN m.area IN (SELECT area FROM area_directed WHERE shared >= 3) THEN 'leaks' ELSE 'unjudged' END AS state
        FROM (SELECT module AS area, bool_and(test) AS just FROM facts GROUP BY 1) m LEFT JOIN tally USING (area)
        LEFT JOIN (SELECT module AS area, sum(production_heat) AS heat FROM heats GROUP BY 1) h USING (area), floors WHERE NOT just AND m.area <> '.')))) """,
    "module_standings": f"""SELECT m.area, coalesce({_R('heat / nullif((SELECT sum(production_heat) FROM heats), 0)')}, 0) AS heat_share, CASE WHEN changes IS NULL OR changes < floor THEN 'unjudged' WHEN local / changes > 0.75 THEN 'holds'
    WHEN m.area IN (SELECT area FROM area_directed WHERE shared >= 3) THEN 'leaks' ELSE 'unjudged' END AS state
  FROM (SELECT module AS area, bool_and(test) AS just FROM facts GROUP BY 1) m LEFT JOIN tally USING (area)
  LEFT JOIN (SELECT module AS area, sum(production_heat) AS heat FROM heats GROUP BY 1) h USING (area), floors WHERE NOT just AND m.area <> '.'""",
    "erosion_verdict": f"""SELECT key AS area, k AS windows, {_R('intercept + slope * lo')} AS "from", {_R('intercept + slope * hi')} AS "to", verdict, hi > (SELECT max(slice) FROM change_facts) - 2 AS recent FROM judged WHERE of = 'area'""",
    "repository_erosion": f"""SELECT windows, {_R('"from"')} AS "from", {_R('"to"')} AS "to", verdict, inactive_since FROM whole_series""",
    "slice_measures": "SELECT slice, changes, active, measured, median, p90, local FROM slice_measures",
    "distant_coupling": f"""SELECT a, b, shared, degree, {_R('reach')} AS reach, hidden, {_R('degree * reach * CASE WHEN hidden THEN 1.5 ELSE 1 END * least(1, shared / 10)')} AS score FROM (
  SELECT *, CASE WHEN crosses THEN 1 + log2(1 + {_DIST('pa', 'pb')}) ELSE distance / greatest(1, max(distance) OVER ()) END AS reach FROM (
    SELECT c.a, c.b, shared, {_R('exact')} AS degree, {_DIST('c.a', 'c.b')} AS distance, coalesce(x.module, '.') <> coalesce(y.module, '.') AS crosses, coalesce(relation = 'none', false) AS hidden,
      CASE WHEN coalesce(x.module, '.') = '.' THEN '_' ELSE x.module || '/_' END AS pa, CASE WHEN coalesce(y.module, '.') = '.' THEN '_' ELSE y.module || '/_' END AS pb
    FROM coupled c LEFT JOIN facts x ON x.path = c.a LEFT JOIN facts y ON y.path = c.b LEFT JOIN relations r ON r.a = c.a AND r.b = c.b
    WHERE NOT {_TEST('c.a')} AND NOT {_TEST('c.b')} AND NOT ({_CONTRACT('c.a')} AND {_CONTRACT('c.b')}))
  WHERE crosses OR distance >= 3) ORDER BY score DESC, degree DESC, shared DESC, a, b LIMIT 50""",
    "reasons": """SELECT path, array_to_string(list_filter([
  CASE WHEN revisions > 0 THEN format('changed in {} {} of {} files', revisions, CASE WHEN revisions = 1 THEN 'commit' ELSE 'commits' END, n) END,
  CASE WHEN bulk > 0 THEN format('size {}', bulk) END,
  CASE WHEN changes >= 5 AND NOT test AND breadth >= 10 AND path IN (SELECT path FROM (
    SELECT path, breadth, rank() OVER (ORDER BY breadth DESC) AS k, count(*) OVER () AS of FROM scored WHERE changes >= 5 AND NOT test) WHERE k <= ceil(of * 0.05)) THEN format('changes together with {} different files', breadth) END],
  lambda x: x IS NOT NULL), '; ') AS reasons FROM (SELECT *, count(*) OVER () AS n FROM scored) ORDER BY score DESC, path LIMIT 50""",
    "hotspot_score": "SELECT path, round(score, 6) AS score FROM scored",
    "hotspots": f"""SELECT path, revisions, bulk AS size, {_R('score')} AS score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM scored ORDER BY score DESC, path LIMIT 50""",
    "competition_ranks": "SELECT path, module, rank() OVER (PARTITION BY module ORDER BY revisions DESC) AS revision_rank, rank() OVER (PARTITION BY module ORDER BY bulk DESC) AS size_rank FROM scored",
    "hub_candidates": """SELECT path, breadth, changes FROM (
  SELECT *, rank() OVER (ORDER BY breadth DESC) AS k, count(*) OVER () AS n FROM scored WHERE changes >= 5 AND NOT test) WHERE breadth >= 10 AND k <= ceil(n * 0.05)""",
    "item_heat": "SELECT path, module, heat, production_heat FROM heats",
    "concentration": f"""SELECT 3::BIGINT AS top, {_R('sum(h) / nullif(any_value(t), 0)')} AS share FROM (
  SELECT sum(production_heat) AS h, sum(sum(production_heat)) OVER () AS t FROM heats GROUP BY module ORDER BY h DESC, module LIMIT 3)""",
    "heat_bands": """SELECT path, CASE WHEN score = 0 THEN 8 WHEN part < 0.02 THEN 1 WHEN part < 0.05 THEN 2 WHEN part < 0.1 THEN 3 WHEN part < 0.2 THEN 4
  WHEN part < 0.35 THEN 5 WHEN part < 0.5 THEN 6 WHEN part < 0.7 THEN 7 ELSE 8 END::BIGINT AS band FROM (
  SELECT path, score, (rank() OVER (ORDER BY score DESC) - 1) / (SELECT count(*) FROM scored WHERE score > 0) AS part FROM scored)""",
    "series_slices": "SELECT slice, changes, active FROM slices",
    "hot_items": f"SELECT slice, path, {_R('score')} AS score FROM hot",
    "heat_kind": """SELECT path, first, active, hot, CASE
  WHEN earlier >= 3 AND 2 * hot_earlier >= earlier AND 2 * hot >= active THEN 'chronic'
  WHEN hot_last = 2 AND others > 0 AND NOT 2 * hot_earlier >= greatest(earlier, 1) THEN 'acute' ELSE 'other' END AS kind FROM (
  SELECT f.path, f.first::BIGINT AS first, count(*) FILTER (s.slice >= f.first) AS active, count(*) FILTER (s.slice >= f.first AND h.slice IS NOT NULL) AS hot,
    count(*) FILTER (s.slice >= f.first AND NOT s.now) AS earlier, count(*) FILTER (s.slice >= f.first AND NOT s.now AND h.slice IS NOT NULL) AS hot_earlier,
    count(*) FILTER (s.now AND h.slice IS NOT NULL) AS hot_last, count(*) FILTER (NOT s.now) AS others
  FROM (SELECT path, min(slice) AS first FROM slice_scores GROUP BY 1) f
  CROSS JOIN (SELECT slice, slice >= (SELECT max(slice) FROM change_facts) - 1 AS now FROM slices WHERE active) s
  LEFT JOIN hot h ON h.path = f.path AND h.slice = s.slice GROUP BY 1, 2)""",
    "trend_items": """SELECT item, count(*) FILTER (window_id = 'before') AS was, count(*) FILTER (window_id = 'current') AS is,
  count(*) FILTER (window_id = 'current') - count(*) FILTER (window_id = 'before') AS delta
FROM held JOIN change_facts USING (change_id) WHERE size <= 50 AND window_id IN ('before', 'current') GROUP BY 1""",
    "territory_heat": f"""SELECT directory, files, tests, coalesce(changes, 0) AS changes, heat, CASE WHEN total > 0 THEN {_R('heat / total')} END AS share FROM (
  WITH up AS (SELECT path, test, production_heat, unnest(list_concat(['.'], list_transform(range(1, len(string_split(path, '/'))::BIGINT), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/')))) AS directory FROM heats)
  SELECT s.*, c.changes, (SELECT sum(production_heat) FROM heats) AS total FROM (
    SELECT directory, count(*) AS files, count(*) FILTER (test) AS tests, sum(production_heat)::BIGINT AS heat FROM up GROUP BY 1) s
  LEFT JOIN (SELECT directory, count(DISTINCT change_id) AS changes FROM up JOIN used ON item = path GROUP BY 1) c USING (directory))""",
    "chronic_heat": f"""SELECT area, coalesce(chronic, 0) AS chronic, coalesce(acute, 0) AS acute, CASE WHEN heat > 0 THEN {_R('coalesce(hot, 0) / heat')} END AS share FROM (
  SELECT module AS area, sum(production_heat) AS heat, count(*) FILTER (kind = 'chronic') AS chronic, count(*) FILTER (kind = 'acute') AS acute, sum(production_heat) FILTER (kind = 'chronic') AS hot
  FROM heats LEFT JOIN (@heat_kind@) k USING (path) GROUP BY 1)""",
    "territory_pairs": f"""SELECT a, b, shared, {_R('shared / least(changes_a, changes_b)')} AS share FROM area_pairs WHERE shared >= 3 AND a IN (SELECT area FROM ranked) AND b IN (SELECT area FROM ranked)
  AND a IN (SELECT module FROM heats GROUP BY 1 ORDER BY sum(production_heat) DESC, module LIMIT 24) AND b IN (SELECT module FROM heats GROUP BY 1 ORDER BY sum(production_heat) DESC, module LIMIT 24)""",
    "fan_in": "SELECT dst AS item, count(DISTINCT src) AS dependents FROM edges WHERE src <> dst GROUP BY 1",
    "slice_cohesion": f"SELECT slice, area, changes, {_R('share')} AS share FROM shares",
    "theil_sen": f"""SELECT area, points, {_R('slope')} AS slope, {_R('intercept + slope * first')} AS "from", {_R('intercept + slope * last')} AS "to" FROM lines_""",
    "trend_modules": f"""SELECT area, {_R('was_local / was')} AS was, {_R('is_local / is_n')} AS is, {_R('is_local / is_n - was_local / was')} AS delta FROM (
  SELECT area, count(*) FILTER (window_id = 'before') AS was, count(*) FILTER (window_id = 'before' AND areas = 1) AS was_local,
    count(*) FILTER (window_id = 'current') AS is_n, count(*) FILTER (window_id = 'current' AND areas = 1) AS is_local
  FROM area_used JOIN spans USING (change_id) JOIN change_facts USING (change_id) GROUP BY 1) WHERE was > 0 AND is_n > 0""",
}

_ENTRY = "regexp_matches(item, '(^|/)(index|[^/]*-index|read[^/]*)\\.ts$') AND item IN (SELECT path FROM facts WHERE NOT test)"
_S |= {
    "weak_structure": f"""SELECT s.area, heat_share, {_R('local / changes')} AS containment, state = 'leaks' AS leaks, partner, CASE WHEN partner IS NOT NULL THEN {_R('shared / changes')} END AS partner_share
FROM (@standings@) s JOIN tally USING (area) LEFT JOIN (SELECT area, partner, shared FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY shared DESC, partner) AS k FROM area_directed WHERE shared >= 3) WHERE k = 1) USING (area)
WHERE state <> 'unjudged'""",
    "co_change": f"""SELECT CASE WHEN x.h >= y.h THEN p.a ELSE p.b END AS a, CASE WHEN x.h >= y.h THEN p.b ELSE p.a END AS b, shared, coalesce(f, 0) AS file_pairs, coalesce(g, 0) AS hidden_pairs FROM (@pairs@) p
JOIN (SELECT module, sum(production_heat) AS h FROM heats GROUP BY 1) x ON x.module = p.a JOIN (SELECT module, sum(production_heat) AS h FROM heats GROUP BY 1) y ON y.module = p.b
LEFT JOIN (SELECT least(coalesce(v.module, '.'), coalesce(w.module, '.')) AS ma, greatest(coalesce(v.module, '.'), coalesce(w.module, '.')) AS mb, count(*) AS f, count(*) FILTER (relation = 'none') AS g
  FROM coupled c LEFT JOIN facts v ON v.path = c.a LEFT JOIN facts w ON w.path = c.b LEFT JOIN relations r ON r.a = c.a AND r.b = c.b
  WHERE coalesce(v.module, '.') <> coalesce(w.module, '.') AND NOT {_TEST('c.a')} AND NOT {_TEST('c.b')} AND NOT ({_CONTRACT('c.a')} AND {_CONTRACT('c.b')}) GROUP BY 1, 2) q ON q.ma = p.a AND q.mb = p.b""",
    "least_cohesive": f"SELECT area, changes, {_R('local / changes')} AS cohesion FROM tally WHERE area IN (SELECT area FROM ranked) ORDER BY cohesion, changes DESC, area LIMIT 5",
    "overview_hotspots": f"""SELECT path, {_R('score')} AS score, rest = 0 AS includes_tests, rest > 0 AND tests > 0 AS toggleable FROM (
  SELECT *, count(*) FILTER (test) OVER () AS tests, count(*) FILTER (NOT test) OVER () AS rest FROM scored) WHERE NOT test OR rest = 0 ORDER BY scored.score DESC, path LIMIT 10""".replace("scored.score", "score"),
    "thresholds": """SELECT unnest(['max_change_size', 'hub_breadth', 'hub_changes', 'hub_share', 'local_distance', 'clique_share', 'fan_in', 'interface_changes', 'volatility', 'copy_similarity', 'leakage', 'implementation_changes',
  'min_shared', 'min_degree', 'propagation_depth', 'ubiquitous_share', 'ubiquitous_changes', 'convention_share', 'slice_changes', 'erosion_shift', 'erosion_sigmas', 'mean_line', 'max_bytes', 'module_changes']) AS name,
  unnest([50, 10, 5, 0.05, 3, 0.3, 5, 5, 2, 0.5, 0.5, 5, 3, 0.3, 3, 0.3, 10, 0.05, 10, 0.1, 2, 300, 1048576, floor]::DOUBLE[]) AS value FROM floors""",
    "contract_activity": f"""SELECT path, coalesce(module, '.') AS module, revisions, changes, lines_added, lines_deleted FROM (@activity@) LEFT JOIN (SELECT path, module FROM facts) USING (path) WHERE {_CONTRACT('path')}""",
    "leaking_entry_points": f"""SELECT item, area, leakage FROM (SELECT DISTINCT t.item, t.area FROM touched t WHERE NOT t.test AND {_ENTRY.replace('item', 't.item', 2)}
    AND EXISTS (SELECT 1 FROM touched u WHERE u.change_id = t.change_id AND u.area = t.area AND NOT u.test AND NOT ({_ENTRY.replace('item', 'u.item', 2)})))
  JOIN (SELECT area, leakage FROM (@churn@) WHERE leaky AND area NOT IN (SELECT area FROM tests_only)) USING (area)""",
}
for _name, _marks in {"weak_structure": {"@standings@": "module_standings"}, "co_change": {"@pairs@": "territory_pairs"}, "contract_activity": {"@activity@": "item_activity"}, "leaking_entry_points": {"@churn@": "interface_churn"}}.items():
    for _mark, _of in _marks.items():
        _S[_name] = _S[_name].replace(_mark, _S[_of])
_S["chronic_heat"] = _S["chronic_heat"].replace("@heat_kind@", _S["heat_kind"])

SQL = {name: PRELUDE + body for name, body in _S.items() if name != "coupling"}
SQL["coupling"] = (PRELUDE + _S["coupling"]).replace("false AS test_pair", "EXISTS (SELECT 1 FROM tested t WHERE (t.test = a AND t.stem = regexp_replace(b, '([^/])\\.[^./]*$', '\\1')) OR (t.test = b AND t.stem = regexp_replace(a, '([^/])\\.[^./]*$', '\\1'))) AS test_pair").replace(
    "radius AS (",
    """tests AS (SELECT DISTINCT item AS test, regexp_replace(regexp_replace(item, '([^/])\\.[^./]*$', '\\1'), '(\\.test|\\.spec|_test|_spec)$', '') AS name FROM used
  WHERE regexp_matches(regexp_replace(item, '([^/])\\.[^./]*$', '\\1'), '[^/](\\.test|\\.spec|_test|_spec)$')),
tested AS (SELECT test, name AS stem FROM tests UNION
  SELECT test, array_to_string(list_concat(list_slice(string_split(name, '/'), 1, i - 1), root, list_slice(string_split(name, '/'), i + 1, len(string_split(name, '/')))), '/')
  FROM tests, range(1, 30) r(i), (VALUES ([]::VARCHAR[]), (['src']), (['lib'])) q(root)
  WHERE i < len(string_split(name, '/')) AND string_split(name, '/')[i] IN ('test', 'tests', '__tests__', 'spec', 'specs', 'e2e')
    AND NOT regexp_matches(name, '(^|/)(fixtures|__fixtures__)/')),
radius AS (""",
    1,
)
