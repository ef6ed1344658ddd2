"""How well boundaries hold: cohesion, change radius, fixes, interfaces, direction, propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded, share
from tidemark.functions.paths import directory_of, is_config, is_test, matches_any, name_of
from tidemark.operators.coupling import MIN_DEGREE, MIN_SHARED, directed, module_pairs, strong_pairs
from tidemark.operators.history import ROOT, History
from tidemark.operators.skew import salted_join, shuffled
from tidemark.session import durable

MODULE_FLOOR, MODULE_SHARE = 5, 0.01
CONVENTION_SHARE = 0.05
DEPTH = 3
LEAKY, LEAKY_CHANGES = 0.5, 5
FAN_IN, INTERFACE_CHANGES = 5, 5
VOLATILITY = 2


def module_floor(history: History) -> DataFrame:
    """``counted, floor``: counted changes, and how many a module needs to be ranked: 5 or 1 %."""
    n = history.counted().agg(F.count(F.lit(1)).alias("counted"))
    return n.select("counted", F.greatest(F.lit(MODULE_FLOOR), F.ceil(F.col("counted") * MODULE_SHARE)).cast("long").alias("floor"))


def area_tally(touched: DataFrame, *keys: str) -> DataFrame:
    """``keys..., area, changes, local``: changes that touch an area, and those that touch no other."""
    pairs = touched.select(*keys, "change_id", "area").distinct()
    spans = pairs.groupBy("change_id").agg(F.count(F.lit(1)).alias("areas"))
    return pairs.join(spans, "change_id").groupBy(*keys, "area").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("areas") == 1).alias("local"))


def cohesion(history: History) -> DataFrame:
    """``area, files, test_only, changes, local, cohesion, ranked``: all modules with files; null cohesion without changes."""
    files = history.areas().groupBy("area").agg(F.count(F.lit(1)).alias("files"), F.min("test").alias("test_only"))
    rows = files.join(area_tally(history.touched_areas()), "area", "left").fillna(0, ["changes", "local"])
    floor = module_floor(history).select("floor").scalar()
    return history.once("cohesion", lambda: rows.select("area", "files", "test_only", "changes", "local", rounded(share("local", "changes")).alias("cohesion"), (~F.col("test_only") & (F.col("changes") >= floor)).alias("ranked")))


def module_partners(history: History, top: int = 5, min_shared: int = MIN_SHARED) -> DataFrame:
    """``area, partners``: per module the areas it shares most changes with: array of (partner, shared)."""
    rows = directed(module_pairs(history)).where(F.col("shared") >= min_shared)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("shared"), "partner"))
    best = rows.withColumn("place", place).where(F.col("place") <= top)
    listed = F.sort_array(F.collect_list(F.struct("place", "partner", "shared")))
    return best.groupBy(F.col("item").alias("area")).agg(F.transform(listed, lambda x: F.struct(x["partner"].alias("partner"), x["shared"].alias("shared"))).alias("partners"))


def radius_rows(history: History) -> DataFrame:
    """``change_id, area``: distinct areas a counted change touches, areas of tests only left out."""
    only = history.areas().groupBy("area").agg(F.min("test").alias("only")).where("only").select("area")
    return history.touched_areas().join(only, "area", "left_anti").select("change_id", "area")


def change_radius(history: History) -> DataFrame:
    """One row ``measured, median, p90, local``: areas per change, by nearest rank; changes without any are not measured."""
    n = radius_rows(history).groupBy("change_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.count(F.lit(1)).alias("measured"),
        F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY n) AS bigint)").alias("median"),
        F.expr("cast(percentile_disc(0.9) WITHIN GROUP (ORDER BY n) AS bigint)").alias("p90"),
        rounded(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0))).alias("local"),
    )


def area_radius(history: History) -> DataFrame:
    """``area, changes, median``: areas per change, over the changes that touch the area."""
    rows = radius_rows(history)
    n = rows.groupBy("change_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, "change_id").groupBy("area").agg(F.count(F.lit(1)).alias("changes"), F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY n) AS bigint)").alias("median"))


def fix_density(history: History) -> DataFrame:
    """``area, changes, fixes, spanning, share``: fixes of each area's changes; share null if too few changes follow a convention.

    spanning: fixes that touch more than one area. An area of ``*`` stands for the whole history.
    """
    kinds = history.change_facts().where(F.col("size") <= history.max_size).select("change_id", "subject_kind")
    known = kinds.agg((F.count_if(F.col("subject_kind").isin("fix", "convention")) >= CONVENTION_SHARE * F.count(F.lit(1))).alias("known"))
    rows = history.touched().where(~F.col("test")).select("change_id", "area").distinct().join(shuffled(kinds), "change_id")
    spans = rows.groupBy("change_id").agg(F.count(F.lit(1)).alias("areas"))
    rows = rows.join(spans, "change_id")
    fix = F.col("subject_kind") == "fix"
    by_area = rows.groupBy("area").agg(F.count(F.lit(1)).alias("changes"), F.count_if(fix).alias("fixes"), F.count_if(fix & (F.col("areas") > 1)).alias("spanning"))
    wide = rows.where(fix & (F.col("areas") > 1)).select("change_id").distinct().agg(F.count(F.lit(1)).alias("spanning"))
    whole = kinds.agg(F.count(F.lit(1)).alias("changes"), F.count_if(fix).alias("fixes")).select(F.lit("*").alias("area"), "changes", "fixes", wide.scalar().alias("spanning"))
    out = by_area.unionByName(whole)
    return history.once("fixes", lambda: out.select("area", "changes", "fixes", "spanning", F.when(known.scalar(), rounded(share("fixes", "changes"))).alias("share")))


#: Conventional entry files of a module, at its root or in its ``src``.
CONVENTIONAL_ENTRY = r"^(index\.[cm]?[jt]sx?|mod\.rs|lib\.rs|__init__\.py)$"
BUILD = r"^(dist|build)/"


def entry_points(history: History, targets: DataFrame | None = None, globs: list[str] | None = None) -> DataFrame:
    """``item, area``: files that form each module's public interface; no tests, no configuration.

    ``globs``: the files the user points at, and nothing else. Otherwise the conventional entry
    files at a module's root or in its ``src``, and what the module's manifest names (``targets``:
    area, target): the file itself, else those with its stem, else, for a target in build output,
    the sources of that stem in ``src`` or at the root. Targets with a ``*`` are not resolved.
    """
    areas = history.areas().where(~F.col("test") & ~is_config(F.col("item")))
    if globs is not None:
        return areas.where(matches_any(F.col("item"), globs)).select("item", "area")
    folder = F.when(directory_of(F.col("item")) == "", ".").otherwise(directory_of(F.col("item")))
    source = F.when(F.col("area") == ".", "src").otherwise(F.concat("area", F.lit("/src")))
    out = areas.where((folder == F.col("area")) | (folder == source)).where(name_of(F.col("item")).rlike(CONVENTIONAL_ENTRY)).select("item", "area")
    if targets is None:
        return out
    code = areas.where(F.col("item").rlike(r"\.[cm]?[jt]sx?$"))
    stem = lambda c: F.regexp_replace(c, r"(\.d)?\.[^./]+$", "")
    under = lambda c: F.when(F.col("area") == ".", c).otherwise(F.concat_ws("/", F.col("area"), c))
    relative = F.regexp_replace("target", r"^\./", "")
    built = stem(F.regexp_replace(relative, BUILD, ""))
    places = F.array(
        F.struct(F.lit(0).alias("stage"), under(relative).alias("key")),
        F.struct(F.lit(1).alias("stage"), under(relative).alias("key")),
        F.struct(F.lit(2).alias("stage"), F.when(relative.rlike(BUILD), under(F.concat(F.lit("src/"), built))).alias("key")),
        F.struct(F.lit(3).alias("stage"), F.when(relative.rlike(BUILD), under(built)).alias("key")),
    )
    sought = targets.where(~F.col("target").contains("*")).select("area", "target", F.inline(places)).where(F.col("key").isNotNull()).distinct()
    names = code.select("area", "item", F.inline(F.array(F.struct(F.lit(True).alias("whole"), F.col("item").alias("key")), F.struct(F.lit(False).alias("whole"), stem(F.col("item")).alias("key")))))
    hits = sought.join(names, ["area", "key"]).where((F.col("stage") == 0) == F.col("whole"))
    best = hits.groupBy("area", "target").agg(F.min("stage").alias("stage"))
    return out.unionByName(hits.join(best, ["area", "target", "stage"]).select("item", "area")).distinct()


def interface_churn(history: History, entries: DataFrame | None = None) -> DataFrame:
    """``area, interface, implementation, leaked, leakage, leaky``: changes of a module's entry points and of the rest.

    leakage: share of the implementation's changes that also touch an entry point; null
    for a module without entry points or implementation changes.
    """
    entries = entries if entries is not None else entry_points(history)
    marked = history.touched().where(~F.col("test")).join(entries.select("item", F.lit(True).alias("entry")), "item", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    each = marked.groupBy("change_id", "area").agg(F.bool_or("entry").alias("entry"), F.bool_or(~F.col("entry")).alias("rest"))
    rows = each.groupBy("area").agg(F.count_if("entry").alias("interface"), F.count_if("rest").alias("implementation"), F.count_if(F.col("entry") & F.col("rest")).alias("leaked"))
    having = entries.select("area").distinct().withColumn("has", F.lit(True))
    rows = rows.join(having, "area", "left")
    exact = F.when(F.col("has"), share("leaked", "implementation"))
    leaky = F.coalesce((exact >= LEAKY) & (F.col("implementation") >= LEAKY_CHANGES), F.lit(False))
    return rows.select("area", "interface", "implementation", "leaked", rounded(exact).alias("leakage"), leaky.alias("leaky"))


def propagation_cost(history: History, depth: int = DEPTH, min_changes: int = 3, min_shared: int = MIN_SHARED, min_degree: float = MIN_DEGREE) -> DataFrame:
    """One row ``nodes, edges, cost``: mean share of the other items that a change reaches within ``depth`` couplings.

    Nodes: items that are no tests and have ``min_changes`` counted changes. The frontier grows
    by one join a hop; reached pairs are kept distinct.
    """
    nodes = history.used().groupBy("item").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_changes) & ~is_test(F.col("item"))).select("item")
    enough = (F.col("changes_a") >= min_changes) & (F.col("changes_b") >= min_changes)
    one = strong_pairs(history, min_shared, min_degree).where(enough & ~is_test(F.col("a")) & ~is_test(F.col("b"))).select("a", "b")
    one = durable(one)  # read once a hop
    edges = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = edges
    for _ in range(depth - 1):
        step = reached.select("a", F.col("b").alias("via")).join(edges.select(F.col("a").alias("via"), "b"), "via").select("a", "b").where("a <> b")
        reached = reached.unionByName(step).distinct()
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    out = reached.agg(F.count(F.lit(1)).alias("reached")).select("reached", n.scalar().alias("nodes"), one.agg(F.count(F.lit(1))).scalar().alias("edges"))
    exact = F.when(F.col("nodes") > 1, F.col("reached") / (F.col("nodes") * (F.col("nodes") - 1)))
    return out.select("nodes", "edges", rounded(exact).alias("cost"))


def changed_along(history: History, edges: DataFrame) -> DataFrame:
    """``src, dst, change_id``: the counted changes that hold both ends of each directed edge, once.

    Pairs are listed per change, of the files that are an end of some edge only: joining the
    edges with the changes of their ends would multiply a frequent file's edges by its changes.
    """
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("item")).distinct()
    used = salted_join(history.used(), ends, "item", "change_id")
    lists = used.groupBy("change_id").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    heads = lists.select("change_id", "items", F.posexplode("items").alias("i", "a")).where(F.col("i") + 1 < F.size("items"))
    pairs = heads.select("change_id", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items") - F.col("i") - 1)).alias("b"))
    sides = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return pairs.join(shuffled(sides), ["a", "b"]).select("src", "dst", "change_id")


def together(history: History, edges: DataFrame) -> DataFrame:
    """``src, dst, together``: how many counted changes hold both ends of each directed edge; edges without any are left out."""
    return changed_along(history, edges).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("together"))


def dependency_direction(history: History, edges: DataFrame, volatility: float = VOLATILITY, top: int = 50) -> DataFrame:
    """``from, to, imports, changes_from, changes_to, together, ratio, rank``: modules that import something that changes far more often.

    imports: importing files. together: counted changes in which an importing file changed with
    a file that it imports. ``to`` must have the module floor of changes and ``volatility`` times
    those of ``from``, which may be none. Tests and areas of tests only are left out. Best rank first, then
    more importing files, then the names.
    """
    owner = history.areas()
    tests = owner.groupBy("area").agg(F.min("test").alias("only")).where("only").select("area")
    owner = owner.join(tests, "area", "left_anti")
    src = owner.where(~F.col("test")).select(F.col("item").alias("src"), F.col("area").alias("from"))
    dst = owner.select(F.col("item").alias("dst"), F.col("area").alias("to"))
    rows = edges.select("src", "dst").distinct().join(shuffled(src), "src").join(shuffled(dst), "dst").where(F.col("from") != F.col("to"))
    rows = durable(rows)  # read four times
    felt = changed_along(history, rows).join(shuffled(rows), ["src", "dst"]).select("from", "to", "change_id").distinct()
    felt = felt.groupBy("from", "to").agg(F.count(F.lit(1)).alias("together"))
    tally = durable(area_tally(history.touched_areas()))  # a row per area, read from both ends
    links = rows.groupBy("from", "to").agg(F.count_distinct("src").alias("imports"))
    links = links.join(tally.select(F.col("area").alias("from"), F.col("changes").alias("changes_from")), "from", "left")
    links = links.join(tally.select(F.col("area").alias("to"), F.col("changes").alias("changes_to")), "to")
    links = links.join(felt, ["from", "to"], "left").fillna(0, ["together", "changes_from"])
    floor = module_floor(history).select("floor").scalar()
    links = links.where((F.col("changes_to") >= floor) & (F.col("changes_to") >= volatility * F.col("changes_from")))
    links = links.withColumn("ratio", rounded(F.col("changes_to") / F.greatest(F.lit(1), F.col("changes_from"))))
    links = links.withColumn("exact", F.log2("ratio") * F.log2(1 + F.col("together"))).orderBy(F.desc("exact"), F.desc("imports"), "from", "to").limit(top)
    return links.select("from", "to", "imports", "changes_from", "changes_to", "together", "ratio", rounded("exact").alias("rank"))


def unstable_interfaces(history: History, edges: DataFrame, fan_in: int = FAN_IN, least: int = INTERFACE_CHANGES, top: int | None = 50, shown: int = 5) -> DataFrame:
    """``item, module, fan_in, changes, typical, changed_dependents, dependents``: files that many import and that change more than their importers.

    changes: logical changes of any size; they must exceed typical, the floor of the median over the
    importers. Tests import nothing here and are no interfaces. A dependent is changed if it
    shares a counted change with the item; dependents: the ``shown`` that share most, with how many.
    The best ``top`` are listed, all where it is None.
    """
    links = edges.where("src <> dst").select("src", "dst").distinct().where(~is_test(F.col("src")) & ~is_test(F.col("dst")))
    changes = history.held().groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    rows = links.join(changes.select(F.col("item").alias("src"), "n"), "src", "left").fillna(0, ["n"])
    hubs = rows.groupBy("dst").agg(F.count(F.lit(1)).alias("fan_in"), F.floor(F.median("n")).alias("typical"))
    hubs = hubs.join(changes.select(F.col("item").alias("dst"), F.col("n").alias("changes")), "dst")
    hubs = hubs.where((F.col("fan_in") >= fan_in) & (F.col("changes") >= least) & (F.col("changes") > F.col("typical")))
    mine = links.join(hubs.select("dst"), "dst", "left_semi")
    shared = changed_along(history, mine).groupBy("dst", "src").agg(F.count(F.lit(1)).alias("k"))
    place = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("k"), "src"))
    counts = shared.groupBy("dst").agg(F.count(F.lit(1)).alias("changed_dependents"))
    best = shared.withColumn("place", place).where(F.col("place") <= shown)
    best = best.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("place", F.col("src").alias("item"), F.col("k").alias("shared")))).alias("d"))
    hubs = hubs.join(counts, "dst", "left").join(best, "dst", "left").fillna(0, ["changed_dependents"])
    hubs = hubs.join(shuffled(history.areas().select(F.col("item").alias("dst"), F.col("area").alias("module"))), "dst", "left")
    shown_ = F.transform(F.coalesce("d", F.array().cast("array<struct<place:int,item:string,shared:bigint>>")), lambda x: F.struct(x["item"].alias("item"), x["shared"].alias("shared")))
    rows = hubs.select(F.col("dst").alias("item"), F.coalesce("module", F.lit(ROOT)).alias("module"), "fan_in", "changes", "typical", "changed_dependents", shown_.alias("dependents"))
    return rows if top is None else rows.orderBy(F.desc("changed_dependents"), F.desc("changes"), F.desc("fan_in"), "item").limit(top)


#: What a judgement of all areas reads several times: at most a row per change and area.
JUDGING = ("touched_areas", "cohesion", "module_pairs")

#: A design that erodes is judged one level worse.
WORSE = {"holds": "mixed", "mixed": "strained", "strained": "strained", "unknown": "unknown"}


def standings(history: History, holds: float = 0.75) -> DataFrame:
    """``area, heat_share, state``: whether each real module holds or leaks, or is unjudged.

    heat_share: rounded part of all production heat, that of the root area and of areas of tests only included in
    the whole. Below the module floor or without a counted change an area is unjudged; above ``holds``
    containment it holds, else it leaks if it has a partner and is unjudged without one.
    """
    from tidemark.operators.coupling import strongest_partner
    from tidemark.operators.hotspots import item_heat

    heat = item_heat(history).groupBy(F.col("module").alias("area")).agg(F.sum("production_heat").alias("heat"))
    total = heat.agg(F.sum("heat")).scalar()
    rows = cohesion(history).where(~F.col("test_only") & (F.col("area") != ROOT)).join(heat, "area", "left")
    rows = rows.join(strongest_partner(None, pairs=module_pairs(history)).select("area", F.lit(True).alias("paired")), "area", "left")
    floor = module_floor(history).select("floor").scalar()
    exact = share("local", "changes")
    state = F.when(exact.isNull() | (F.col("changes") < floor), "unjudged").when(exact > holds, "holds").when(F.col("paired"), "leaks").otherwise("unjudged")
    return rows.select("area", F.coalesce(rounded(share(F.coalesce("heat", F.lit(0)), total)), F.lit(0.0)).alias("heat_share"), state.alias("state"))


def verdict(history: History, holds: float = 0.75, min_coverage: float = 0.5, mixed: float = 0.2, strained: float = 0.5, areas: DataFrame | None = None) -> DataFrame:
    """One row ``level, reason, leak_share, coverage, eroding, judged, leaking``: whether the design holds up to the way the code changes.

    ``areas``: area, heat_share, state, of modules (:func:`standings`) unless others are given.
    Shares are parts of **all** heat, at most 1, and levels follow from them as rounded: unknown below
    ``min_coverage`` judged heat, else holds, mixed from ``mixed`` and strained from ``strained`` leaking heat on;
    one level worse if the history erodes. judged and leaking: names, hottest first.
    reason, where the level is unknown: no-territories, quiet-window (no counted change) or too-little-evidence.
    """
    from tidemark.operators.trends import repository_erosion

    history = history.keeping(*JUDGING)
    rows = areas if areas is not None else standings(history, holds)
    judged, leaking = F.col("state") != "unjudged", F.col("state") == "leaks"
    listed = lambda which: F.transform(F.sort_array(F.collect_list(F.when(which, F.struct(-F.col("heat_share"), "area")))), lambda x: x["area"])
    part = lambda which: rounded(F.least(F.lit(1.0), F.coalesce(F.sum(F.when(which, F.col("heat_share"))), F.lit(0.0))))
    total = rows.agg(F.count(F.lit(1)).alias("n"), listed(judged).alias("judged"), listed(leaking).alias("leaking"), part(judged).alias("coverage"), part(leaking).alias("leak_share"))
    total = total.withColumn("eroding", F.coalesce(repository_erosion(history).select(F.col("verdict") == "eroding").scalar(), F.lit(False)))
    changed = history.counted().agg(F.count(F.lit(1))).scalar()
    base = F.when((F.size("judged") == 0) | (F.col("coverage") < min_coverage), "unknown").when(F.col("leak_share") < mixed, "holds").when(F.col("leak_share") < strained, "mixed").otherwise("strained")
    worse = F.create_map(*[F.lit(x) for pair in WORSE.items() for x in pair])
    total = total.withColumn("base", base).withColumn("level", F.when(F.col("eroding"), F.element_at(worse, F.col("base"))).otherwise(F.col("base")))
    reason = F.when(F.col("level") == "unknown", F.when(F.col("n") == 0, "no-territories").when(changed == 0, "quiet-window").otherwise("too-little-evidence"))
    return total.select("level", reason.alias("reason"), "leak_share", "coverage", "eroding", "judged", "leaking")
