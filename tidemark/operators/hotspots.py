"""Where change concentrates: activity, hotspot scores, ranks, heat and its kinds over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded, share
from tidemark.functions.paths import is_test
from tidemark.operators.heavy import value_ranks
from tidemark.operators.history import History
from tidemark.operators.skew import shuffled

HUB_BREADTH, HUB_CHANGES, HUB_SHARE = 10, 5, 0.05
HOT_SHARE = 0.1
ACTIVE_CHANGES = 10
BANDS = (0.02, 0.05, 0.10, 0.20, 0.35, 0.50, 0.70)


def item_activity(commit_files: DataFrame, commits: DataFrame, history: History, kinds: DataFrame | None = None, lives: DataFrame | None = None) -> DataFrame:
    """``path, revisions, lines_added, lines_deleted, changes``: real commits and lines of each path, and its logical changes of any size.

    A commit is real if it has no mechanical kind (``kinds``: sha, kind), or, where none are given, if a row of it in
    ``commits`` is no pure move. With ``lives`` (sha, path, today, earlier) activity counts for the path that the
    file has today, and that of earlier files of the name for nobody. Exact copies of a row count
    once; null line counts are 0.
    """
    real = commits.where(~F.col("move_only") & F.col("sha").isNotNull()).select("sha").distinct() if kinds is None else kinds.where(F.col("kind").isNull()).select("sha")
    rows = commit_files.where(F.col("path").isNotNull()).select("sha", "path", "added", "deleted")
    if lives is None:
        rows = rows.distinct().join(real, "sha", "left_semi")
    else:
        # both sides are dealt out by sha at once, so that what follows up to a file's lines shuffles neither again
        today = lives.where(~F.col("earlier")).select("sha", "path", "today")
        both = rows.withColumn("counts", F.lit(True)).unionByName(today, allowMissingColumns=True).repartition("sha").distinct().join(shuffled(real), "sha", "left_semi")
        named = both.groupBy("sha", "path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max("today").alias("today"), F.bool_or("counts").alias("counts"))
        rows = named.where(F.col("counts") & F.col("today").isNotNull()).select("sha", F.col("today").alias("path"), "added", "deleted")
    each = rows.groupBy("path", "sha").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    lines = each.groupBy("path").agg(F.count(F.lit(1)).alias("revisions"), F.coalesce(F.sum("added"), F.lit(0)).alias("lines_added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("lines_deleted"))
    changes = history.held().groupBy(F.col("item").alias("path")).agg(F.count(F.lit(1)).alias("changes"))
    return lines.join(changes, "path", "left").fillna(0, ["changes"])


def _norm(x: Column, most: Column) -> Column:
    return F.when(most > 0, F.log1p(x) / F.log1p(most)).otherwise(0.0)


def hotspot_scores(history: History) -> DataFrame:
    """``path, revisions, size, score``: normalised revisions times normalised size (loc + complexity), exact.

    Items that are tests are scored as well; missing sizes and revisions count 0. The maxima
    come from one aggregate, not from a window over all rows.
    """
    rows = history.facts().select("path", "module", "test", F.coalesce("revisions", F.lit(0)).alias("revisions"), (F.coalesce("loc", F.lit(0)) + F.coalesce("complexity", F.lit(0))).alias("size"), F.coalesce("breadth", F.lit(0)).alias("breadth"), F.coalesce("changes", F.lit(0)).alias("changes"))
    most = rows.agg(F.max("revisions").alias("most_revisions"), F.max("size").alias("most_size"))
    rows = rows.withColumns({"mr": most.select("most_revisions").scalar(), "ms": most.select("most_size").scalar()})
    return history.once("scores", lambda: rows.withColumn("score", _norm(F.col("revisions"), F.col("mr")) * _norm(F.col("size"), F.col("ms"))).drop("mr", "ms"))


def hotspots(history: History, top: int = 50) -> DataFrame:
    """``path, revisions, size, score, rank``: the best scores, ties to the smaller path."""
    best = hotspot_scores(history).orderBy(F.desc("score"), "path").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "path"))
    return best.select("path", "revisions", "size", rounded("score").alias("score"), place.cast("long").alias("rank"))


def module_ranks(history: History) -> DataFrame:
    """``path, module, revision_rank, size_rank``: competition ranks within each module."""
    rows = hotspot_scores(history)
    for column in ("revisions", "size"):
        ranks = value_ranks(rows, "module", column).select("module", column, F.col("rank").alias(f"{column.removesuffix('s')}_rank"))
        rows = rows.join(ranks, ["module", column])
    return rows.select("path", "module", F.col("revision_rank"), "size_rank")


def hubs(history: History) -> DataFrame:
    """``path, breadth, changes``: frequently changed files, no tests, among the widest 5 %; ties at the cut are in."""
    candidates = hotspot_scores(history).where((F.col("changes") >= HUB_CHANGES) & ~F.col("test"))
    rows = candidates.join(value_ranks(candidates, None, "breadth"), "breadth")
    rows = rows.where((F.col("breadth") >= HUB_BREADTH) & (F.col("rank") <= F.ceil(F.col("total") * HUB_SHARE)))
    return rows.select("path", "breadth", "changes")


def reasons(history: History, top: int = 50) -> DataFrame:
    """``path, reasons``: why the best-scored files stand out, in a fixed order; a signal at zero gives none."""
    scored = hotspot_scores(history)
    total = scored.agg(F.count(F.lit(1))).scalar()
    best = scored.orderBy(F.desc("score"), "path").limit(top).withColumn("of", total)
    wide = hubs(history).select("path", F.lit(True).alias("hub"))
    best = best.join(wide, "path", "left")
    changed = F.when(F.col("revisions") > 0, F.format_string("changed in %d %s of %d files", "revisions", F.when(F.col("revisions") == 1, "commit").otherwise("commits"), "of"))
    large = F.when(F.col("size") > 0, F.format_string("size %d", "size"))
    hub = F.when(F.col("hub"), F.format_string("changes together with %d different files", "breadth"))
    return best.select("path", F.array_join(F.array_compact(F.array(changed, large, hub)), "; ").alias("reasons"))


def item_heat(history: History) -> DataFrame:
    """``path, module, heat, production_heat``: changes times size; tests have no production heat."""
    rows = hotspot_scores(history).withColumn("heat", F.col("changes") * F.col("size"))
    return rows.select("path", "module", "heat", F.when(F.col("test"), 0).otherwise(F.col("heat")).alias("production_heat"))


def concentration(history: History, top: int = 3) -> DataFrame:
    """One row ``top, share``: part of all production heat in the hottest modules."""
    by = item_heat(history).groupBy("module").agg(F.sum("production_heat").alias("heat"))
    total = by.agg(F.sum("heat")).scalar()
    best = by.orderBy(F.desc("heat"), "module").limit(top).agg(F.sum("heat").alias("hot"))
    return best.select(F.lit(top).cast("long").alias("top"), rounded(share(F.col("hot"), total)).alias("share"))


def heat_bands(history: History) -> DataFrame:
    """``path, band``: percentile band of a file's score, 1 the hottest; 8 for the rest and for a score of 0."""
    scored = hotspot_scores(history).where(F.col("score") > 0)
    places = value_ranks(scored, None, "score")
    part = (F.col("rank") - 1) / F.col("total")
    band = F.when(part < BANDS[0], 1)
    for i, edge in enumerate(BANDS[1:], 2):
        band = band.when(part < edge, i)
    rows = hotspot_scores(history).select("path", "score").join(places, "score", "left")
    return rows.select("path", F.coalesce(F.when(F.col("rank").isNotNull(), band.otherwise(8)), F.lit(8)).cast("long").alias("band"))


def slice_scores(history: History) -> DataFrame:
    """``slice, path, changes, score``: activity times size within each time slice; tests are left out."""
    facts = history.change_facts().where(F.col("slice").isNotNull() & (F.col("size") <= history.max_size)).select("change_id", "slice")
    files = history.facts().where(~F.col("test")).select("path", (F.coalesce("loc", F.lit(0)) + F.coalesce("complexity", F.lit(0))).alias("bulk"))
    rows = history.held().join(shuffled(facts), "change_id").groupBy("slice", F.col("item").alias("path")).agg(F.count(F.lit(1)).alias("changes"))
    rows = rows.join(shuffled(files), "path")
    most = rows.groupBy("slice").agg(F.max("changes").alias("mc"), F.max("bulk").alias("mb"))
    rows = rows.join(F.broadcast(most), "slice")  # a row per slice: twelve at most
    return rows.select("slice", "path", "changes", (_norm(F.col("changes"), F.col("mc")) * _norm(F.col("bulk"), F.col("mb"))).alias("score"))


def hot_items(history: History) -> DataFrame:
    """``slice, path, score``: files at or above the score of rank ceil(10 % n) of their slice, score above 0.

    Ranks come from the distinct scores of a slice, so no window holds all files of one.
    """
    rows = slice_scores(history).withColumn("score", F.round("score", 12))
    ranks = value_ranks(rows, "slice", "score")
    cut = ranks.where((F.col("rank") <= F.ceil(F.col("total") * HOT_SHARE)) & (F.col("score") > 0)).groupBy("slice").agg(F.min("score").alias("least"))
    hot = rows.join(F.broadcast(cut), "slice").where(F.col("score") >= F.col("least"))  # a row per slice
    return hot.select("slice", "path", rounded("score").alias("score"))


def active_slices(history: History) -> DataFrame:
    """``slice, changes, active``: counted changes of each slice; active from ten on."""
    facts = history.change_facts().where(F.col("slice").isNotNull() & (F.col("size") <= history.max_size))
    return facts.groupBy("slice").agg(F.count(F.lit(1)).alias("changes")).withColumn("active", F.col("changes") >= ACTIVE_CHANGES)


def heat_kinds(history: History) -> DataFrame:
    """``path, first, active, hot, kind``: chronic, acute or other, over the active slices from a file's first change on.

    The series runs from its first to its last slice, and its last two are now, active or not; only
    active ones count. chronic: of at least three earlier slices that count half were hot, and half of
    all that count. acute: hot in both of the last two, with an earlier active slice, and not hot in half of the
    earlier ones. Slices are few and known, so their numbers go along as an array.
    """
    series = active_slices(history)
    slices = series.where("active").agg(F.sort_array(F.collect_list("slice")).alias("slices")).scalar()
    newest = history.change_facts().agg(F.max("slice")).scalar()
    touched = slice_scores(history).groupBy("path").agg(F.min("slice").alias("first"))
    hot = hot_items(history).groupBy("path").agg(F.collect_set("slice").alias("hot"))
    rows = touched.join(hot, "path", "left").withColumn("all", F.coalesce(slices, F.array().cast("array<int>"))).withColumn("newest", newest)
    rows = rows.withColumn("counting", F.filter("all", lambda s: s >= F.col("first")))
    last = F.filter("all", lambda s: s >= F.col("newest") - 1)
    rows = rows.withColumn("last", last).withColumn("earlier", F.array_except("counting", "last"))
    none = F.array().cast("array<int>")
    rows = rows.withColumn("hot", F.coalesce("hot", none))
    hot_all = F.size(F.array_intersect("counting", "hot"))
    hot_earlier = F.size(F.array_intersect("earlier", "hot"))
    both = F.size(F.array_intersect("last", "hot")) == 2
    chronic = (F.size("earlier") >= 3) & (2 * hot_earlier >= F.size("earlier")) & (2 * hot_all >= F.size("counting"))
    acute = both & (F.size(F.array_except("all", "last")) > 0) & ~(2 * hot_earlier >= F.greatest(F.size("earlier"), F.lit(1)))
    kind = F.when(chronic, "chronic").when(acute, "acute").otherwise("other")
    return history.once("heat_kinds", lambda: rows.select("path", F.col("first").cast("long").alias("first"), F.size("counting").cast("long").alias("active"), hot_all.cast("long").alias("hot"), kind.alias("kind")))


def window_trends(history: History, before: str = "before", now: str = "current") -> DataFrame:
    """``item, was, is, delta``: counted changes of each item in two windows; an item of one window has 0 in the other."""
    facts = history.change_facts().where((F.col("size") <= history.max_size) & F.col("window_id").isin(before, now)).select("change_id", "window_id")
    rows = history.held().join(shuffled(facts), "change_id").groupBy("item").agg(F.count_if(F.col("window_id") == before).alias("was"), F.count_if(F.col("window_id") == now).alias("is"))
    return rows.withColumn("delta", F.col("is") - F.col("was"))


def territory_heat(history: History) -> DataFrame:
    """``directory, files, tests, changes, heat, share``: every directory with all that lies below it; the root is ``.``.

    Each file goes to its ancestors (as many as its path is deep); the changes of a
    directory are the distinct ones, de-duplicated before they are counted.
    """
    from tidemark.functions.paths import ancestors_of

    heat = item_heat(history)
    files = history.facts().select("path", "test").join(heat.select("path", "production_heat"), "path")
    up = files.select(F.explode(ancestors_of(F.col("path"))).alias("directory"), "path", "test", "production_heat")
    sums = up.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.count_if("test").alias("tests"), F.sum("production_heat").alias("heat"))
    known = history.used().join(files.select(F.col("path").alias("item")), "item", "left_semi")
    touched = known.select("change_id", F.explode(ancestors_of(F.col("item"))).alias("directory")).distinct().groupBy("directory").agg(F.count(F.lit(1)).alias("changes"))
    total = heat.agg(F.sum("production_heat")).scalar()
    rows = sums.join(touched, "directory", "left").fillna(0, ["changes"])
    return rows.select("directory", "files", "tests", "changes", "heat", rounded(share(F.col("heat"), total)).alias("share"))


def fan_in(edges: DataFrame) -> DataFrame:
    """``item, dependents``: distinct importers of each file, itself excluded."""
    return edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("item")).agg(F.count(F.lit(1)).alias("dependents"))


def production_items(history: History) -> DataFrame:
    """``path``: items that are no tests, by mark or by path."""
    return history.facts().where(~F.col("test") & ~is_test(F.col("path"))).select("path")


def chronic_heat(history: History) -> DataFrame:
    """``area, chronic, acute, share``: chronic and acute files of each module, and the chronic ones' part of its production heat."""
    rows = item_heat(history).join(heat_kinds(history).select("path", "kind"), "path", "left")
    chronic = F.col("kind") == "chronic"
    by = rows.groupBy(F.col("module").alias("area")).agg(F.count_if(chronic).alias("chronic"), F.count_if(F.col("kind") == "acute").alias("acute"), F.sum(F.when(chronic, F.col("production_heat")).otherwise(0)).alias("hot"), F.sum("production_heat").alias("heat"))
    return by.select("area", "chronic", "acute", rounded(share("hot", "heat")).alias("share"))
