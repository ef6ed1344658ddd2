"""Which items and areas change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded
from tidemark.functions.paths import directory_distance, is_contract, is_test, is_test_pair
from tidemark.operators.history import ROOT, History, named_pairs, pair_counts
from tidemark.operators.skew import shuffled

MIN_SHARED, MIN_DEGREE = 3, 0.3
UBIQUITOUS_SHARE, UBIQUITOUS_MIN = 0.3, 10
LOCAL_DISTANCE, HIDDEN_BOOST, FULL_EVIDENCE = 3, 1.5, 10


def all_pairs(history: History) -> DataFrame:
    """``a, b, shared, changes_a, changes_b`` of all items with a counted change in common."""
    return history.once("pairs", lambda: named_pairs(pair_counts(history.used()), history.used()))


def degree(shared: Column, a: Column, b: Column) -> Column:
    """Shared changes over the mean of both items' changes."""
    return shared / ((a + b) / 2)


def strong_pairs(history: History, min_shared: int = MIN_SHARED, min_degree: float = MIN_DEGREE) -> DataFrame:
    """The pairs of :func:`all_pairs` at or above both thresholds, with their degree as ``exact``."""
    pairs = all_pairs(history).where(F.col("shared") >= min_shared)
    return pairs.withColumn("exact", degree(F.col("shared"), F.col("changes_a"), F.col("changes_b"))).where(F.col("exact") >= min_degree)


def couplings(history: History, min_shared: int = MIN_SHARED, min_degree: float = MIN_DEGREE) -> DataFrame:
    """``a, b, shared, degree, distance, test_pair, crosses_module, kind``: pairs at or above both thresholds."""
    if (min_shared, min_degree) == (MIN_SHARED, MIN_DEGREE):
        return history.once("couplings", lambda: _couplings(history, min_shared, min_degree))
    return _couplings(history, min_shared, min_degree)


def _couplings(history: History, min_shared: int, min_degree: float) -> DataFrame:
    pairs = strong_pairs(history, min_shared, min_degree)
    areas = history.areas()
    side = lambda x: areas.select(F.col("item").alias(x), F.col("area").alias(f"area_{x}"))
    rows = pairs.join(shuffled(side("a")), "a", "left").join(shuffled(side("b")), "b", "left")
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "a",
        "b",
        "shared",
        rounded("exact").alias("degree"),
        directory_distance(a, b).alias("distance"),
        is_test_pair(a, b).alias("test_pair"),
        (F.coalesce("area_a", F.lit(ROOT)) != F.coalesce("area_b", F.lit(ROOT))).alias("crosses_module"),
        F.when(is_contract(a) | is_contract(b), "contract").otherwise("code").alias("kind"),
    )


def breadth(history: History) -> DataFrame:
    """``item, breadth``: distinct other items that share a counted change; items that share none are left out."""
    pairs = all_pairs(history)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("item"))
    return ends.groupBy("item").agg(F.count(F.lit(1)).alias("breadth"))


def directed(pairs: DataFrame) -> DataFrame:
    """``item, partner, shared, own, theirs``: each pair from both ends."""
    one = pairs.select(F.col("a").alias("item"), F.col("b").alias("partner"), "shared", F.col("changes_a").alias("own"), F.col("changes_b").alias("theirs"))
    other = pairs.select(F.col("b").alias("item"), F.col("a").alias("partner"), "shared", F.col("changes_b").alias("own"), F.col("changes_a").alias("theirs"))
    return one.unionByName(other)


def partners(history: History, top: int = 5, min_shared: int = MIN_SHARED, min_degree: float = MIN_DEGREE) -> DataFrame:
    """``item, place, partner, shared, probability``: the most probable partners of each coupled item.

    probability: share of the item's counted changes that hold the partner. Ties go to more
    shared changes, then the smaller path. An item has few couplings, however frequent it is: a
    partner shares at least d/2 of its changes, and a change of m files serves m - 1 partners,
    so there are at most 2 (m - 1) / d of them: 326 for m = 50 and d = 0.3.
    """
    rows = directed(strong_pairs(history, min_shared, min_degree)).withColumn("p", F.col("shared") / F.col("own"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("p"), F.desc("shared"), "partner"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= top).select("item", "place", "partner", "shared", rounded("p").alias("probability"))


def ubiquitous(history: History, least: float = UBIQUITOUS_SHARE, least_changes: int = UBIQUITOUS_MIN) -> DataFrame:
    """``item, changes, share``: items in more than ``least`` of all counted changes, and in ``least_changes`` at least."""
    total = history.counted().select(F.count(F.lit(1))).scalar()
    rows = history.used().groupBy("item").agg(F.count(F.lit(1)).alias("changes")).withColumn("total", total)
    rows = rows.where((F.col("changes") >= least_changes) & (F.col("changes") > least * F.col("total")))
    return rows.select("item", "changes", rounded(F.col("changes") / F.col("total")).alias("share"))


def without_items(history: History, gone: DataFrame) -> History:
    """The history without the given items; sizes of changes stay what they were."""
    return History(history.changes, history.change_items.join(gone.select("item").distinct(), "item", "left_anti"), history.items, history.max_size)


def area_pairs(touched: DataFrame) -> DataFrame:
    """``a, b, shared, changes_a, changes_b`` of areas; of any rows with ``change_id, area``."""
    used = touched.select("change_id", F.col("area").alias("item")).distinct()
    return named_pairs(pair_counts(used), used)


def module_pairs(history: History) -> DataFrame:
    """:func:`area_pairs` of all modules of a history."""
    return history.once("module_pairs", lambda: area_pairs(history.touched_areas()))


def ranked_touched(history: History) -> DataFrame:
    """``change_id, area``: the ranked areas of every counted change, once; see :func:`tidemark.operators.modules.cohesion`.

    The others stay out of comparisons between areas: a handful of changes makes any share large, and tests go with everything.
    """
    from tidemark.operators.modules import cohesion

    ranked = cohesion(history).where("ranked").select("area")
    return history.once("ranked", lambda: history.touched_areas().join(ranked, "area", "left_semi").select("change_id", "area"))


def module_couplings(history: History, min_shared: int = MIN_SHARED, top: int = 200) -> DataFrame:
    """``a, b, shared, share``: the strongest pairs of ranked modules; share of the less changed one's changes."""
    pairs = area_pairs(ranked_touched(history)).where(F.col("shared") >= min_shared)
    exact = F.col("shared") / F.least("changes_a", "changes_b")
    return pairs.select("a", "b", "shared", exact.alias("exact")).orderBy(F.desc("exact"), F.desc("shared"), "a", "b").limit(top).select("a", "b", "shared", rounded("exact").alias("share"))


def strongest_partner(touched: DataFrame | None, min_shared: int = MIN_SHARED, pairs: DataFrame | None = None) -> DataFrame:
    """``area, partner, shared``: the area that each shares most changes with, ties to the smaller name; from ``pairs`` of areas where they are at hand."""
    rows = directed(area_pairs(touched) if pairs is None else pairs).where(F.col("shared") >= min_shared)
    best = rows.groupBy("item").agg(F.min_by("partner", F.struct(-F.col("shared"), F.col("partner"))).alias("partner"), F.max("shared").alias("shared"))
    return best.select(F.col("item").alias("area"), "partner", "shared")


def distant_couplings(history: History, imports: DataFrame, min_shared: int = MIN_SHARED, min_degree: float = MIN_DEGREE, top: int = 50) -> DataFrame:
    """``a, b, shared, degree, reach, hidden, score``: couplings across modules or far apart in one, best first.

    score = degree * reach * (1.5 if no import links them) * min(1, shared / 10), of the rounded
    degree; reach is 1 + log2(1 + module hops) across modules, else the distance over the largest
    of all. Equal scores go by degree, shared changes and path. Tests
    and pairs of two contracts are left out. ``imports``: a, b, relation; a relation that is
    missing or null is unknown, which is not hidden.
    """
    rows = couplings(history, min_shared, min_degree).where(~F.col("test_pair"))
    a, b = F.col("a"), F.col("b")
    rows = rows.where(~is_test(a) & ~is_test(b) & ~(is_contract(a) & is_contract(b)))
    areas = history.areas()
    for x in ("a", "b"):
        rows = rows.join(shuffled(areas.select(F.col("item").alias(x), F.col("area").alias(f"area_{x}"))), x, "left")
    rows = rows.join(imports.select("a", "b", "relation"), ["a", "b"], "left")
    rows = rows.where(F.col("crosses_module") | (F.col("distance") >= LOCAL_DISTANCE))
    widest = rows.select(F.greatest(F.max("distance"), F.lit(1))).scalar()
    # a file in the module's directory; the root's directory is no step of its own
    probe = lambda x: F.when(F.coalesce(F.col(x), F.lit(ROOT)) == ROOT, "_").otherwise(F.concat(x, F.lit("/_")))
    hops = directory_distance(probe("area_a"), probe("area_b"))
    reach = F.when(F.col("crosses_module"), 1 + F.log2(1 + hops)).otherwise(F.col("distance") / widest)
    hidden = F.coalesce(F.col("relation") == "none", F.lit(False))
    rows = rows.withColumn("reach", reach).withColumn("hidden", hidden)
    score = F.col("degree") * F.col("reach") * F.when(F.col("hidden"), HIDDEN_BOOST).otherwise(1.0) * F.least(F.lit(1.0), F.col("shared") / FULL_EVIDENCE)
    ranked = rows.withColumn("score", rounded(score)).orderBy(F.desc("score"), F.desc("degree"), F.desc("shared"), "a", "b").limit(top)
    return ranked.select("a", "b", "shared", "degree", rounded("reach").alias("reach"), "hidden", "score")


def crossing_pairs(history: History, min_shared: int = MIN_SHARED, min_degree: float = MIN_DEGREE) -> DataFrame:
    """``a, b, couplings, shared``: couplings of items in two different modules, summed by pair of modules."""
    rows = couplings(history, min_shared, min_degree).where("crosses_module")
    areas = history.areas()
    for x in ("a", "b"):
        rows = rows.join(shuffled(areas.select(F.col("item").alias(x), F.col("area").alias(f"area_{x}"))), x, "left").withColumn(f"area_{x}", F.coalesce(f"area_{x}", F.lit(ROOT)))
    return rows.groupBy(F.least("area_a", "area_b").alias("a"), F.greatest("area_a", "area_b").alias("b")).agg(F.count(F.lit(1)).alias("couplings"), F.sum("shared").alias("shared"))


def territory_pairs(history: History, hottest: int = 24, min_shared: int = MIN_SHARED) -> DataFrame:
    """``a, b, shared, share``: pairs of ranked areas among those of most production heat, ties to the smaller name."""
    from tidemark.operators.hotspots import item_heat

    hot = item_heat(history).groupBy(F.col("module").alias("area")).agg(F.sum("production_heat").alias("heat")).orderBy(F.desc("heat"), "area").limit(hottest)
    pairs = area_pairs(ranked_touched(history)).where(F.col("shared") >= min_shared)
    for x in ("a", "b"):
        pairs = pairs.join(hot.select(F.col("area").alias(x)), x, "left_semi")
    return pairs.select("a", "b", "shared", rounded(F.col("shared") / F.least("changes_a", "changes_b")).alias("share"))
