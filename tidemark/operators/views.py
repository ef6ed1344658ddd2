"""Read-outs of a history that lists and panels show: what leaks, what changes together, what stands out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded, share
from tidemark.functions.paths import is_contract
from tidemark.operators import coupling, hotspots, modules, textual, trends
from tidemark.operators.history import ROOT, History
from tidemark.operators.skew import shuffled

LEAST_COHESIVE, OVERVIEW = 5, 10


def leaking_entry_points(history: History, entries: DataFrame | None = None) -> DataFrame:
    """``item, area, leakage``: entry points of leaky modules that changed at least once together with the module's implementation.

    A module of tests only has no interface to judge; an entry point that never changes along is not to blame.
    """
    entries = entries if entries is not None else modules.entry_points(history)
    only = history.areas().groupBy("area").agg(F.min("test").alias("only")).where("only").select("area")
    leaky = modules.interface_churn(history, entries).where("leaky").select("area", "leakage").join(only, "area", "left_anti")
    marked = history.touched().where(~F.col("test")).join(entries.select("item", F.lit(True).alias("entry")), "item", "left")
    rest = marked.where(F.col("entry").isNull()).select("change_id", "area").distinct()
    blamed = marked.where("entry").select("change_id", "area", "item").join(rest, ["change_id", "area"], "left_semi").select("item", "area").distinct()
    return blamed.join(leaky, "area").select("item", "area", "leakage")


def contract_activity(commit_files: DataFrame, commits: DataFrame, history: History) -> DataFrame:
    """``path, module, revisions, changes, lines_added, lines_deleted``: the record of every contract file of the history; they get no score."""
    activity = hotspots.item_activity(commit_files.where(is_contract(F.col("path"))), commits, history)
    homes = history.areas().select(F.col("item").alias("path"), F.col("area").alias("module"))
    rows = activity.join(homes, "path", "left")
    return rows.select("path", F.coalesce("module", F.lit(ROOT)).alias("module"), "revisions", "changes", "lines_added", "lines_deleted")


def weak_structure(history: History) -> DataFrame:
    """``area, heat_share, containment, leaks, partner, partner_share``: the judged modules, and where their changes reach most.

    partner_share: share of the module's changes that touch the partner too.
    """
    history = history.keeping(*modules.JUDGING)
    judged = modules.standings(history).where("state <> 'unjudged'")
    held = modules.cohesion(history).select("area", F.col("cohesion").alias("containment"), "changes")
    best = coupling.strongest_partner(None, pairs=coupling.module_pairs(history))
    rows = judged.join(held, "area").join(best, "area", "left")
    return rows.select("area", "heat_share", "containment", (F.col("state") == "leaks").alias("leaks"), "partner", rounded(share("shared", "changes")).alias("partner_share"))


def co_change(history: History, imports: DataFrame, min_shared: int = coupling.MIN_SHARED) -> DataFrame:
    """``a, b, shared, file_pairs, hidden_pairs``: pairs of hot ranked modules, the hotter first, with the distant file couplings between them.

    hidden_pairs: those of the file pairs that no import links; ``imports`` as for distant couplings.
    """
    from tidemark.operators.hotspots import item_heat

    pairs = coupling.territory_pairs(history, min_shared=min_shared).select("a", "b", "shared")
    files = coupling.couplings(history).where(~F.col("test_pair") & F.col("crosses_module")).select("a", "b", "kind")
    from tidemark.functions.paths import is_test

    files = files.where(~is_test(F.col("a")) & ~is_test(F.col("b")) & ~(is_contract(F.col("a")) & is_contract(F.col("b"))))
    files = files.join(imports.select("a", "b", "relation"), ["a", "b"], "left")
    areas = history.areas()
    for x in ("a", "b"):
        files = files.join(shuffled(areas.select(F.col("item").alias(x), F.col("area").alias(f"area_{x}"))), x, "left").withColumn(f"area_{x}", F.coalesce(f"area_{x}", F.lit(ROOT)))
    between = files.groupBy(F.least("area_a", "area_b").alias("a"), F.greatest("area_a", "area_b").alias("b")).agg(F.count(F.lit(1)).alias("file_pairs"), F.count_if(F.col("relation") == "none").alias("hidden_pairs"))
    heat = item_heat(history).groupBy(F.col("module").alias("area")).agg(F.sum("production_heat").alias("heat"))
    rows = pairs.join(between, ["a", "b"], "left").fillna(0, ["file_pairs", "hidden_pairs"])
    for x in ("a", "b"):
        rows = rows.join(heat.select(F.col("area").alias(x), F.col("heat").alias(f"heat_{x}")), x, "left")
    first = F.col("heat_a") >= F.col("heat_b")
    return rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "shared", "file_pairs", "hidden_pairs")


def least_cohesive(history: History, most: int = LEAST_COHESIVE) -> DataFrame:
    """``area, changes, cohesion``: the ranked modules whose changes stay inside least; ties go to more changes, then the name."""
    return modules.cohesion(history).where("ranked").orderBy("cohesion", F.desc("changes"), "area").limit(most).select("area", "changes", "cohesion")


def overview_hotspots(history: History, include_tests: bool = False, most: int = OVERVIEW) -> DataFrame:
    """``path, score, includes_tests, toggleable``: the top files, tests left out unless asked for or nothing else is there."""
    rows = hotspots.hotspot_scores(history)
    counts = rows.agg(F.count_if("test").alias("tests"), F.count_if(~F.col("test")).alias("rest"))
    tests, rest = counts.select("tests").scalar(), counts.select("rest").scalar()
    with_tests = F.lit(include_tests) | (rest == 0)
    kept = rows.where(with_tests | ~F.col("test")).orderBy(F.desc("score"), "path").limit(most)
    return kept.select("path", rounded("score").alias("score"), with_tests.alias("includes_tests"), ((rest > 0) & (tests > 0)).alias("toggleable"))


def thresholds(history: History) -> DataFrame:
    """``name, value``: the limits that the measures apply, those that follow from the history included."""
    fixed = {
        "max_change_size": history.max_size, "hub_breadth": hotspots.HUB_BREADTH, "hub_changes": hotspots.HUB_CHANGES, "hub_share": hotspots.HUB_SHARE,
        "local_distance": coupling.LOCAL_DISTANCE, "clique_share": 0.3, "fan_in": modules.FAN_IN, "interface_changes": modules.INTERFACE_CHANGES, "volatility": modules.VOLATILITY,
        "copy_similarity": textual.SIMILARITY, "leakage": modules.LEAKY, "implementation_changes": modules.LEAKY_CHANGES, "min_shared": coupling.MIN_SHARED, "min_degree": coupling.MIN_DEGREE,
        "propagation_depth": modules.DEPTH, "ubiquitous_share": coupling.UBIQUITOUS_SHARE, "ubiquitous_changes": coupling.UBIQUITOUS_MIN, "convention_share": modules.CONVENTION_SHARE,
        "slice_changes": trends.SLICE_CHANGES, "erosion_shift": trends.MIN_SHIFT, "erosion_sigmas": trends.SIGMAS, "mean_line": textual.MAX_LINE, "max_bytes": textual.MAX_BYTES,
    }
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v in fixed.items()], F.struct(F.lit("module_changes").alias("name"), F.col("floor").cast("double").alias("value")))
    return modules.module_floor(history).select(F.inline(listed))
