"""Where to start: findings of six kinds, scored by the heat they concern, and the pick among them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded, share
from tidemark.functions.paths import is_test
from tidemark.operators import coupling, hotspots, modules, textual
from tidemark.operators.history import History
from tidemark.operators.skew import shuffled
from tidemark.session import durable


@dataclass(frozen=True)
class Limits:
    """Least values of a finding, and how many are listed."""

    heat: float = 0.02
    containment: float = 0.75
    changes: int = 3
    coupling_changes: int = 5
    score: float = 0.005
    per_kind: int = 6
    total: int = 10


CHRONIC_BOOST, FULL_EVIDENCE = 1.5, 10
#: The most members a clique may have for a boundary pair to take it in.
PAIR_CLIQUE = 3
ABOUT_FILES = ("hub", "coupling", "copies")


def _none() -> Column:
    return F.array().cast("array<string>")



@dataclass(frozen=True)
class Finding:
    kind: str
    subject: str
    score: float
    areas: tuple[str, ...] = ()
    files: tuple[str, ...] = ()


def _pick(findings: list[Finding], limits: Limits) -> list[Finding]:
    """The best of each kind, then by score, of each kind and in all no more than listed; ``findings`` are in order."""
    by: dict[str, list[Finding]] = {}
    for f in findings:
        own = by.setdefault(f.kind, [])
        if len(own) < limits.per_kind:
            own.append(f)
    best = [own[0] for own in by.values()]
    rest = _ordered(f for own in by.values() for f in own[1:] if f.score >= limits.score)
    return _ordered([*best, *rest[: max(0, limits.total - len(best))]][: limits.total])


def _ordered(findings) -> list[Finding]:
    return sorted(findings, key=lambda f: (-f.score, f.kind, f.subject))


def _folded(picked: list[Finding]) -> set[Finding]:
    """Boundaries and cliques that a higher one of the other kind explains: all areas of the boundary are members of the clique.

    A boundary takes in a clique only if it is a pair and the clique has one member more at most.
    """
    rows = [f for f in picked if f.kind in ("boundary", "clique")]
    gone: set[Finding] = set()
    for i, high in enumerate(rows):
        if high in gone:
            continue
        for low in rows[i + 1 :]:
            if high.kind == "clique" and low.kind == "boundary":
                explained = set(low.areas) <= set(high.areas)
            else:
                explained = high.kind == "boundary" and low.kind == "clique" and len(high.areas) == 2 and len(low.areas) <= PAIR_CLIQUE and set(high.areas) <= set(low.areas)
            if explained:
                gone.add(low)
    return gone


def settled(findings: list[Finding], limits: Limits) -> tuple[list[Finding], set[Finding]]:
    """The pick once nothing in it folds or repeats, picked again after each, and what was left out for it.

    An entry about files repeats a higher one that names all of them.
    """
    rows, out = _ordered(f for f in findings if f.score > 0), set()
    while True:
        picked = _pick([f for f in rows if f not in out], limits)
        repeat = next((f for i, f in enumerate(picked) if f.kind in ABOUT_FILES and f.files and any(set(f.files) <= set(h.files) for h in picked[:i])), None)
        gone = {repeat} if repeat else _folded(picked)
        if not gone:
            return picked, out
        out |= gone


def _heat_shares(history: History) -> DataFrame:
    """``path, module, h``: share of all production heat."""
    heat = hotspots.item_heat(history)
    total = heat.agg(F.sum("production_heat")).scalar()
    return heat.select("path", "module", share(F.col("production_heat"), total).alias("h"))


def boundaries(history: History, limits: Limits = Limits()) -> DataFrame:
    """``kind, subject, score``: hot modules that changes do not stay within: heat (1 - containment) (1.5 if chronic) (1 + fix share).

    Two of them that are each other's strongest partner are one finding, the stronger first, with the sum of both scores.
    """
    h = _heat_shares(history)
    chronic = hotspots.heat_kinds(history).where("kind = 'chronic'").select("path").withColumn("c", F.lit(True))
    by = h.join(chronic, "path", "left").groupBy(F.col("module").alias("area")).agg(F.sum("h").alias("h"), F.sum(F.when(F.col("c"), F.col("h"))).alias("hc"))
    rows = modules.cohesion(history).where(~F.col("test_only") & (F.col("changes") >= limits.changes)).join(by, "area")
    rows = rows.join(modules.fix_density(history).select("area", F.col("share").alias("fix")), "area", "left")
    rows = rows.where((F.col("h") >= limits.heat) & (F.col("cohesion") <= limits.containment))
    boost = F.when(2 * F.coalesce("hc", F.lit(0.0)) >= F.col("h"), CHRONIC_BOOST).otherwise(1.0)
    score = F.col("h") * (1 - F.col("cohesion")) * boost * (1 + F.coalesce("fix", F.lit(0.0)))
    leaks = durable(rows.select("area", score.alias("score")).join(coupling.strongest_partner(None, pairs=coupling.module_pairs(history)).select("area", "partner"), "area", "left"))
    other = leaks.select(F.col("area").alias("partner"), F.col("partner").alias("back"), F.col("score").alias("more"))
    told = leaks.join(other, "partner", "left").withColumn("mutual", F.coalesce(F.col("back") == F.col("area"), F.lit(False)))
    first = (F.col("score") > F.col("more")) | ((F.col("score") == F.col("more")) & (F.col("area") < F.col("partner")))
    told = told.where(~F.col("mutual") | first)
    areas = F.when(F.col("mutual"), F.array("area", "partner")).otherwise(F.array("area"))
    whole = F.col("score") + F.when(F.col("mutual"), F.col("more")).otherwise(0.0)
    return told.select(F.lit("boundary").alias("kind"), F.array_join(areas, " + ").alias("subject"), whole.alias("score"), areas.alias("areas"), _none().alias("files"))


def chronic_files(history: History, limits: Limits = Limits()) -> DataFrame:
    """Hot files that stay hot: share of heat, raised by the fix share of their module."""
    chronic = hotspots.heat_kinds(history).where("kind = 'chronic'").select("path")
    rows = _heat_shares(history).join(chronic, "path", "left_semi").join(modules.fix_density(history).select(F.col("area").alias("module"), F.col("share").alias("fix")), "module", "left")
    return rows.where(F.col("h") >= limits.heat / 4).select(F.lit("hotspot").alias("kind"), F.col("path").alias("subject"), (F.col("h") * (1 + F.coalesce("fix", F.lit(0.0)))).alias("score"), _none().alias("areas"), F.array("path").alias("files"))


def hidden_couplings(history: History, limits: Limits = Limits()) -> DataFrame:
    """Pairs that change together across modules: heat of both times degree."""
    pairs = coupling.couplings(history).where(F.col("crosses_module") & ~F.col("test_pair") & (F.col("shared") >= limits.coupling_changes))
    h = _heat_shares(history).select("path", "h")
    for x in ("a", "b"):
        pairs = pairs.join(shuffled(h.select(F.col("path").alias(x), F.col("h").alias(f"h_{x}"))), x, "left")
    heat = F.coalesce("h_a", F.lit(0.0)) + F.coalesce("h_b", F.lit(0.0))
    return pairs.select(F.lit("coupling").alias("kind"), F.concat_ws(" + ", "a", "b").alias("subject"), (heat * F.col("degree")).alias("score"), _none().alias("areas"), F.array("a", "b").alias("files"))


def hub_findings(history: History, edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All unstable interfaces: heat of their dependents times the share of dependents that change along."""
    hubs = durable(modules.unstable_interfaces(history, edges, top=None).drop("changes", "dependents"))
    links = modules.together(history, edges.where("src <> dst").select("src", "dst").distinct())
    changes = history.used().groupBy(F.col("item").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    h = _heat_shares(history).select(F.col("path").alias("src"), "h")
    weighted = links.join(changes, "src", "left").join(shuffled(h), "src", "left").groupBy(F.col("dst").alias("item")).agg(F.sum(F.coalesce("h", F.lit(0.0)) * F.least(F.lit(1.0), F.col("together") / F.greatest(F.lit(1), F.coalesce("n", F.lit(0))))).alias("hw"))
    return hubs.join(weighted, "item").select(F.lit("hub").alias("kind"), F.col("item").alias("subject"), (F.col("hw") * F.col("changed_dependents") / F.col("fan_in")).alias("score"), _none().alias("areas"), F.array("item").alias("files"))


def clique_findings(history: History, min_share: float = 0.3, limits: Limits = Limits()) -> DataFrame:
    """Groups of modules that change together pair by pair: heat times the weakest share times the evidence."""
    from tidemark.operators.graph import area_cliques

    pairs = coupling.area_pairs(coupling.ranked_touched(history))
    groups = area_cliques(pairs, min_share=min_share).withColumn("subject", F.array_join("members", " + "))
    heat = _heat_shares(history).groupBy(F.col("module").alias("member")).agg(F.sum("h").alias("h"))
    members = groups.select("subject", F.explode("members").alias("member"))
    hot = members.join(heat, "member", "left").groupBy("subject").agg(F.sum(F.coalesce("h", F.lit(0.0))).alias("h"))
    inside = members.alias("x").join(members.alias("y"), F.expr("x.subject = y.subject AND x.member < y.member")).select("x.subject", F.col("x.member").alias("a"), F.col("y.member").alias("b"))
    weakest = inside.join(pairs, ["a", "b"]).groupBy("subject").agg(F.min(F.col("shared") / F.least("changes_a", "changes_b")).alias("weakest"), F.min("shared").alias("shared"))
    score = F.col("h") * F.col("weakest") * F.least(F.lit(1.0), F.col("shared") / FULL_EVIDENCE)
    return hot.join(weakest, "subject").join(groups.select("subject", "members"), "subject").select(F.lit("clique").alias("kind"), "subject", score.alias("score"), F.col("members").alias("areas"), _none().alias("files"))


def copy_findings(history: History, texts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Families of copies among coupled files: heat of all copies times the share of their common changes that touched every one.

    Common changes touch two copies at least. Families of tests only, and those that fewer than ``changes`` changes touched whole, are left out.
    """
    families = durable(textual.copy_families(coupling.couplings(history), texts))
    whole = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("item")).alias("files"), F.bool_and(is_test(F.col("item"))).alias("tests"))
    changed = history.used().join(families, "item").groupBy("family", "change_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").join(whole.select("family", "n"), "family")
    counts = changed.groupBy("family").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("k") == F.col("n")).alias("all"))
    heat = _heat_shares(history).select(F.col("path").alias("item"), "h").join(families, "item").groupBy("family").agg(F.sum("h").alias("h"))
    rows = whole.where(~F.col("tests")).join(counts, "family").join(heat, "family").where(F.col("all") >= limits.changes)
    return rows.select(F.lit("copies").alias("kind"), F.array_join("files", " + ").alias("subject"), (F.col("h") * F.col("all") / F.col("shared")).alias("score"), _none().alias("areas"), "files")


def entry_points(history: History, edges: DataFrame, limits: Limits = Limits(), texts: DataFrame | None = None) -> DataFrame:
    """``kind, subject, score, place``: the best findings of all kinds, at most per_kind of each and total, the best of each kind always.

    Scores count as rounded; ties go to kind, then subject. Boundaries and cliques that explain each
    other are one entry, whose freed place goes to the next. Copies need ``texts`` (item, text).
    Only the best of each kind reach the driver, more of them if so many were folded away that the next ones count.
    """
    history = history.keeping()
    kinds = [boundaries(history, limits), chronic_files(history, limits), hidden_couplings(history, limits), hub_findings(history, edges, limits), clique_findings(history, limits=limits)]
    if texts is not None:
        kinds.append(copy_findings(history, texts, limits))
    kinds = [durable(found.withColumn("score", rounded("score")).where("score > 0")) for found in kinds]
    most = 8 * limits.per_kind
    while True:
        listed = [found.orderBy(F.desc("score"), "subject").limit(most).collect() for found in kinds]
        findings = [Finding(r["kind"], r["subject"], r["score"], tuple(r["areas"]), tuple(r["files"])) for rows in listed for r in rows]
        picked, out = settled(findings, limits)
        if all(len(rows) < most or sum(f.kind == rows[0]["kind"] for f in out) <= most - limits.per_kind for rows in listed):
            break
        most *= 2
    spark = history.changes.sparkSession
    return spark.createDataFrame([(f.kind, f.subject, f.score, i) for i, f in enumerate(picked, 1)], "kind string, subject string, score double, place long")
