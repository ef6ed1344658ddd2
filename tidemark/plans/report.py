"""One report over a history: its tables, a limited view, JSON, and the slice around some paths."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import matches_any
from tidemark.operators import coupling, entries, hotspots, modules, trends, views
from tidemark.operators.history import History

SCHEMA_VERSION = 1
#: Tables of a report with the columns that name the items a row is about, and their order.
SUBJECTS = {
    "files": ("path",), "couplings": ("a", "b"), "modules": ("area",), "moduleCoupling": ("a", "b"), "distantCouplings": ("a", "b"), "unstableInterfaces": ("item",),
    "dependencyDirection": ("from", "to"), "changeRadius": (), "propagationCost": (), "series": (), "erosion": ("area",), "fixDensity": ("area",), "territories": ("directory",), "entryPoints": ("subject",), "verdict": (),
    "repositoryErosion": (), "weakStructure": ("area",), "thresholds": (),
}
ORDER = {
    "files": ["-score", "path"], "couplings": ["kind", "-degree", "-shared", "a", "b"], "modules": ["-ranked", "cohesion", "-changes", "area"], "moduleCoupling": ["-share", "-shared", "a", "b"], "distantCouplings": ["-score", "-degree", "-shared", "a", "b"],
    "unstableInterfaces": ["-changed_dependents", "-changes", "-fan_in", "item"], "dependencyDirection": ["-rank", "-imports", "from", "to"], "series": ["slice"], "erosion": ["area"], "fixDensity": ["-share", "area"], "territories": ["-heat", "directory"], "entryPoints": ["place"],
    "weakStructure": ["-heat_share", "area"], "thresholds": ["name"],
}


def report(history: History, edges: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report. What several of them share is computed now, once; the tables themselves are not."""
    history = history.keeping()
    scores = hotspots.hotspot_scores(history).select("path", "module", "test", "revisions", "changes", "breadth", "size", "score")
    return {
        "files": scores,
        "couplings": coupling.couplings(history),
        "modules": modules.cohesion(history),
        "moduleCoupling": coupling.module_couplings(history),
        "distantCouplings": coupling.distant_couplings(history, relations),
        "unstableInterfaces": modules.unstable_interfaces(history, edges),
        "dependencyDirection": modules.dependency_direction(history, edges),
        "changeRadius": modules.change_radius(history),
        "propagationCost": modules.propagation_cost(history),
        "series": trends.slice_measures(history),
        "repositoryErosion": trends.repository_erosion(history),
        "weakStructure": views.weak_structure(history),
        "thresholds": views.thresholds(history),
        "erosion": trends.erosion(history),
        "fixDensity": modules.fix_density(history),
        "territories": hotspots.territory_heat(history),
        "entryPoints": entries.entry_points(history, edges),
        "verdict": modules.verdict(history),
    }


def limited(tables: Mapping[str, DataFrame], n: int) -> dict[str, DataFrame]:
    """Each table in its order, cut to ``n`` rows."""
    out = {}
    for name, df in tables.items():
        keys = [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in ORDER.get(name, [])]
        out[name] = (df.orderBy(*keys) if keys else df).limit(n)
    return out


def totals(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Row counts of the whole tables."""
    return {name: df.count() for name, df in tables.items()}


def to_json(tables: Mapping[str, DataFrame], n: int = 50, counts: Mapping[str, int] | None = None) -> str:
    """The limited report as one JSON document; control and line separator characters are escaped."""
    body = {name: [json.loads(line) for line in df.toJSON().collect()] for name, df in limited(tables, n).items()}
    text = json.dumps({"schemaVersion": SCHEMA_VERSION, "totals": dict(counts or {}), **body}, ensure_ascii=False, sort_keys=True)
    return "".join(f"\\u{ord(c):04x}" if 0x7F <= ord(c) <= 0x9F or c in "  " else c for c in text)


def from_json(text: str) -> dict:
    """A report read back; tables that an older version lacked are empty."""
    data = json.loads(text)
    return {"schemaVersion": data.get("schemaVersion", SCHEMA_VERSION), "totals": data.get("totals", {})} | {name: data.get(name, []) for name in SUBJECTS}


def inspect(tables: Mapping[str, DataFrame], globs: list[str]) -> dict[str, DataFrame]:
    """The rows of each table that are about a path matching one of the globs, or about its module."""
    focus = tables["files"].where(matches_any(F.col("path"), globs)).select("path", "module")
    names = focus.select(F.col("path").alias("__name")).unionByName(focus.select(F.col("module").alias("__name"))).distinct()
    out = {}
    for name, df in tables.items():
        subjects = SUBJECTS.get(name, ())
        if not subjects:
            out[name] = df
            continue
        hit = df.where("false")
        for s in subjects:
            hit = hit.unionByName(df.join(names, df[s] == names["__name"], "left_semi"))
        out[name] = hit.distinct()
    return out
