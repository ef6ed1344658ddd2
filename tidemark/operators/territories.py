"""A map of the tree: modules of files, and a directory tree opened where it is worth it, level by level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import ancestors_of, directory_of
from tidemark.operators.history import History
from tidemark.operators.hotspots import item_heat
from tidemark.session import durable

DOMINANT, DOMINANT_FILES = 0.7, 20
LEVELS, RECOMMENDED = 6, 25
TOO_BIG, INDEPENDENT, MIN_CHANGES, MIN_FOLDER = 0.4, 0.7, 8, 3
#: Directories a tree is grown from on the driver; more are an error, as leaf directories can be folded first.
MAX_DIRECTORIES = 200_000


def split_depths(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys..., depth``: the first depth at which the paths of a group lie in two directories at least; 1 where none is.

    A path of fewer directories takes no part in a depth. A lone ``src`` is passed through.
    """
    at = rows.select(*keys, F.posexplode(F.slice(ancestors_of(F.col("path")), 2, 1_000_000)).alias("i", "directory"))
    wide = at.groupBy(*keys, "i").agg(F.min("directory").alias("least"), F.max("directory").alias("most")).where("least <> most")
    first = wide.groupBy(*keys).agg(F.min("i").alias("i"))
    every = rows.select(*keys).distinct() if keys else None
    if every is None:
        return first.select(F.coalesce(F.col("i") + 1, F.lit(1)).alias("depth"))
    return every.join(first, list(keys), "left").select(*keys, F.coalesce(F.col("i") + 1, F.lit(1)).alias("depth"))


def _by_directory(depth: Column) -> Column:
    """The first ``depth`` directories of a path, all it has if fewer, ``.`` at the root."""
    up = ancestors_of(F.col("path"))
    return F.get(up, F.least(depth, F.size(up) - 1))


def detect_modules(files: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """``path, module``: the nearest package directory of each file, else a directory at the first depth that splits the rest.

    If that makes fewer than two modules, all files are grouped by directory instead. A module of
    more than 70 % of all files, and twenty at least, is split by directory as well, and its parts
    again, until none is or it has no directories to split by; a package is spared if another
    package holds code that is no test. Each round is one aggregate of a row per module or depth, and every
    split lies deeper in the tree, so the paths' depth bounds the rounds. ``homes``: directory.
    """
    from tidemark.functions.paths import is_test
    from tidemark.operators.textual import nearest_ancestor

    rows = files.where(F.col("path").isNotNull()).select("path").distinct()
    near = nearest_ancestor(rows, homes) if homes is not None else rows.withColumn("home", F.lit(None).cast("string"))
    outside = split_depths(near.where(F.col("home").isNull()).select("path")).select("depth").scalar()
    rows = durable(near.select("path", F.coalesce("home", _by_directory(F.coalesce(outside, F.lit(1)))).alias("module"), F.col("home").isNotNull().alias("package")))
    if rows.select("module").distinct().limit(2).count() < 2:
        depth = split_depths(rows.select("path")).first()
        rows = rows.select("path", _by_directory(F.lit(depth["depth"] if depth else 1)).alias("module"), F.lit(False).alias("package"))
    while True:
        sizes = rows.groupBy("module", "package").agg(F.count(F.lit(1)).alias("n"), F.bool_and(is_test(F.col("path"))).alias("tests"))
        total = sizes.agg(F.sum("n"), F.count_if(F.col("package") & ~F.col("tests"))).first()
        top = sizes.orderBy(F.desc("n"), "module").first()
        if top is None or top["n"] < DOMINANT_FILES or top["n"] <= DOMINANT * total[0]:
            break
        if top["package"] and total[1] - (not top["tests"]) > 0:
            break
        mine = F.col("module") == top["module"]
        depth = split_depths(rows.where(mine).select("path")).first()
        fresh = F.when(mine, _by_directory(F.lit(depth["depth"] if depth else 1))).otherwise(F.col("module"))
        parts = rows.where(mine).select(fresh.alias("m")).distinct().limit(2).count()
        if parts < 2:
            break
        rows = durable(rows.select("path", fresh.alias("module"), (F.col("package") & ~mine).alias("package")))
    return rows.select("path", "module")


def directory_facts(history: History) -> DataFrame:
    """``directory, parent, files, changes, single, folders, heat``: each directory with all below it.

    single: counted changes that touch one of its direct parts only; folders: direct parts
    with changes.
    """
    heat = item_heat(history).select("path", "production_heat")
    up = heat.select("path", "production_heat", F.posexplode(ancestors_of(F.col("path"))).alias("depth", "directory"), ancestors_of(F.col("path")).alias("up"))
    up = up.withColumn("part", F.coalesce(F.get("up", F.col("depth") + 1), F.lit("")))
    sums = up.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("production_heat").alias("heat"))
    known = history.used().join(heat.select(F.col("path").alias("item")), "item", "left_semi")
    parts = known.select("change_id", F.posexplode(ancestors_of(F.col("item"))).alias("depth", "directory"), ancestors_of(F.col("item")).alias("up"))
    parts = parts.select("change_id", "directory", F.coalesce(F.get("up", F.col("depth") + 1), F.lit("")).alias("part")).distinct()
    each = parts.groupBy("directory", "change_id").agg(F.count(F.lit(1)).alias("n"))
    touched = each.groupBy("directory").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("n") == 1).alias("single"))
    folders = parts.where("part <> ''").select("directory", "part").distinct().groupBy("directory").agg(F.count(F.lit(1)).alias("folders"))
    rows = sums.join(touched, "directory", "left").join(folders, "directory", "left").fillna(0, ["changes", "single", "folders"])
    parent = F.when(F.col("directory") == ".", None).otherwise(F.coalesce(F.nullif(directory_of(F.col("directory")), F.lit("")), F.lit(".")))
    return rows.select("directory", parent.alias("parent"), "files", "changes", "single", "folders", "heat")


@dataclass
class Node:
    directory: str
    files: int
    changes: int
    single: int
    folders: int
    heat: float
    children: list[str] = field(default_factory=list)


def split_value(node: Node, files: int, changes: int, heat: float) -> float:
    """Worth of opening a directory: its part of files, changes and heat, more so if its parts change on their own."""
    share = node.single / node.changes if node.changes else 0.0
    independent = node.changes >= MIN_CHANGES and share >= INDEPENDENT and node.folders >= 2
    part = node.files / max(1, files) + node.changes / max(1, changes) + (node.heat / heat if heat else 0.0)
    return part * (0.25 + max(0.0, share - 0.5) if independent else 0.25)


def grow(nodes: dict[str, Node], levels: int = LEVELS, cap: int | None = None) -> list[tuple[str, str | None, int]]:
    """(directory, parent, first level) of the opened tree, coarse to fine; the most worthwhile directory opens next.

    Level sizes grow geometrically from the root's children to the cap (60, or a sixtieth of all
    files). Single-child chains are passed through; folders of fewer than three files stay closed.
    """
    if "." not in nodes:
        return []
    root = nodes["."]
    cap = cap or max(60, root.files // 60)

    def kids(d: str) -> list[str]:
        found = sorted(c for c in nodes[d].children if nodes[c].files >= MIN_FOLDER)
        while len(found) == 1 and nodes[found[0]].children and nodes[found[0]].files == nodes[d].files:
            found = sorted(c for c in nodes[found[0]].children if nodes[c].files >= MIN_FOLDER) or found
            if len(found) == 1 and not nodes[found[0]].children:
                break
        return found

    shown = kids(".") or ["."]
    out = [(d, None if d == "." else ".", 1) for d in shown]
    first = max(1, len(shown))
    worth = lambda d: split_value(nodes[d], root.files, root.changes, root.heat)
    open_ = set(shown)
    for level in range(2, levels + 1):
        target = first * (max(cap, first) / first) ** ((level - 1) / (levels - 1))
        while len(open_) < target:
            able = [d for d in open_ if len(kids(d)) > 1 or (kids(d) and nodes[d].files / max(1, root.files) > TOO_BIG)]
            if not able:
                return out
            best = min(able, key=lambda d: (-worth(d), d))
            open_.discard(best)
            for c in kids(best):
                open_.add(c)
                out.append((c, best, level))
    return out


def territories(history: History, levels: int = LEVELS) -> DataFrame:
    """``directory, parent, level``: the opened tree; ``level`` is the first at which a directory is shown.

    Per-directory sums are made by Spark; the tree is grown on the driver from at most
    MAX_DIRECTORIES rows (an error beyond that), which directories of few files never exceed
    after folding.
    """
    rows = directory_facts(history).where(F.col("files") >= MIN_FOLDER).limit(MAX_DIRECTORIES + 1).collect()
    if len(rows) > MAX_DIRECTORIES:
        raise ValueError("too many directories for one tree; grow it per module")
    nodes = {r["directory"]: Node(r["directory"], r["files"], r["changes"], r["single"], r["folders"], float(r["heat"] or 0)) for r in rows}
    for r in rows:
        if r["parent"] in nodes:
            nodes[r["parent"]].children.append(r["directory"])
    return history.changes.sparkSession.createDataFrame(grow(nodes, levels), "directory string, parent string, level int")


def visible_at(paths: DataFrame, tree: DataFrame, level: int) -> DataFrame:
    """``path, territory``: the deepest directory shown at a level above each path; null if none is."""
    from tidemark.operators.textual import nearest_ancestor

    return nearest_ancestor(paths, tree.where(F.col("level") <= level).select("directory")).withColumnRenamed("home", "territory")


def recommended_level(tree: DataFrame, most: int = RECOMMENDED) -> int:
    """The finest level that shows at most ``most`` directories, 1 at least."""
    counts = {r["level"]: r["n"] for r in tree.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    shown, best = 0, 1
    for level in sorted(counts):
        shown += counts[level]
        if shown <= most:
            best = level
    return best


def containment(history: History, tree: DataFrame, level: int) -> DataFrame:
    """``area, changes, local, containment``: how far changes stay within one shown directory; files outside count nowhere."""
    from tidemark.functions.numbers import rounded, share
    from tidemark.operators.modules import area_tally
    from tidemark.operators.skew import salted_join

    places = visible_at(history.facts().select("path"), tree, level).where(F.col("territory").isNotNull()).select(F.col("path").alias("item"), F.col("territory").alias("area"))
    rows = area_tally(salted_join(history.used(), places, "item", "change_id"))
    return rows.select("area", "changes", "local", rounded(share("local", "changes")).alias("containment"))
