"""Imports between files by a scan of their text: specifiers, their files, and what couplings they explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import directories_of, extension_of

#: Languages whose imports the scan knows; other files have unknown imports, which is not none.
SCANNED = "ts tsx mts cts js jsx mjs cjs".split()
_SPECIFIER = r"""(?m)(?:^|[;\s])(?:import|export)\s+(?:type\s+)?(?:[\w*\s{},$]+?\s+from\s+)?["']([^"'\n]+)["']|\b(?:import|require)\(\s*["']([^"'\n]+)["']\s*\)"""
#: Suffixes by which a specifier's file is sought, best first; a stage's first hit wins.
STAGES = ("", ".ts", ".tsx", ".mts", ".d.ts", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")


def specifiers(text: Column) -> Column:
    """Distinct import specifiers of a source text; empty without any, null for null."""
    hits = F.concat(F.regexp_extract_all(text, F.lit(_SPECIFIER), F.lit(1)), F.regexp_extract_all(text, F.lit(_SPECIFIER), F.lit(2)))
    return F.array_distinct(F.filter(hits, lambda s: s != ""))


def joined_path(base: Column, relative: Column) -> Column:
    """``relative`` as seen from the directory of ``base``, without ``.`` and ``..``; null if it leaves the root."""
    parts = F.concat(directories_of(base), F.split(relative, "/", -1))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("out"))

    def step(s: Column, part: Column) -> Column:
        up = F.struct(F.slice(s["done"], 1, F.greatest(F.size(s["done"]) - 1, F.lit(0))).alias("done"), (s["out"] | (F.size(s["done"]) == 0)).alias("out"))
        down = F.struct(F.concat(s["done"], F.array(part)).alias("done"), s["out"].alias("out"))
        return F.when(part == "..", up).when(part.isin("", "."), s).otherwise(down)

    return F.aggregate(parts, state, step, lambda s: F.when(~s["out"], F.array_join(s["done"], "/")))


def candidates(path: Column) -> Column:
    """Files that a resolved specifier may mean, best first: itself, its source in place of a built ``.js``, with suffixes."""
    source = F.regexp_replace(path, r"\.([cm]?)jsx?$", ".$1ts")
    swapped = F.array(path, source, F.regexp_replace(path, r"\.jsx?$", ".tsx"))
    return F.array_distinct(F.concat(swapped, F.array(*[F.concat(path, F.lit(s)) for s in STAGES[1:]])))


def scan(texts: DataFrame) -> DataFrame:
    """``item, specifier``: one row per distinct relative or named import of each scanned file."""
    rows = texts.where(F.col("item").isNotNull() & F.col("text").isNotNull() & extension_of(F.col("item")).isin(SCANNED)).select("item", "text").distinct()
    return rows.select("item", F.explode(specifiers(F.col("text"))).alias("specifier")).distinct()


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``item, specifier, target, state``: file, external or missing for each import; the best candidate that exists.

    ``files``: path. Names that are not relative are external.
    """
    relative = F.col("specifier").startswith(".")
    rows = imports.withColumn("path", F.when(relative, joined_path(F.col("item"), F.col("specifier"))))
    sought = rows.where(F.col("path").isNotNull()).select("item", "specifier", F.posexplode(candidates(F.col("path"))).alias("stage", "target"))
    hits = sought.join(files.select(F.col("path").alias("target")).distinct(), "target").groupBy("item", "specifier").agg(F.min_by("target", "stage").alias("target"))
    out = rows.select("item", "specifier").join(hits, ["item", "specifier"], "left")
    return out.select("item", "specifier", "target", F.when(F.col("target").isNotNull(), "file").when(F.col("specifier").startswith("."), "missing").otherwise("external").alias("state"))


def linked_pairs(pairs: DataFrame, links: DataFrame, complete: DataFrame) -> DataFrame:
    """``a, b, relation``: a→b, b→a, both, none, or null where unknown.

    ``links``: src, dst; ``complete``: item, the files all of whose imports are accounted for. A
    pair without a link is none only if both sides are complete.
    """
    there = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().withColumn("ab", F.lit(True))
    back = links.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct().withColumn("ba", F.lit(True))
    rows = pairs.select("a", "b").join(there, ["a", "b"], "left").join(back, ["a", "b"], "left")
    for x in ("a", "b"):
        rows = rows.join(complete.select(F.col("item").alias(x), F.lit(True).alias(f"known_{x}")).distinct(), x, "left")
    relation = F.when(F.col("ab") & F.col("ba"), "both").when(F.col("ab"), "a→b").when(F.col("ba"), "b→a").when(F.col("known_a") & F.col("known_b"), "none")
    return rows.select("a", "b", relation.alias("relation"))


def complete_files(imports: DataFrame, texts: DataFrame, resolved_: DataFrame) -> DataFrame:
    """``item``: scanned files none of whose imports is missing."""
    scanned = texts.where(F.col("item").isNotNull() & F.col("text").isNotNull() & extension_of(F.col("item")).isin(SCANNED)).select("item").distinct()
    return scanned.join(resolved_.where("state = 'missing'").select("item"), "item", "left_anti")
