"""What files and modules export: own names, names handed on, and all of another file by a star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded, share
from tidemark.functions.paths import extension_of, is_config
from tidemark.operators.imports import SCANNED, resolved
from tidemark.session import durable

_DECLARED = r"(?m)^export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:const|let|var|function\*?|class|interface|type|enum|namespace)\s+([\w$]+)"
_DEFAULT = r"(?m)^export\s+default\b"
_LISTED = r"(?m)^export\s+(?:type\s+)?\{([^}]*)\}(?:\s*from\s*[\"']([^\"'\n]+)[\"'])?"
_STAR = r"(?m)^export\s+(?:type\s+)?\*\s*from\s*[\"']([^\"'\n]+)[\"']"
_SPACE = r"(?m)^export\s+(?:type\s+)?\*\s*as\s+([\w$]+)\s+from\s*[\"']([^\"'\n]+)[\"']"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def listed_exports(texts: DataFrame) -> DataFrame:
    """``file, name, specifier, original``: the names that each scanned file exports.

    specifier and original are null for a name of the file's own; a star of another file has name ``*`` and no
    original. Of several texts of a file the smallest counts; null texts and other languages give no rows.
    """
    rows = texts.where(F.col("item").isNotNull() & F.col("text").isNotNull() & extension_of(F.col("item")).isin(SCANNED)).groupBy(F.col("item").alias("file")).agg(F.min("text").alias("text"))
    t = F.col("text")
    none = F.lit(None).cast("string")
    row = lambda name, specifier, original: F.struct(name.alias("name"), specifier.alias("specifier"), original.alias("original"))
    own = F.transform(_all(t, _DECLARED, 1), lambda n: row(n, none, none))
    default = F.when(t.rlike(_DEFAULT), F.array(row(F.lit("default"), none, none))).otherwise(F.array().cast("array<struct<name:string,specifier:string,original:string>>"))
    groups = F.arrays_zip(_all(t, _LISTED, 1).alias("names"), _all(t, _LISTED, 2).alias("specifier"))

    def members(g: Column) -> Column:
        specifier = F.nullif(g["specifier"], F.lit(""))
        names = F.filter(F.transform(F.split(g["names"], ","), lambda n: F.trim(F.regexp_replace(n, r"^\s*type\s+", ""))), lambda n: n != "")
        return F.transform(names, lambda n: row(F.regexp_extract(n, r"([\w$]+)\s*$", 1), specifier, F.when(specifier.isNotNull(), F.regexp_extract(n, r"^([\w$]+)", 1))))

    listed = F.flatten(F.transform(groups, members))
    stars = F.transform(_all(t, _STAR, 1), lambda s: row(F.lit("*"), s, none))
    spaces = F.transform(F.arrays_zip(_all(t, _SPACE, 1).alias("n"), _all(t, _SPACE, 2).alias("s")), lambda x: row(x["n"], x["s"], F.lit("*")))
    return rows.select("file", F.inline(F.concat(own, default, listed, stars, spaces))).where("name <> ''").distinct()


def visible_exports(texts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, name, binding`` of everything that files export, stars followed, and ``file`` of those that cannot be told in full.

    A file's own names win over its stars; ``default`` is never handed on by a star; a name that two
    stars bring with different bindings is not exported. Bindings are where a name is declared.
    A star whose file is unknown makes its file, and those that hand it on, unknown. Each round hands names
    one star, or one step of a re-export, further, until nothing changes; cycles end by themselves.
    """
    rows = durable(listed_exports(texts))
    asked = rows.where(F.col("specifier").isNotNull()).select(F.col("file").alias("item"), "specifier").distinct()
    targets = durable(resolved(asked, files).select(F.col("item").alias("file"), "specifier", "target", "state"))
    named = rows.where("name <> '*'").join(targets, ["file", "specifier"], "left")
    here = F.concat_ws("#", "file", "name")
    whole = (F.col("original") == "*") & F.col("target").isNotNull()
    binding = F.when(F.col("specifier").isNull(), here).when(whole, F.concat("target", F.lit("#*"))).when(F.col("target").isNull(), F.concat_ws("#", F.when(F.col("state") == "external", F.lit("ext:")).otherwise(F.concat("file", F.lit(">"))), "specifier", "original"))
    own = durable(named.select("file", "name", binding.alias("binding"), F.when(binding.isNull(), F.col("target")).alias("at"), F.when(binding.isNull(), F.col("original")).alias("as")).distinct())
    stars = durable(rows.where("name = '*'").join(targets, ["file", "specifier"], "left").select("file", "target").distinct())
    mine = own.select("file", "name").distinct()

    def count(df: DataFrame) -> int:
        return df.count()

    unknown = durable(stars.where(F.col("target").isNull() | ~F.col("target").isin("")).join(rows.select(F.col("file").alias("target"), F.lit(True).alias("known")).distinct(), "target", "left").where(F.col("known").isNull()).select("file").distinct())
    while True:
        more = durable(stars.join(unknown.select(F.col("file").alias("target")), "target", "left_semi").select("file").unionByName(unknown).distinct())
        if count(more) == count(unknown):
            break
        unknown = more
    held = durable(own.where(F.col("binding").isNotNull()).select("file", "name", "binding"))
    while True:
        by_star = stars.join(held.withColumnRenamed("file", "target"), "target").where("name <> 'default'").select("file", "name", "binding").join(mine, ["file", "name"], "left_anti")
        single = held.groupBy("file", "name").agg(F.min("binding").alias("binding"), F.count_distinct("binding").alias("n")).where("n = 1").drop("n")
        step = own.where(F.col("binding").isNull()).select("file", "name", "at", "as").join(single.select(F.col("file").alias("at"), F.col("name").alias("as"), "binding"), ["at", "as"]).select("file", "name", "binding")
        more = durable(held.unionByName(by_star).unionByName(step).distinct())
        if count(more) == count(held):
            break
        held = more
    # a re-export of a name that its file does not show is certain by name only
    left = own.where(F.col("binding").isNull()).select("file", "name", F.concat_ws("#", "at", "as").alias("binding")).join(held.select("file", "name"), ["file", "name"], "left_anti")
    one = held.unionByName(left).groupBy("file", "name").agg(F.min("binding").alias("binding"), F.count_distinct("binding").alias("n")).where("n = 1").drop("n")
    return one, unknown


def module_depth(texts: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """``area, exports, lines, depth``: lines of implementation behind each name that a module's entry points export.

    ``files``: item, area, test, loc; ``entries``: item, area. Implementation: files that are no entry point, test or
    configuration. A module is absent if it has no entry point, no implementation or no export, if an entry point
    is of a language that is not scanned, or if what it exports cannot be told.
    """
    known, unknown = visible_exports(texts, files.select(F.col("item").alias("path")))
    rest = files.where(~F.col("test") & ~is_config(F.col("item"))).join(entries.select("item").distinct(), "item", "left_anti")
    lines = rest.groupBy("area").agg(F.sum(F.coalesce("loc", F.lit(0))).alias("lines")).where("lines > 0")
    scanned = texts.where(F.col("text").isNotNull() & extension_of(F.col("item")).isin(SCANNED)).select("item").distinct().join(unknown.withColumnRenamed("file", "item"), "item", "left_anti").withColumn("ok", F.lit(True))
    able = entries.join(scanned, "item", "left").groupBy("area").agg(F.count_if(F.col("ok").isNull()).alias("bad")).where("bad = 0").select("area")
    names = entries.join(able, "area", "left_semi").join(known.withColumnRenamed("file", "item"), "item").groupBy("area").agg(F.count_distinct("name").alias("exports"))
    return names.join(lines, "area").select("area", "exports", "lines", rounded(share("lines", "exports")).alias("depth"))
