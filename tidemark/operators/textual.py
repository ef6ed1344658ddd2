"""Measures of source text: indentation complexity, token shingles, copies among coupled files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded
from tidemark.functions.paths import is_test
from tidemark.operators.graph import components
from tidemark.operators.history import History

UNIT_RANGE, FALLBACK_UNIT = (2, 8), 4
#: Tokens of a shingle, shingles of a text at least, and their common part from which two coupled files are copies.
SHINGLE, MIN_SHINGLES, SIMILARITY = 5, 20, 0.5
MAX_BYTES, MAX_LINE = 1_048_576, 300

#: Tokens of a source text: comments, strings, words, numbers, single marks. Loops are possessive, so long literals need no stack.
TOKENS = (
    r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`"
    r"|[\p{L}_$][\p{L}\p{N}_$]*+|\p{N}[\p{L}\p{N}_.]*+|[^\s]"
)


def complexity(text: Column) -> Column:
    """struct(loc, total, mean, max): indentation levels over the non-blank lines of a text; null for null.

    A tab is a level; spaces count by the text's own unit, its most common increase between
    consecutive lines (the smaller of equally common ones, kept within 2..8, 4 without any).
    """
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"\S"))
    indents = F.transform(lines, lambda line: F.regexp_extract(line, "^[\t ]*", 0))
    tabs = F.transform(indents, lambda i: F.length(i) - F.length(F.replace(i, F.lit("\t"), F.lit(""))))
    spaces = F.transform(indents, lambda i: F.length(i) - F.length(F.replace(i, F.lit(" "), F.lit(""))))
    state = F.struct(tabs.alias("tabs"), spaces.alias("spaces"))

    def measured(s: Column) -> Column:
        sp = s["spaces"]
        rises = F.filter(F.transform(F.slice(sp, 2, F.greatest(F.size(sp), F.lit(1))), lambda x, i: x - F.get(sp, i)), lambda d: d > 0)
        ranked = bound(rises, lambda r: F.array_max(F.transform(F.array_distinct(r), lambda d: F.struct(F.size(F.filter(r, lambda x: x == d)).alias("n"), (-d).alias("d")))))
        unit = F.coalesce(-ranked["d"], F.lit(FALLBACK_UNIT))
        unit = F.least(F.lit(UNIT_RANGE[1]), F.greatest(F.lit(UNIT_RANGE[0]), unit))
        return bound(unit, lambda u: F.zip_with(s["tabs"], sp, lambda t, x: t + F.floor(x / u)))

    levels = bound(state, measured)

    def summary(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)
        n = F.size(v).cast("bigint")
        return F.struct(n.alias("loc"), total.alias("total"), F.when(n > 0, total / n).otherwise(0.0).alias("mean"), F.coalesce(F.array_max(v), F.lit(0)).cast("bigint").alias("max"))

    return F.when(text.isNotNull(), bound(levels, summary))


def accepted(text: Column) -> Column:
    """A source text worth measuring: not above 1 MiB, no NUL in the first 8 KiB of its bytes, mean line not above 300 characters."""
    loc = F.size(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"\S")))
    return (F.octet_length(text) <= MAX_BYTES) & (F.locate("\x00", F.substring(F.encode(text, "UTF-8"), 1, 8192).cast("string")) == 0) & (F.length(text) <= MAX_LINE * loc)


def tokens(text: Column) -> Column:
    """Tokens without comments; every string is ``"`` and every number ``0``."""
    raw = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
    code = F.filter(raw, lambda t: ~(t.startswith("//") | t.startswith("/*")))
    return F.transform(code, lambda t: F.when(t.rlike("^[\"'`].*[\"'`]$") & (F.length(t) > 1), F.lit('"')).when(t.rlike(r"^\p{N}"), F.lit("0")).otherwise(t))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of ``size`` consecutive words; empty for fewer words, null for null."""

    def of(w: Column) -> Column:
        n = F.size(w) - size + 1
        starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " "))))

    return F.when(words.isNotNull(), bound(words, of))


def jaccard(a: Column, b: Column) -> Column:
    """Common part of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def similar_pairs(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, min_shingles: int = MIN_SHINGLES) -> DataFrame:
    """``a, b, similarity``: the given pairs of items whose texts are alike; of several texts of an item the smallest counts. A file and its own test (``test_pair``) are no copies."""
    if "test_pair" in pairs.columns:
        pairs = pairs.where(~F.col("test_pair"))
    sets = texts.where(F.col("item").isNotNull() & F.col("text").isNotNull()).groupBy("item").agg(F.min("text").alias("text")).select("item", shingles(tokens(F.col("text"))).alias("s")).where(F.size("s") >= min_shingles)
    rows = pairs.select("a", "b").join(sets.select(F.col("item").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("item").alias("b"), F.col("s").alias("sb")), "b")
    return rows.withColumn("exact", jaccard(F.col("sa"), F.col("sb"))).where(F.col("exact") >= least).select("a", "b", rounded("exact").alias("similarity"))


def copy_families(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, min_shingles: int = MIN_SHINGLES) -> DataFrame:
    """``item, family``: items of alike coupled pairs with the smallest item of their family."""
    alike = similar_pairs(pairs, texts, least, min_shingles)
    return components(alike).select(F.col("node").alias("item"), F.col("component").alias("family"))


def family_facts(families: DataFrame, texts: DataFrame, history: History) -> DataFrame:
    """``family, files, least, most, test_only, shared, all``: facts of copy families, most important first.

    least and most: similarity over all pairs of a family, linked or not, found in one task per
    family without listing the pairs; families are copies among coupled files, so they are small. shared and all: counted
    changes that touched two members, and every member.
    """
    sets = texts.join(families.select(F.col("item"), "family"), "item").where(F.col("text").isNotNull()).groupBy("family", "item").agg(F.min("text").alias("text")).select("family", "item", shingles(tokens(F.col("text"))).alias("s"))

    def ranges(rows):
        import pyarrow as pa

        own = [set(s) for s in rows["s"].to_pylist()]
        least, most = 1.0, 0.0
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                both = len(a & b)
                alike = both / ((len(a) + len(b) - both) or 1)
                least, most = min(least, alike), max(most, alike)
        return pa.table({"family": [rows["family"][0].as_py()], "least": [least], "most": [most]})

    spread_ = sets.groupBy("family").applyInArrow(ranges, "family string, least double, most double")
    whole = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("item")).alias("files"), F.bool_and(is_test(F.col("item"))).alias("test_only"))
    changed = history.used().join(families, "item").groupBy("family", "change_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").join(whole.select("family", "n"), "family")
    counts = changed.groupBy("family").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("k") == F.col("n")).alias("all"))
    rows = whole.join(spread_, "family").join(counts, "family", "left").fillna(0, ["shared", "all"])
    rows = rows.select("family", "files", rounded("least").alias("least"), rounded("most").alias("most"), "test_only", "shared", "all")
    return rows.orderBy("test_only", F.desc("all"), F.desc("shared"), F.desc(F.size("files")), "family")


def nearest_ancestor(paths: DataFrame, homes: DataFrame) -> DataFrame:
    """``path, home``: the deepest of the given directories above each path, null if there is none.

    Every path is joined once per ancestor (as many as it is deep), the deepest hit kept.
    """
    from tidemark.functions.paths import ancestors_of

    up = paths.select("path", F.posexplode(ancestors_of(F.col("path"))).alias("depth", "directory"))
    hits = up.join(homes.select("directory").distinct(), "directory").groupBy("path").agg(F.max_by("directory", "depth").alias("home"))
    return paths.select("path").distinct().join(hits, "path", "left")
