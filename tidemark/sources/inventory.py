"""Files of a folder as a table: what counts as source or contract, with its complexity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import is_contract, is_source, is_test, matches_any
from tidemark.operators.textual import MAX_BYTES, accepted, complexity


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, content``: files below a folder, paths relative to it; links are not followed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/")
    return rows.select(F.regexp_replace(F.col("path"), r"^[a-z0-9+.-]+:/*", "/").alias("__p"), "length", "content").select(F.expr(f"substring(__p, {len(root) + 2})").alias("path"), "length", "content")


def inventory(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, ignored: DataFrame | None = None, generated: DataFrame | None = None) -> DataFrame:
    """``path, kind, test, complexity``: source and contract files worth measuring.

    ``include`` replaces the language list; ``exclude`` removes; ``ignored`` and ``generated`` (path) are
    anti-joined. Files above 1 MiB, with a NUL in the first 8 KiB or with a mean line above 300
    characters are no sources; contracts have no complexity. Null contents are left out.
    """
    p = F.col("path")
    wanted = matches_any(p, include) if include else (is_source(p) | is_contract(p))
    rows = files.where(wanted & (F.col("length") <= MAX_BYTES))
    if exclude:
        rows = rows.where(~matches_any(p, exclude))
    for gone in (ignored, generated):
        if gone is not None:
            rows = rows.join(gone.select("path").distinct(), "path", "left_anti")
    # malformed bytes show as replacement characters, as an editor shows them
    text = rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(F.col("text").isNotNull())
    contract = is_contract(p)
    kept = text.where(contract | accepted(F.col("text")))
    return kept.select("path", F.when(contract, "contract").otherwise("code").alias("kind"), is_test(p).alias("test"), F.when(~contract, complexity(F.col("text"))).alias("complexity"))


def contract_homes(contracts: DataFrame, packages: DataFrame, code: DataFrame) -> DataFrame:
    """``path, home``: the nearest package of each contract, else the highest directory above it without code.

    ``packages``: directory; ``code``: path. Where every directory holds code, the contract's own is its home.
    """
    from tidemark.functions.paths import ancestors_of, directory_of
    from tidemark.operators.textual import nearest_ancestor

    near = nearest_ancestor(contracts, packages)
    with_code = code.select(F.explode(ancestors_of(F.col("path"))).alias("directory")).distinct().withColumn("has", F.lit(True))
    up = contracts.select("path").distinct().select("path", F.posexplode(ancestors_of(F.col("path"))).alias("depth", "directory"))
    free = up.join(with_code, "directory", "left").where(F.col("has").isNull()).groupBy("path").agg(F.min_by("directory", "depth").alias("free"))
    own = F.coalesce(F.nullif(directory_of(F.col("path")), F.lit("")), F.lit("."))
    return near.join(free, "path", "left").select("path", F.coalesce("home", "free", own).alias("home"))
