"""Revisions and breadth of every path (FileStats) in the presence of a few very frequent paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.heavy import distinct_per_key, key_dictionary, key_id

#: A change of more files is not counted for co-change.
MAX_CHANGE_SIZE = 50


def counted_changes(changes: DataFrame, max_size: int = MAX_CHANGE_SIZE) -> DataFrame:
    """``change_id`` of every change with ``size <= max_size``, once; null ids and sizes do not count."""
    return changes.where((F.col("size") <= max_size) & F.col("change_id").isNotNull()).select("change_id").distinct()


def counted_items(change_items: DataFrame, changes: DataFrame, max_size: int = MAX_CHANGE_SIZE, seed: int = 0) -> DataFrame:
    """``change_id, id``: distinct items of counted changes, by 64-bit id; one shuffle on ``change_id``."""
    items = change_items.where(F.col("change_id").isNotNull() & F.col("item").isNotNull()).select("change_id", key_id("item", seed).alias("id"))
    return items.join(counted_changes(changes, max_size), "change_id", "left_semi").dropDuplicates(["change_id", "id"])


def co_changed_pairs(items: DataFrame) -> DataFrame:
    """``a, b`` (a < b): a row per counted change and pair of its items, repeated over changes.

    A counted change has at most ``max_size`` files, which bounds the pairs of a basket.
    """
    baskets = items.groupBy("change_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    heads = baskets.select("ids", F.posexplode("ids").alias("i", "a")).where(F.col("i") + 1 < F.size("ids"))
    return heads.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids") - F.col("i") - 1)).alias("b"))


def path_activity(commit_files: DataFrame, commits: DataFrame, change_items: DataFrame, changes: DataFrame, max_size: int = MAX_CHANGE_SIZE, seed: int = 0) -> DataFrame:
    """``path, revisions, breadth``: one row per non-null path of ``commit_files``.

    revisions: distinct ``sha`` with a ``commits`` row whose ``move_only`` is false (null is
    not false). breadth: distinct other items in counted changes. Zero where there is none;
    repeated rows count once. Both counts range-partition on (path, sha) and (item, other).
    """
    real = commits.where(~F.col("move_only") & F.col("sha").isNotNull()).select("sha").distinct()
    touched = commit_files.where(F.col("path").isNotNull() & F.col("sha").isNotNull()).select("sha", key_id("path", seed).alias("id"))
    revisions = distinct_per_key(touched.join(real, "sha", "left_semi"), "id", "sha", "revisions")
    pairs = co_changed_pairs(counted_items(change_items, changes, max_size, seed))
    distinct = pairs.repartitionByRange("a", "b").dropDuplicates(["a", "b"])
    ends = distinct.select(F.explode(F.array("a", "b")).alias("id"))
    breadth = ends.groupBy("id").agg(F.count(F.lit(1)).alias("breadth"))
    # the dictionary spans both tables, so that no item can be taken for another path
    names = commit_files.select("path", F.lit(1).alias("own")).unionByName(change_items.select(F.col("item").alias("path"), F.lit(0).alias("own")))
    known = key_dictionary(names, "path", seed, "own").where("own = 1")
    return (
        known.join(revisions, "id", "left")
        .join(breadth, "id", "left")
        .select(F.col("key").alias("path"), F.coalesce("revisions", F.lit(0)).cast("long").alias("revisions"), F.coalesce("breadth", F.lit(0)).cast("long").alias("breadth"))
    )
