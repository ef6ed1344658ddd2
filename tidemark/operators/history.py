"""The relations that every measure of a change history rests on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import is_test
from tidemark.operators.heavy import key_dictionary, key_id
from tidemark.operators.revisions import MAX_CHANGE_SIZE, co_changed_pairs, counted_changes
from tidemark.operators.skew import salted_join, shuffled
from tidemark.session import durable

#: The area of an item that belongs to no module.
ROOT = "."


@dataclass(frozen=True)
class History:
    """``changes`` (change_id, size, slice, window_id, subject_kind, time_s), ``change_items`` (change_id, item)
    and ``items`` (path, module, test, loc, complexity, revisions ...). Rows may repeat and be null.

    A history that is :meth:`keeping` writes what several measures share once, to the checkpoint folder."""

    changes: DataFrame
    change_items: DataFrame
    items: DataFrame | None = None
    max_size: int = MAX_CHANGE_SIZE
    kept: dict[str, DataFrame] | None = field(default=None, compare=False, repr=False)
    names: frozenset[str] | None = field(default=None, compare=False, repr=False)

    def keeping(self, *names: str) -> History:
        """The same history, for a report of many measures: shared intermediate results are made once and read again; with ``names``, only those."""
        return self if self.kept is not None else replace(self, kept={}, names=frozenset(names) or None)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """``make()``; of a history that is keeping, its durable result of the first time."""
        if self.kept is None or self.names is not None and name not in self.names:
            return make()
        if name not in self.kept:
            self.kept[name] = durable(make())
        return self.kept[name]

    def counted(self) -> DataFrame:
        """``change_id`` of every change of at most ``max_size`` files, once."""
        return self.once("counted", lambda: counted_changes(self.changes, self.max_size))

    def change_facts(self) -> DataFrame:
        """One row per non-null ``change_id``: window_id, slice, time_s, subject_kind, size (of differing rows, the largest of each)."""
        kept = [F.max(c).alias(c) for c in ("window_id", "slice", "time_s", "subject_kind", "size")]
        return self.once("change_facts", lambda: self.changes.where(F.col("change_id").isNotNull()).groupBy("change_id").agg(*kept))

    def held(self) -> DataFrame:
        """``change_id, item``: distinct, without nulls; changes of any size."""
        return self.once("held", lambda: self.change_items.where(F.col("change_id").isNotNull() & F.col("item").isNotNull()).select("change_id", "item").distinct())

    def used(self) -> DataFrame:
        """``change_id, item`` of counted changes."""
        return self.once("used", lambda: self.held().join(shuffled(self.counted()), "change_id", "left_semi"))

    def facts(self) -> DataFrame:
        """One row per non-null path: module, test, loc, complexity, score, revisions, breadth (of repeated rows, the largest of each)."""
        numbers = {"loc": F.col("loc"), "complexity": F.col("complexity.total"), "score": F.col("score"), "revisions": F.col("revisions"), "changes": F.col("changes"), "breadth": F.col("breadth")}
        rows = self.items.where(F.col("path").isNotNull())
        out = rows.groupBy("path").agg(F.min("module").alias("module"), F.max("test").alias("marked"), *[F.max(c).alias(n) for n, c in numbers.items()])
        return self.once("facts", lambda: out.select("path", F.coalesce("module", F.lit(ROOT)).alias("module"), F.coalesce("marked", is_test(F.col("path"))).alias("test"), *numbers))

    def areas(self) -> DataFrame:
        """``item, area, test``: the module of each known item."""
        return self.facts().select(F.col("path").alias("item"), F.col("module").alias("area"), "test")

    def touched(self) -> DataFrame:
        """``change_id, item, area, test`` of counted changes; an unknown item lies in the root area."""
        from tidemark.functions.paths import is_test as by_path

        def make() -> DataFrame:
            rows = salted_join(self.used(), self.areas(), "item", "change_id", "left")
            return rows.select("change_id", "item", F.coalesce("area", F.lit(ROOT)).alias("area"), F.coalesce("test", by_path(F.col("item"))).alias("test"))

        return self.once("touched", make)

    def touched_areas(self) -> DataFrame:
        """``change_id, area, code``: the areas of each counted change, once; ``code``: it touched a file there that is no test."""
        return self.once("touched_areas", lambda: self.touched().groupBy("change_id", "area").agg(F.bool_or(~F.col("test")).alias("code")))


def pair_counts(used: DataFrame, change: str = "change_id", item: str = "item", seed: int = 0) -> DataFrame:
    """``a, b, shared``: ids of items that occur in one change together, and in how many; a < b by id.

    Each change's items are listed once and expanded from the list, so no self-join
    shuffles the bridge twice; counts are combined on the map side.
    """
    ids = used.select(F.col(change).alias("change_id"), key_id(item, seed).alias("id"))
    return co_changed_pairs(ids).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def named_pairs(pairs: DataFrame, used: DataFrame, item: str = "item", seed: int = 0) -> DataFrame:
    """The pairs with names: ``a, b, shared, changes_a, changes_b``, a < b by name; changes of each in ``used``."""
    known = used.groupBy(F.col(item).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("id", key_id("key", seed))
    checked = key_dictionary(known, "key", seed, "n")
    left = checked.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("n").alias("na"))
    right = checked.select(F.col("id").alias("b"), F.col("key").alias("kb"), F.col("n").alias("nb"))
    # an item may have any number of neighbours: the pairs of one key are salted by the other
    rows = salted_join(salted_join(pairs, left, "a", "b", salts=4), right, "b", "a", salts=4)
    forward = F.col("ka") < F.col("kb")
    return rows.select(
        F.least("ka", "kb").alias("a"),
        F.greatest("ka", "kb").alias("b"),
        "shared",
        F.when(forward, F.col("na")).otherwise(F.col("nb")).alias("changes_a"),
        F.when(forward, F.col("nb")).otherwise(F.col("na")).alias("changes_b"),
    )
