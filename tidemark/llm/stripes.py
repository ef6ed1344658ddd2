"""Items that appear together: stripes of co-occurring neighbours and their significance.

Each task turns its baskets into stripes (item -> neighbours and counts), combining in
memory before anything is shuffled; stripes of an item meet in one task and are merged by
neighbour. Stripes of the few heavy items are cut by neighbour, so that no item needs one
task to itself. An item is a 64-bit id here; a dictionary check proves ids unambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.heavy import key_dictionary, key_id
from tidemark.operators.skew import salted_join

#: Items with more than 1/HEAVY of all rows are heavy; there are fewer than HEAVY of them.
HEAVY = 1000
#: Parts of a heavy item's stripe.
PARTS = 64
#: Pairs held by a task before they are combined into stripes.
BUFFER = 1_000_000

STRIPE = "item long, part int, neighbours array<long>, counts array<long>"


def expand(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (earlier, later) pairs within each basket values[offsets[i]:offsets[i+1]]."""
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)
    at = np.arange(offsets[0], offsets[-1])
    later = ends - at - 1
    total = int(later.sum())
    first = np.repeat(at, later)
    step = np.arange(total) - np.repeat(np.cumsum(later) - later, later) + 1
    return values[first], values[first + step]


def combine(a: np.ndarray, b: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order, with the sum of n (or the count)."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    counts = np.diff(np.r_[starts, len(a)]) if n is None else np.add.reduceat(n[order], starts)
    return a[starts], b[starts], counts.astype(np.int64)


def _to_stripes(heavy: frozenset[int]):
    heavy_ids = np.array(sorted(heavy), np.int64)

    def emit(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a, b, n = combine(np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]), None)
        part = np.where(np.isin(a, heavy_ids), b & (PARTS - 1), 0).astype(np.int32)
        order = np.lexsort((b, part, a))
        a, b, n, part = a[order], b[order], n[order], part[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
        bounds = pa.array(np.r_[starts, len(a)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (b, n)]
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(part[starts]), *lists], ["item", "part", "neighbours", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            lists = batch.column(0)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(offsets).astype(np.int64)
            # cut the batch where its pairs would exceed the buffer
            cuts = np.cumsum(sizes * (sizes - 1) // 2) // BUFFER
            for piece in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(cuts)) + 1):
                if len(piece):
                    pair = expand(values, offsets[piece[0] : piece[-1] + 2].astype(np.int64))
                    if len(pair[0]):
                        held.append(pair)
                        size += len(pair[0])
                if size >= BUFFER:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return run


def _merge(min_count: int):
    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        lists, counts = batch.column(2), batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        return (np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(1).to_numpy(), sizes), lists.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False))

    def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        a, b, n = combine(a, b, n)
        keep = n >= min_count
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(n[keep])], ["a", "b", "shared"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, part, b, n = flat(batch)
            if carry is not None:
                a, part, b, n = (np.concatenate(x) for x in zip(carry, (a, part, b, n), strict=True))
            if not len(a):
                continue
            last = (a == a[-1]) & (part == part[-1])  # rows are sorted: the last stripe may go on in the next batch
            ready = ~last
            if ready.any():
                yield out(a[ready], b[ready], n[ready])
            x, y, z = combine(a[last], b[last], n[last])
            carry = (x, np.full(len(x), part[-1], part.dtype), y, z)
        if carry is not None:
            yield out(carry[0], carry[2], carry[3])

    return run


def heavy_ids(rows: DataFrame, column: str) -> frozenset[int]:
    """Ids with more than 1/HEAVY of the rows; fewer than HEAVY by construction."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = rows.select((F.count(F.lit(1)) / HEAVY).alias("t")).scalar()
    return frozenset(r[0] for r in counts.where(F.col("n") > total).select(column).collect())


def co_occurrences(baskets: DataFrame, basket: str, item: str, heavy: frozenset[int] = frozenset(), min_count: int = 1) -> DataFrame:
    """``a, b, shared`` (a < b): baskets that hold both items, for all pairs with ``shared >= min_count``.

    ``baskets`` has distinct (basket, item id) rows without nulls. Pairs of a basket are
    expanded from its sorted list, so its size should be bounded by the caller's rule.
    """
    lists = baskets.groupBy(basket).agg(F.sort_array(F.collect_list(item)).alias("ids")).where(F.size("ids") > 1).select("ids")
    stripes = lists.mapInArrow(_to_stripes(heavy), STRIPE)
    together = stripes.repartition("item", "part").sortWithinPartitions("item", "part")
    return together.mapInArrow(_merge(min_count), "a long, b long, shared long")


def log_likelihood(both: Column, a: Column, b: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of the 2x2 table of two items; 0 where they are independent."""

    def h(*cells: Column) -> Column:
        whole = sum(cells[1:], cells[0])
        return sum((F.when(c > 0, c * F.log(c / whole)).otherwise(0.0) for c in cells), F.lit(0.0))

    k12, k21, k22 = a - both, b - both, total - a - b + both
    rows, columns = h(both + k12, k21 + k22), h(both + k21, k12 + k22)
    return F.greatest(F.lit(0.0), 2 * (h(both, k12, k21, k22) - rows - columns))


def partners(change_items: DataFrame, changes: DataFrame, max_size: int = 50, min_shared: int = 1, seed: int = 0) -> DataFrame:
    """``item_a, item_b, shared, changes_a, changes_b, counted_a, counted_b, counted, degree, lift, llr``.

    A row per pair of items with at least ``min_shared`` counted changes in common, the
    smaller item first. changes: distinct change ids of an item, counted or not; counted: those
    of counted changes (a row in ``changes`` with ``size <= max_size``); degree = 2 shared /
    (changes_a + changes_b); lift = shared * counted / (counted_a * counted_b); llr its
    significance. Null ids and items take no part; repeated rows count once.
    """
    rows = change_items.where(F.col("change_id").isNotNull() & F.col("item").isNotNull()).select("change_id", "item")
    valid = changes.where((F.col("size") <= max_size) & F.col("change_id").isNotNull()).select("change_id").distinct()
    ids = rows.select("change_id", key_id("item", seed).alias("id"))
    flagged = ids.dropDuplicates(["change_id", "id"]).join(valid.withColumn("valid", F.lit(1)), "change_id", "left")
    heavy = heavy_ids(ids.select("id"), "id")
    pairs = co_occurrences(flagged.where("valid = 1").select("change_id", "id"), "change_id", "id", heavy, min_shared)
    stats = flagged.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("valid").alias("c"))
    known = key_dictionary(rows, "item", seed).join(stats, "id")
    side = lambda x: known.select(F.col("id").alias(x), F.col("key").alias(f"key_{x}"), F.col("n").alias(f"n_{x}"), F.col("c").alias(f"c_{x}"))
    # an item may have any number of neighbours: the pairs of one key are salted by the other
    both = salted_join(salted_join(pairs, side("a"), "a", "b", salts=4), side("b"), "b", "a", salts=4).withColumn("counted", valid.select(F.count(F.lit(1))).scalar())
    first = F.col("key_a") < F.col("key_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    out = both.select(
        F.least("key_a", "key_b").alias("item_a"),
        F.greatest("key_a", "key_b").alias("item_b"),
        "shared",
        pick("n_a", "n_b").alias("changes_a"),
        pick("n_b", "n_a").alias("changes_b"),
        pick("c_a", "c_b").alias("counted_a"),
        pick("c_b", "c_a").alias("counted_b"),
        "counted",
    )
    return out.withColumns(
        {
            "degree": 2 * F.col("shared") / (F.col("changes_a") + F.col("changes_b")),
            "lift": F.col("shared") * F.col("counted") / (F.col("counted_a") * F.col("counted_b")),
            "llr": log_likelihood(F.col("shared"), F.col("counted_a"), F.col("counted_b"), F.col("counted")),
        }
    )


def strong_partners(change_items: DataFrame, changes: DataFrame, max_size: int = 50, min_shared: int = 3, min_degree: float = 0.3, min_lift: float = 2.0, min_llr: float = 0.0) -> DataFrame:
    """``item_a, item_b``: pairs of :func:`partners` at or above all thresholds (exact at the edges); ``min_llr``: least log-likelihood ratio, none by default."""
    rows = partners(change_items, changes, max_size, min_shared)
    degree = 2 * F.col("shared") >= F.lit(min_degree) * (F.col("changes_a") + F.col("changes_b"))
    whole = F.col("shared") * F.col("counted") >= F.lit(min_lift) * F.col("counted_a") * F.col("counted_b")
    return rows.where(F.col("degree").isNotNull() & ((F.col("degree") >= min_degree) | degree) & whole & (F.col("llr") >= min_llr)).select("item_a", "item_b")
