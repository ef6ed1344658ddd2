"""Per-key results where a few keys hold most rows.

Rows are range-partitioned on (key, secondary order): Spark samples the composite
quantiles, so a key with a tenth or a third of all rows simply covers several ranges.
Equal (key, order) values always share a partition; each partition therefore computes
exact partial states, and only one row per (partition, key) travels to be stitched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_id(column: Column | str, seed: int = 0) -> Column:
    """64-bit id of a text key; :func:`key_dictionary` proves it free of collisions."""
    return F.xxhash64(F.lit(seed), column)


def key_dictionary(keys: DataFrame, key: str, seed: int = 0, flag: str | None = None) -> DataFrame:
    """``id, key``: one row per distinct non-null key; with ``flag``, also the largest value of that column.

    Fails with an error instead of mixing two keys, should two ever share an id (then
    take another ``seed``); so results counted on ids are exact.
    """
    rows = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *([flag] if flag else []))
    texts = rows.groupBy("key").agg(F.max(flag).alias(flag)) if flag else rows.distinct()
    one = texts.groupBy(key_id("key", seed).alias("id")).agg(F.count(F.lit(1)).alias("__texts"), F.first("key").alias("key"), *([F.max(flag).alias(flag)] if flag else []))
    clash = F.raise_error(F.lit("two keys share an id: change the seed")).cast("string")
    return one.select("id", F.when(F.col("__texts") == 1, F.col("key")).otherwise(clash).alias("key"), *([flag] if flag else []))


def range_split(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows partitioned by sampled quantiles of (key, order); heavy keys cover several partitions."""
    return df.repartitionByRange(*[F.col(c) for c in (*key, *order)])


def distinct_per_key(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``key, out``: number of distinct non-null values of each non-null key.

    The range partitioning already clusters equal (key, value), so the de-duplication adds
    no second shuffle; the partial counts of a split key are stitched by a sum.
    An empty input gives no rows.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)
    return range_split(rows, [key], [value]).dropDuplicates([key, value]).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def number_within_key(df: DataFrame, key: str, order: Sequence[str], out: str = "n", total: str | None = None) -> DataFrame:
    """Rows numbered 1.. within their key by ``order``, without one task per key.

    Each range partition numbers its own part of a key; the sizes of the parts (one row
    per partition and key) are summed up and added to later parts. With ``total``, that
    column holds the key's row count. Ties of ``order`` are numbered in an arbitrary but
    gap-free way; rows with a null key form one key. The input is made durable first, as
    two passes must see the same partitions.
    """
    from tidemark.session import durable

    parted = durable(range_split(df, [key], list(order)).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", key).orderBy(*order)
    local = parted.withColumn(out, F.row_number().over(within))
    parts = parted.groupBy("__part", key).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(key).orderBy("__part")
    offsets = parts.select(
        F.col("__part").alias("__p"),
        F.col(key).alias("__k"),
        (F.sum("__rows").over(before) - F.col("__rows")).alias("__before"),
        F.sum("__rows").over(Window.partitionBy(key)).alias("__total"),
    )
    joined = local.join(offsets, (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")), "left")
    kept = [F.col(c) for c in df.columns] + [(F.col(out) + F.col("__before")).alias(out)]
    return joined.select(*kept, *([F.col("__total").alias(total)] if total else []))


def value_ranks(df: DataFrame, key: str | None, value: str) -> DataFrame:
    """``[key,] value, rank, total``: competition rank of each distinct value in its key, the largest first, and the key's row count.

    Equal values are counted before they travel; each range partition sums up its own part of
    a key and the sums of earlier parts are added, so no task holds a whole key. Rows with a
    null key or value take no part.
    """
    from tidemark.session import durable

    whole = F.lit(0) if key is None else F.col(key)
    counts = df.where(F.col(value).isNotNull() & whole.isNotNull()).groupBy(whole.alias("__key"), F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    parted = durable(range_split(counts.withColumn("__down", -F.col("__value")), ["__key"], ["__down"]).withColumn("__part", F.spark_partition_id()))
    local = parted.withColumn("__upto", F.sum("__n").over(Window.partitionBy("__part", "__key").orderBy("__down")))
    parts = parted.groupBy("__part", "__key").agg(F.sum("__n").alias("__rows"))
    by = Window.partitionBy("__key")
    offsets = parts.select("__part", "__key", (F.sum("__rows").over(by.orderBy("__part")) - F.col("__rows")).alias("__before"), F.sum("__rows").over(by).alias("total"))
    out = local.join(offsets, ["__part", "__key"])
    rank = F.col("__before") + F.col("__upto") - F.col("__n") + 1
    return out.select(*([F.col("__key").alias(key)] if key else []), F.col("__value").alias(value), rank.alias("rank"), "total")


def last_before(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The rows with ``before_<c>`` of each column: its last non-null value among the key's rows of a smaller ``order``.

    An as-of lookup without a task per key: rows are range-partitioned by (key, order), so that a
    heavy key spans several ranges; each range looks back within itself, and the last values of
    a key's ranges (a row per range and key) are carried on to its later ranges. Rows of equal
    order see the same. ``order`` must be a whole number; null keys look up nothing.
    """
    from tidemark.session import durable

    ranged = durable(rows.repartitionByRange(key, order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", key).orderBy(order)
    looked = ranged.withColumns({f"__in_{c}": F.last(c, ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, -1)) for c in columns})
    ends = ranged.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"), "__range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    carried = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__key", F.col("__range").alias("__at"), *[F.last(c, ignorenulls=True).over(carried).alias(f"__far_{c}") for c in columns])
    known = ends.where(" or ".join(f"__far_{c} is not null" for c in columns))
    out = looked.join(known, (F.col(key) == F.col("__key")) & (F.col("__range") == F.col("__at")), "left")
    return out.select(*rows.columns, *[F.coalesce(f"__in_{c}", f"__far_{c}").alias(f"before_{c}") for c in columns])
