"""Joins that keep a heavy key from ending in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled(right: DataFrame) -> DataFrame:
    """A side of a join that grows with the history: the join shuffles it and never broadcasts it.

    Spark takes a side's size from its compressed files, so a table with a row per change or file
    can look small enough to be broadcast and exceed the driver's memory once it is unpacked and hashed.
    """
    return right.hint("merge")


def salted_join(left: DataFrame, right: DataFrame, key: str, salt: str, how: str = "inner", salts: int = 16, small: bool = False) -> DataFrame:
    """Equi-join on ``key`` with the rows of a heavy left key spread over ``salts`` tasks.

    ``right`` must be small against ``left`` (one row per key, as aggregates are): it is
    repeated ``salts`` times. The salt of a left row is a hash of its column ``salt``. Null
    keys match nothing. ``how``: inner or left. Columns of both sides must not clash.

    Both sides are shuffled (:func:`shuffled`; Spark's estimate of ``right`` leaves its copies out),
    unless ``right`` is known to be ``small`` with all its copies: then Spark may broadcast it.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    a = left.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b if small else shuffled(b), [key, "__salt"], how).drop("__salt")
