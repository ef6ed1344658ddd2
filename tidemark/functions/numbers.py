"""Numbers as they are reported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str) -> Column:
    """Four decimals, ties upwards, never a negative zero."""
    column = F.col(x) if isinstance(x, str) else x
    return F.floor(column.cast("double") * 10000 + 0.5) / 10000 + F.lit(0.0)


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole, null where whole is 0."""
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return F.when(w > 0, p / w)
