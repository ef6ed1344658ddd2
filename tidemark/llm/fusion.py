"""One ranking from several scores on different scales.

Each score is standardised by the group's median and median absolute deviation, squashed
by the logistic function, and the bounded values are combined by a weighted geometric
mean: a file must do well by all scores, and no score can outweigh the rest by its range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import salted_join

#: A normal distribution's standard deviation in units of its median absolute deviation.
MAD_TO_SIGMA = 1.4826
#: The same for the mean absolute deviation, taken where more than half the values are equal.
MEAN_AD_TO_SIGMA = 1.2533
#: Present values are kept within [FLOOR, 1]; a missing value counts MISSING, below all others.
FLOOR, MISSING = 1e-6, 1e-9
#: Relative rank error of the mergeable quantile sketch is 1 / ACCURACY; exact up to that many values.
ACCURACY = 10_000


def _number(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def fused_scores(df: DataFrame, group: str, item: str, scores: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """``group, item, items, n_<score>..., fused``: a row per distinct non-null (group, item).

    ``scores``: name to (column, weight). ``n_<score>`` is the bounded value in (0, 1),
    ``fused`` their weighted geometric mean, ``items`` the group's item count. Of several rows
    of one item the largest value of each score counts. A null or NaN score stands below all
    present ones. A score that is equal throughout a group is 0.5 for all of it.
    """
    names = list(scores)
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("__g"), F.col(item).alias("__i"), *[_number(c.cast("double")).alias(n) for n, (c, _) in scores.items()])
    rows = rows.groupBy("__g", "__i").agg(*[F.max(n).alias(n) for n in names])
    centre = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("items"), *[F.percentile_approx(n, 0.5, ACCURACY).alias(f"m_{n}") for n in names])
    off = salted_join(rows, centre, "__g", "__i").withColumns({f"d_{n}": F.abs(F.col(n) - F.col(f"m_{n}")) for n in names})
    spread = off.groupBy("__g").agg(
        *[F.percentile_approx(f"d_{n}", 0.5, ACCURACY).alias(f"mad_{n}") for n in names],
        *[F.avg(f"d_{n}").alias(f"ad_{n}") for n in names],
    )
    wide = salted_join(off, spread, "__g", "__i")

    def bounded(n: str) -> Column:
        scale = F.when(F.col(f"mad_{n}") > 0, F.col(f"mad_{n}") * MAD_TO_SIGMA).otherwise(F.col(f"ad_{n}") * MEAN_AD_TO_SIGMA)
        z = F.when(scale > 0, (F.col(n) - F.col(f"m_{n}")) / scale).otherwise(0.0)
        return F.when(F.col(n).isNull(), MISSING).otherwise(F.greatest(F.lit(FLOOR), 1 / (1 + F.exp(-z))))

    wide = wide.withColumns({f"n_{n}": bounded(n) for n in names})
    weight = sum(w for _, w in scores.values())
    log = sum((F.log(f"n_{n}") * (w / weight) for n, (_, w) in scores.items()), F.lit(0.0))
    return wide.select(F.col("__g").alias(group), F.col("__i").alias(item), "items", *[f"n_{n}" for n in names], F.exp(log).alias("fused"))


def top_of_group(fused: DataFrame, group: str, item: str, min_items: int = 20) -> DataFrame:
    """``group, item``: the first item of each group of at least ``min_items``; ties go to the smaller item."""
    return fused.where(F.col("items") >= min_items).groupBy(group).agg(F.min_by(item, F.struct(-F.col("fused"), F.col(item))).alias(item))


def file_scores() -> dict[str, tuple[Column, float]]:
    """The four scores of a file, of equal weight."""
    return {"revisions": (F.col("revisions"), 1.0), "loc": (F.col("loc"), 1.0), "complexity": (F.col("complexity.total"), 1.0), "score": (F.col("score"), 1.0)}
