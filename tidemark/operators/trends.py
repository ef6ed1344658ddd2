"""How boundaries move over time: shares per slice, robust trend lines and the gate for a real shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded
from tidemark.operators.history import History
from tidemark.operators.modules import MODULE_FLOOR, MODULE_SHARE, area_tally
from tidemark.operators.skew import shuffled
from tidemark.session import durable

TREND_POINTS, VERDICT_POINTS = 3, 5
MIN_SHIFT, SIGMAS, ALLOWANCE, SHARE_FLOOR = 0.1, 2.0, 1.15, 0.05
SLICE_CHANGES = 10
#: How many of the latest slices count as still changing.
RECENT = 2


def _slice_shares(history: History, least: int = SLICE_CHANGES) -> DataFrame:
    """Exact shares; an area counts in a slice from the module floor of that slice's counted changes on, and from ``least``."""
    slices = history.change_facts().where(F.col("slice").isNotNull() & (F.col("size") <= history.max_size)).select("change_id", "slice")
    floor = slices.groupBy("slice").agg(F.greatest(F.lit(least), F.lit(MODULE_FLOOR), F.ceil(F.count(F.lit(1)) * MODULE_SHARE)).cast("long").alias("floor"))
    only = history.areas().groupBy("area").agg(F.min("test").alias("only")).where("only").select("area")
    rows = area_tally(history.touched_areas().join(shuffled(slices), "change_id"), "slice").join(F.broadcast(floor), "slice")  # a row per slice
    rows = rows.where(F.col("changes") >= F.col("floor")).join(only, "area", "left_anti")
    return rows.select("slice", "area", "changes", (F.col("local") / F.col("changes")).alias("share"))


def slice_cohesion(history: History, least: int = SLICE_CHANGES) -> DataFrame:
    """``slice, area, changes, share``: local share of each area's changes per slice, where it has enough of them; no areas of tests only."""
    return _slice_shares(history, least).withColumn("share", rounded("share"))


def _line(s: Column) -> tuple[Column, Column]:
    """Slope and intercept of the robust line through an array of points (x, y): medians of the pairwise slopes and of y - slope x."""
    slope = _median(F.flatten(F.transform(s, lambda p: F.transform(F.filter(s, lambda q: q["x"] > p["x"]), lambda q: (q["y"] - p["y"]) / (q["x"] - p["x"])))))
    return slope, _median(F.transform(s, lambda p: p["y"] - slope * p["x"]))


def theil_sen(points: DataFrame, key: str, x: str, y: str, least: int = TREND_POINTS) -> DataFrame:
    """``key, points, slope, from, to``: the robust line of each key, exact; none below ``least`` points.

    Slope is the median of all pairwise slopes, intercept the median of y - slope x. The
    points of a key are a series of few slices, so a key's pairs are bounded by its length.
    """
    series = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("s"))
    series = series.where(F.size("s") >= least)
    slopes = F.flatten(F.transform("s", lambda p: F.transform(F.filter("s", lambda q: q["x"] > p["x"]), lambda q: (q["y"] - p["y"]) / (q["x"] - p["x"]))))
    rows = series.withColumn("slope", _median(slopes))
    rows = rows.withColumn("intercept", _median(F.transform("s", lambda p: p["y"] - F.col("slope") * p["x"])))
    at = lambda p: F.col("intercept") + F.col("slope") * p["x"]
    return rows.select(key, F.size("s").cast("long").alias("points"), "slope", at(F.element_at("s", 1)).alias("from"), at(F.element_at("s", -1)).alias("to"))


def _median(values):
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def area_lines(history: History) -> DataFrame:
    """``area, points, slope, from, to``: trend line of each area's local share."""
    rows = theil_sen(_slice_shares(history), "area", "slice", "share")
    return rows.select("area", "points", *[rounded(c).alias(c) for c in ("slope", "from", "to")])


def _moved(s: Column, slope: Column) -> Column:
    """Whether a line's shift over the points (x, y, n) exceeds its noise: eroding, improving or holding.

    A share has a binomial variance; that of a weighted line's slope is 1 / sum(w (x - mean)^2).
    """
    total = F.aggregate(s, F.lit(0.0), lambda t, p: t + p["n"])
    sum_ = lambda f: F.aggregate(s, F.lit(0.0), lambda t, p: t + f(p))
    pooled = F.least(F.lit(1 - SHARE_FLOOR), F.greatest(F.lit(SHARE_FLOOR), sum_(lambda p: p["y"] * p["n"]) / total))
    middle = sum_(lambda p: p["x"] * p["n"]) / total
    spread = sum_(lambda p: p["n"] * (p["x"] - middle) * (p["x"] - middle)) / (pooled * (1 - pooled))
    span = F.element_at(s, -1)["x"] - F.element_at(s, 1)["x"]
    needed = F.greatest(F.lit(MIN_SHIFT), SIGMAS * ALLOWANCE * span / F.sqrt(spread))
    shift = slope * span
    return F.when(shift <= -needed, "eroding").when(shift >= needed, "improving").otherwise("holding")


def judged(series: DataFrame, s: str = "s") -> DataFrame:
    """The rows with ``slope, intercept, verdict`` of their array of points (x, y, n) in order: three points at least, else null.

    A fall or a rise stands only if the points without the first and the last, taken off together, say the same, which takes five.
    """
    points = F.col(s)
    rows = series.withColumn("enough", F.size(points) >= TREND_POINTS)
    slope, intercept = _line(points)
    rows = rows.withColumn("slope", F.when(F.col("enough"), slope))
    rows = rows.withColumn("intercept", F.when(F.col("enough"), _median(F.transform(points, lambda p: p["y"] - F.col("slope") * p["x"]))))
    rows = rows.withColumn("inner", F.when(F.size(points) >= VERDICT_POINTS, F.slice(points, 2, F.greatest(F.size(points) - 2, F.lit(0)))))
    rows = rows.withColumn("inner_slope", F.when(F.col("inner").isNotNull(), _line(F.col("inner"))[0]))
    whole, within = _moved(points, F.col("slope")), _moved(F.col("inner"), F.col("inner_slope"))
    verdict = F.when(F.col("inner").isNotNull() & (whole == within), whole).otherwise("holding")
    return rows.withColumn("verdict", F.when(F.col("enough"), verdict)).drop("enough", "inner", "inner_slope")


def _series(rows: DataFrame, *keys: str) -> DataFrame:
    point = F.struct(F.col("slice").cast("double").alias("x"), F.col("share").alias("y"), F.col("changes").cast("double").alias("n"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("s"))


def erosion(history: History) -> DataFrame:
    """``area, windows, from, to, verdict, recent``: how each area's cohesion moved over the slices; none below three of them.

    verdict: eroding, improving or holding, see :func:`judged`. recent: the area has evidence in
    one of the last two slices of the series. Everything is computed in arrays of at most a point a slice.
    """
    newest = history.change_facts().agg(F.max("slice")).scalar()
    rows = judged(_series(_slice_shares(history), "area").where(F.size("s") >= TREND_POINTS))
    at = lambda i: F.col("intercept") + F.col("slope") * F.element_at("s", i)["x"]
    return rows.select("area", F.size("s").cast("long").alias("windows"), rounded(at(1)).alias("from"), rounded(at(-1)).alias("to"), "verdict", (F.element_at("s", -1)["x"] > newest - RECENT).alias("recent"))


def slice_measures(history: History) -> DataFrame:
    """``slice, changes, active, measured, median, p90, local``: counted changes of each slice and their radius; see :func:`tidemark.operators.modules.change_radius`."""
    from tidemark.operators.hotspots import active_slices
    from tidemark.operators.modules import radius_rows

    facts = history.change_facts().where(F.col("slice").isNotNull()).select("change_id", "slice")
    n = radius_rows(history).groupBy("change_id").agg(F.count(F.lit(1)).alias("n")).join(shuffled(facts), "change_id")
    radius = n.groupBy("slice").agg(
        F.count(F.lit(1)).alias("measured"),
        F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY n) AS bigint)").alias("median"),
        F.expr("cast(percentile_disc(0.9) WITHIN GROUP (ORDER BY n) AS bigint)").alias("p90"),
        rounded(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0))).alias("local"),
    )
    return active_slices(history).join(radius, "slice", "left").select("slice", "changes", "active", F.coalesce("measured", F.lit(0)).alias("measured"), "median", "p90", "local")


def repository_erosion(history: History) -> DataFrame:
    """``windows, from, to, verdict, inactive_since``: one row, whether changes stay local as often as they used to.

    Judged over the active slices that have a radius; unknown below three of them. inactive_since:
    the first slice of the quiet end of the series, null if its last slice is active. No row without any slice.
    """
    slices = durable(slice_measures(history))  # a row per slice, read four times
    points = slices.where("active and local is not null").select("slice", F.col("local").alias("share"), F.col("measured").alias("changes"))
    ends = {"newest": F.max("slice"), "last": F.max(F.when(F.col("active"), F.col("slice"))), "first": F.min("slice")}
    # the series of the whole history is one row of at most a point a slice
    series = points.agg(F.sort_array(F.collect_list(F.struct(F.col("slice").cast("double").alias("x"), F.col("share").alias("y"), F.col("changes").cast("double").alias("n")))).alias("s"))
    rows = judged(series).withColumns({name: slices.agg(c).scalar() for name, c in ends.items()}).where("newest is not null")
    at = lambda i: F.when(F.col("slope").isNotNull(), rounded(F.col("intercept") + F.col("slope") * F.try_element_at("s", F.lit(i))["x"]))
    quiet = F.when(F.col("last").isNull(), F.col("first")).when(F.col("last") < F.col("newest"), F.col("last") + 1)
    return rows.select(F.size("s").cast("long").alias("windows"), at(1).alias("from"), at(-1).alias("to"), F.coalesce("verdict", F.lit("unknown")).alias("verdict"), quiet.cast("long").alias("inactive_since"))


def module_trends(history: History, before: str = "before", now: str = "current") -> DataFrame:
    """``area, was, is, delta``: local share in two windows, of areas that changed in both."""
    windows = history.change_facts().select("change_id", "window_id")
    rows = area_tally(history.touched_areas().join(shuffled(windows), "change_id"), "window_id")
    wide = rows.groupBy("area").pivot("window_id", [before, now]).agg(F.sum("changes").alias("n"), F.sum("local").alias("l"))
    wide = wide.where(f"`{before}_n` > 0 and `{now}_n` > 0")
    was, now_ = F.coalesce(F.col(f"{before}_l"), F.lit(0)) / F.col(f"{before}_n"), F.coalesce(F.col(f"{now}_l"), F.lit(0)) / F.col(f"{now}_n")
    return wide.select("area", rounded(was).alias("was"), rounded(now_).alias("is"), rounded(now_ - was).alias("delta"))
