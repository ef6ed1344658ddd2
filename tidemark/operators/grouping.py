"""Commits that belong to one logical change: by pull request, then by ticket within a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.subjects import majority_kind, pull_request_of, subject_kind, ticket_of
from tidemark.operators.graph import components
from tidemark.operators.mechanical import commit_rows, file_rows

SPAN = 14 * 24 * 60 * 60
MAX_COMMITS, MAX_FILES = 30, 50


def anchored(times: Column, span: int = SPAN) -> Column:
    """For a sorted array of times, the first time of the run each belongs to: a run ends ``span`` after its first."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(times, start, lambda runs, t: F.concat(runs, F.array(F.when(F.size(runs).eqNullSafe(0), t).when(t - F.element_at(runs, -1) > span, t).otherwise(F.element_at(runs, -1)))))


def runs_of(rows: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """``sha, group``: rows of one key grouped into anchored runs; null keys take no part.

    The distinct times of a key are listed, not its rows, so that the list stays short for
    a key that many commits of one moment share.
    """
    known = rows.where(F.col(key).isNotNull())
    starts = known.groupBy(key).agg(F.sort_array(F.collect_set("time_s")).alias("times")).withColumn("firsts", anchored(F.col("times"), span))
    by_time = starts.select(key, F.inline(F.arrays_zip(F.col("times").alias("time_s"), F.col("firsts").alias("first"))))
    return known.join(by_time, [key, "time_s"]).select("sha", F.concat_ws("#", F.lit(key), F.col(key).cast("string"), F.col("first").cast("string")).alias("group"))


def _stars(groups: DataFrame) -> DataFrame:
    """``a, b``: every member of a group with the group's smallest member."""
    least = groups.groupBy("group").agg(F.min("sha").alias("a"))
    return groups.join(least, "group").select("a", F.col("sha").alias("b"))


def logical_changes(commits: DataFrame, commit_files: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """``sha, change``: every real commit with the smallest commit of its logical change.

    Commits share a change if their subjects end in the same pull request number within 14
    days of the first, or one pull request merge brought them in (``merges``: sha, merge); such
    groups of more than 30 commits are dissolved. Commits that name one ticket within 14 days
    join then, if the whole has at most 30 commits and 50 files; otherwise the parts stay.
    Pure moves are left out.
    """
    rows = commit_rows(commits).where(~F.coalesce("move_only", F.lit(False))).select("sha", "time_s", pull_request_of(F.col("subject")).alias("pr"), ticket_of(F.col("subject")).alias("ticket"))
    groups = runs_of(rows, "pr")
    if merges is not None:
        brought = merges.join(rows.where(F.col("pr").isNull()), "sha", "left_semi").select("sha", F.concat(F.lit("merge#"), F.col("merge")).alias("group"))
        groups = groups.unionByName(brought)
    small = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") <= MAX_COMMITS) & (F.col("n") > 1)).select("group")
    by_request = _stars(groups.join(small, "group", "left_semi"))
    by_ticket = _stars(runs_of(rows, "ticket"))
    parts = components(by_request).select(F.col("node").alias("sha"), F.col("component").alias("part"))
    wide = components(by_request.unionByName(by_ticket)).select(F.col("node").alias("sha"), F.col("component").alias("wide"))
    all_ = rows.select("sha").join(parts, "sha", "left").join(wide, "sha", "left")
    all_ = all_.select("sha", F.coalesce("part", "sha").alias("part"), F.coalesce("wide", "sha").alias("wide"))
    commits_of = all_.groupBy("wide").agg(F.count(F.lit(1)).alias("commits"))
    files = all_.join(file_rows(commit_files).select("sha", "path"), "sha").select("wide", "path").distinct().groupBy("wide").agg(F.count(F.lit(1)).alias("files"))
    sizes = commits_of.join(files, "wide", "left").fillna(0, ["files"])
    joined = all_.join(sizes, "wide")
    one = (F.col("commits") <= MAX_COMMITS) & (F.col("files") <= MAX_FILES)
    return joined.select("sha", F.when(one, F.col("wide")).otherwise(F.col("part")).alias("change"))


def change_table(members: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """``change, commits, size, subject_kind, time_s``: the logical changes of :func:`logical_changes`."""
    rows = members.join(commit_rows(commits).select("sha", "time_s", subject_kind(F.col("subject")).alias("kind")), "sha")
    facts = rows.groupBy("change").agg(F.count(F.lit(1)).alias("commits"), majority_kind(F.col("kind")).alias("subject_kind"), F.max("time_s").alias("time_s"))
    sizes = members.join(file_rows(commit_files).select("sha", "path"), "sha").select("change", "path").distinct().groupBy("change").agg(F.count(F.lit(1)).alias("size"))
    return facts.join(sizes, "change", "left").fillna(0, ["size"]).select("change", "commits", "size", "subject_kind", "time_s")
