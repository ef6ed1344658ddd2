"""Commits that change nothing by themselves: set aside, moves, white space, reverts with what they undo, and repeated patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.session import durable

KINDS = ("ignored", "moves", "whitespace", "reverts", "duplicates")


def commit_rows(commits: DataFrame) -> DataFrame:
    """One row per non-null sha: the row recorded first, all its columns. Combined before the shuffle, not sorted."""
    first = F.min_by(F.struct(*commits.columns), F.struct(F.col("recorded_at").isNotNull(), "recorded_at", F.col("log_pos").isNotNull(), "log_pos"))
    return commits.where(F.col("sha").isNotNull()).groupBy(F.col("sha").alias("__sha")).agg(first.alias("__row")).select("__row.*")


def file_rows(commit_files: DataFrame) -> DataFrame:
    """Distinct (sha, path) rows with both blobs; of differing rows the largest values."""
    rows = commit_files.where(F.col("sha").isNotNull() & F.col("path").isNotNull())
    return rows.groupBy("sha", "path").agg(F.max("blob_old").alias("blob_old"), F.max("blob_new").alias("blob_new"), F.max("added").alias("added"), F.max("deleted").alias("deleted"))


#: Up to this many shas are sent to every task.
FEW = 100_000


def _of(rows: DataFrame, shas: DataFrame) -> DataFrame:
    """The rows of some commits. Few shas are sent to every task, so that only the rows of their commits are shuffled."""
    shas = durable(shas.select("sha").distinct())
    return rows.join(F.broadcast(shas) if shas.limit(FEW + 1).count() <= FEW else shas, "sha", "left_semi")


def _named(rows: DataFrame) -> DataFrame:
    named = rows.where(F.col("reverts").isNotNull() & (F.col("reverts") != F.col("sha"))).select(F.col("sha").alias("revert"), F.col("reverts").alias("original"))
    known = _of(rows.select("sha"), named.select(F.col("original").alias("sha")))
    return named.join(known.withColumnRenamed("sha", "original"), "original", "left_semi").select("revert", "original")


def named_reverts(commits: DataFrame) -> DataFrame:
    """``revert, original``: commits that name another known commit, not themselves, as the one they revert."""
    return _named(commit_rows(commits))


def _confirmed(rows: DataFrame, commit_files: DataFrame) -> DataFrame:
    pairs = durable(_named(rows))
    files = file_rows(_of(commit_files, pairs.select(F.explode(F.array("revert", "original")).alias("sha"))))
    mine = pairs.join(files.select(F.col("sha").alias("revert"), "path", F.col("blob_old").alias("was"), F.col("blob_new").alias("now")), "revert")
    theirs = pairs.join(files.select(F.col("sha").alias("original"), "path", F.col("blob_old").alias("before"), F.col("blob_new").alias("after")), "original")
    both = mine.join(theirs, ["revert", "original", "path"], "full")
    undone = F.coalesce((F.col("was") == F.col("after")) & (F.col("now") == F.col("before")), F.lit(False))
    return both.groupBy("revert", "original").agg(F.bool_and(undone).alias("ok"), F.count(F.lit(1)).alias("files")).where("ok").select("revert", "original", "files")


def confirmed_reverts(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """``revert, original, files``: named reverts that swap the blobs of every file of the original and touch no other.

    A file whose blobs are not both known on both sides confirms nothing. One full outer join
    of both file lists per pair; no commit list is gathered in one place.
    """
    return _confirmed(commit_rows(commits), commit_files)


def paired_reverts(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """``revert, original``: confirmed reverts with what they undo, each commit used once, newest first in the order of the log.

    A revert that is reverted itself pairs with its reverter, which leaves the first commit as a
    real change; moves pair with nothing. Pairs that share commits form a component, which is
    walked in one task. Commits of one place in the log go by time (the later first), then sha.
    """
    return _paired(commit_rows(commits), commit_files)


def _paired(rows: DataFrame, commit_files: DataFrame, open_commits: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """``more``: further confirmed pairs. ``open_commits``: those that may pair, of no other kind; all but moves if not given."""
    pairs = _confirmed(rows, commit_files).select("revert", "original")
    pairs = durable(pairs if more is None else pairs.unionByName(more.select("revert", "original")).distinct())
    sides = _of(rows.where(~F.coalesce("move_only", F.lit(False))) if open_commits is None else open_commits, pairs.select(F.explode(F.array("revert", "original")).alias("sha"))).select("sha", "log_pos", "time_s")
    open_ = pairs.join(sides.select(F.col("sha").alias("original")), "original", "left_semi").join(sides.withColumnRenamed("sha", "revert"), "revert")
    open_ = durable(open_.select("revert", "original", "log_pos", "time_s"))
    parts = components(open_, "revert", "original").select(F.col("node").alias("revert"), "component")
    return open_.join(parts, "revert").groupBy("component").applyInPandas(_newest_first, "revert string, original string")


def _newest_first(pairs):
    """The pairs of a frame whose commits no newer pair has used."""
    rows = pairs.sort_values("revert").sort_values("time_s", ascending=False, kind="stable").sort_values("log_pos", kind="stable")
    used: set[str] = set()
    kept = []
    for revert, original in zip(rows["revert"], rows["original"], strict=True):
        free = revert not in used and original not in used
        kept.append(free)
        if free:
            used |= {revert, original}
    return rows.loc[kept, ["revert", "original"]]


def fingerprints(commit_files: DataFrame) -> DataFrame:
    """``sha, files, fingerprint``: 64-bit hash of a commit's files with their blobs; null if a new blob is unknown."""
    rows = file_rows(commit_files.select("sha", "path", "blob_old", "blob_new", "added", "deleted").repartition("sha"))  # one shuffle for both groupings
    each = F.xxhash64("path", "blob_old", "blob_new")
    # a sum of hashes does not depend on the order of the files and combines on the map side
    out = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.col("blob_new").isNotNull()).alias("known"), F.bit_xor(each).alias("x"), F.sum(F.pmod(each, F.lit(1 << 40))).alias("s"))
    return out.select("sha", "files", F.when(F.col("known"), F.xxhash64("x", "s", "files")).alias("fingerprint"))


def duplicates(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """``sha, first``: commits that bring exactly the files and blobs that an older one brought.

    Older by time, then by place in the log. The fingerprint only proposes groups; members
    are compared with the group's first commit file by file.
    """
    return _duplicates(commit_rows(commits), commit_files)


def _duplicates(rows: DataFrame, commit_files: DataFrame) -> DataFrame:
    prints = fingerprints(commit_files).where(F.col("fingerprint").isNotNull())
    rows = rows.select("sha", "time_s", "log_pos").join(prints, "sha")
    first = rows.groupBy("fingerprint", "files").agg(F.min(F.struct("time_s", -F.col("log_pos"), "sha")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    proposed = durable(rows.join(first, ["fingerprint", "files"]).select("sha", F.col("f.sha").alias("first"), "files").where("sha <> first"))
    files = file_rows(_of(commit_files, proposed.select(F.explode(F.array("sha", "first")).alias("sha")))).select("sha", "path", "blob_old", "blob_new")
    own = proposed.join(files, "sha")
    other = files.select(F.col("sha").alias("first"), F.col("path").alias("p"), F.col("blob_old").alias("o"), F.col("blob_new").alias("n"))
    same = own.join(other, (own["first"] == other["first"]) & (own["path"] == other["p"]) & own["blob_old"].eqNullSafe(other["o"]) & own["blob_new"].eqNullSafe(other["n"]))
    return same.groupBy(own["sha"], own["first"], own["files"]).agg(F.count(F.lit(1)).alias("k")).where("k = files").select("sha", "first")


def same_patch(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``sha, first, patch_id``: commits whose patch (sha, patch_id) an older one of the rows has, with the oldest.

    Older by time; of equal times the one further back in the log. A null id is no patch.
    """
    known = rows.select("sha", "time_s", "log_pos").join(ids.where(F.col("patch_id").isNotNull()), "sha")
    oldest = known.groupBy("patch_id").agg(F.min(F.struct("time_s", -F.col("log_pos"), "sha")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(oldest, "patch_id").where(F.col("sha") != F.col("f.sha")).select("sha", F.col("f.sha").alias("first"), "patch_id")


def re_lands(copies: DataFrame, ids: DataFrame, parents: DataFrame) -> DataFrame:
    """``sha``: copies (sha, patch_id) that sit on top of another commit of their patch (``ids``: sha, patch_id; ``parents``: sha, parents).

    Such a patch was backed out and landed again, which changes the code once more. The copies'
    ancestors are walked a step at a time, each looked at once per copy, until a commit of the same patch is met or none is left.
    """
    up = durable(parents.select(F.col("sha").alias("node"), F.explode("parents").alias("next")).distinct())
    of = durable(ids.select(F.col("sha").alias("node"), F.col("patch_id").alias("own")))
    now = durable(copies.select("sha", "patch_id", F.col("sha").alias("node")).distinct())
    seen, found = now.select("sha", "node"), now.select("sha").limit(0)
    while not now.isEmpty():
        step = now.join(up, "node").select("sha", "patch_id", F.col("next").alias("node")).distinct().join(seen, ["sha", "node"], "left_anti").join(of, "node", "left")
        step = durable(step)
        found = durable(found.unionByName(step.where(F.col("own") == F.col("patch_id")).select("sha")).distinct())
        seen = durable(seen.unionByName(step.select("sha", "node")))
        now = durable(step.select("sha", "patch_id", "node").join(found, "sha", "left_anti"))
    return found


def kinds(commits: DataFrame, commit_files: DataFrame, ignored: DataFrame | None = None, patches: DataFrame | None = None, parents: DataFrame | None = None, indented: DataFrame | None = None) -> DataFrame:
    """``sha, kind``: the mechanical kind of every commit, or null for a real one; the first that fits of

    ignored (``ignored``: sha, the revisions a repository asks tools to skip), moves, whitespace, reverts
    (both sides of a confirmed pair, newest first) and duplicates (of an older one among the rest). With
    ``patches`` (sha, patch) white space is told (``indented``: path, where it matters), reverts are confirmed by reverse patch as
    well as by blobs, and duplicates go by patch id; without, duplicates go by blobs. With ``parents``
    (sha, parents) a copy on top of another one of its patch is real.
    """
    from tidemark.operators import patches as digests

    rows = durable(commit_rows(commits.select("sha", "time_s", "log_pos", "move_only", "reverts", "recorded_at")).drop("recorded_at"))
    none = rows.select("sha").limit(0)
    files = None if patches is None else durable(digests.patch_files(patches))
    blank = none if files is None else digests.whitespace_only(files, indented)
    marked = rows.join((none if ignored is None else ignored.select("sha").distinct()).withColumn("i", F.lit(True)), "sha", "left").join(blank.withColumn("w", F.lit(True)), "sha", "left")
    marked = durable(marked.withColumn("own", F.when(F.col("i"), KINDS[0]).when(F.col("move_only"), KINDS[1]).when(F.col("w"), KINDS[2])).drop("i", "w"))
    free = marked.where(F.col("own").isNull()).drop("own")
    more = None if files is None else digests.undone_by_patch(_named(rows), files)
    undone = durable(_paired(rows, commit_files, free, more).select(F.explode(F.array("revert", "original")).alias("sha"))).withColumn("r", F.lit(True))
    rest = free.join(undone, "sha", "left_anti")
    if files is None:
        twice = _duplicates(rest, commit_files).select("sha")
    else:
        ids = durable(digests.patch_ids(files))
        copies = same_patch(rest, ids)
        twice = copies.select("sha")
        if parents is not None:
            own = ids.join(rest.select("sha"), "sha", "left_semi")
            twice = twice.join(re_lands(copies.select("sha", "patch_id"), own, parents), "sha", "left_anti")
    out = marked.select("sha", "own").join(undone, "sha", "left").join(twice.withColumn("d", F.lit(True)), "sha", "left")
    return out.select("sha", F.coalesce("own", F.when(F.col("r"), KINDS[3]).when(F.col("d"), KINDS[4])).alias("kind"))


def kind_counts(commits: DataFrame, commit_files: DataFrame, **evidence: DataFrame) -> DataFrame:
    """One row with a count for every kind, zeros kept, and ``real``."""
    k = F.col("kind")
    return kinds(commits, commit_files, **evidence).agg(*[F.count_if(k == n).alias(n) for n in KINDS], F.count_if(k.isNull()).alias("real"))


#: A full object name; what else a list of ignored revisions holds is a comment or an abbreviation.
OBJECT_NAME = r"^([0-9a-f]{40}|[0-9a-f]{64})$"


def ignored_revisions(lines: DataFrame, column: str = "value") -> DataFrame:
    """``sha``: the full object names of a list of revisions to skip, one a line, ``#`` begins a comment; letters in any case."""
    name = F.lower(F.trim(F.regexp_replace(F.regexp_replace(column, r"\r$", ""), "#.*$", "")))
    return lines.select(name.alias("sha")).where(F.col("sha").rlike(OBJECT_NAME)).distinct()
