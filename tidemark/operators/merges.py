"""Which pull request merge brought a commit in."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.subjects import is_squashed, merge_kind

#: Commits of one repository's graph at most; its walk is sequential and needs the graph in one task's memory.
MAX_COMMITS = 20_000_000


def attribute(parents: Mapping[str, Sequence[str]], tip: str, merges: Mapping[str, str], squashed: frozenset[str] | set[str]) -> dict[str, str]:
    """Commit to ``merge/parent number`` for each commit that a merge of a feature branch brought in.

    The first-parent line of ``tip`` is the mainline. Its merges are taken oldest first; a
    branch claims the commits along its first parents down to the mainline or to what is
    claimed, then the branches merged into it follow in turn, oldest merge first. An
    integration branch (by the merge's kind, or as it holds pull request merges or squashed ones
    itself) gives its own commits to no merge. A merge that names no pull request hands its
    branch to the owner of the branch it is on.
    """
    mainline: dict[str, None] = {}
    at: str | None = tip
    while at is not None and at not in mainline:
        mainline[at] = None
        at = next(iter(parents.get(at, ())), None)
    owner_of: dict[str, str] = {}
    claimed = set(mainline)
    for merge in reversed(mainline):
        branches = deque((p, f"{merge}/{i}" if merge in merges else None, merges.get(merge)) for i, p in enumerate(parents.get(merge, ())[1:], 1))
        while branches:
            at, owner, kind = branches.popleft()
            own: list[str] = []
            while at is not None and at in parents and at not in claimed:
                claimed.add(at)
                own.append(at)
                at = next(iter(parents[at]), None)
            if kind == "integration" or any(c in merges or c in squashed for c in own):
                owner = None
            if owner is not None:
                owner_of.update(dict.fromkeys(own, owner))
            for c in reversed(own):
                branches.extend((p, f"{c}/{i}" if c in merges else owner, merges.get(c)) for i, p in enumerate(parents[c][1:], 1))
    return owner_of


def merged_commits(graph: DataFrame) -> DataFrame:
    """``sha, merge``: commits with the pull request merge that brought them in.

    ``graph``: repository, sha, parents (first parent first), log_pos (0 the tip), subject, of
    all commits, merges included. Each repository's graph is walked in one task, as the walk is
    sequential; more than MAX_COMMITS commits are an error.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > MAX_COMMITS:
            raise ValueError(f"a graph of more than {MAX_COMMITS} commits")
        rows = rows.sort_values(["log_pos", "sha"])
        parents = {s: tuple(p) if p is not None else () for s, p in zip(rows["sha"], rows["parents"], strict=True)}
        merges = {s: k for s, k in zip(rows["sha"], rows["kind"], strict=True) if isinstance(k, str) and len(parents[s]) > 1}
        squashed = {s for s, q in zip(rows["sha"], rows["squashed"], strict=True) if q and len(parents[s]) < 2}
        found = attribute(parents, rows["sha"].iloc[0], merges, squashed)
        return pd.DataFrame({"sha": list(found), "merge": list(found.values())}, dtype=object)

    rows = graph.where(F.col("sha").isNotNull()).select("repository", "sha", "parents", "log_pos", merge_kind(F.col("subject")).alias("kind"), F.coalesce(is_squashed(F.col("subject")), F.lit(False)).alias("squashed"))
    return rows.dropDuplicates(["repository", "sha"]).groupBy("repository").applyInPandas(walk, "sha string, merge string")
