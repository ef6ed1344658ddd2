"""A version-control log as a Spark data source: ``spark.read.format("gitlog")``.

One partition per repository and stretch of time, each running its own ``git log``; rows
stream out of the process as they are parsed.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "repository string, log_pos long, sha string, parents array<string>, time_s long, subject string, reverts string, path string, renamed_from string, "
    "removed boolean, created boolean, blob_old string, blob_new string, type_changed boolean, added long, deleted long"
)
_FORMAT = "%x01%H%x02%P%x02%ct%x02%s%x02%b%x03"


class LogError(RuntimeError):
    """git is missing, the folder is no repository, or the command failed."""


def run(args: list[str], folder: str) -> Iterator[bytes]:
    """Output of a git command in chunks; raises LogError if it fails."""
    try:
        process = subprocess.Popen(["git", "-C", folder, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except FileNotFoundError as error:
        raise LogError("git is not installed") from error
    while chunk := process.stdout.read(1 << 16):
        yield chunk
    message = process.stderr.read().decode(errors="replace")
    if process.wait():
        raise LogError(f"git {args[0]} in {folder}: {message.strip()}")


@dataclass
class Change:
    path: str
    renamed_from: str | None
    status: str
    old: str | None
    new: str | None
    type_changed: bool
    added: int = 0
    deleted: int = 0


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict, list[Change]]]:
    """Commits with their changes, from NUL-separated raw and numstat output read piece by piece."""
    import re

    commit: dict | None = None
    changes: dict[str, Change] = {}
    pending: list[str] = []  # tokens of an entry that is not complete
    rest = b""

    def tokens() -> Iterator[str]:
        nonlocal rest
        for chunk in chunks:
            rest += chunk
            *done, rest = rest.split(b"\0")
            yield from (d.decode("utf-8", "replace") for d in done)
        if rest:
            yield rest.decode("utf-8", "replace")

    for token in tokens():
        if "\x01" in token:
            before, _, after = token.rpartition("\x01")
            if commit is not None:
                yield commit, list(changes.values())
            head, _, token = after.partition("\x03")
            sha, parents, time, subject, body = head.split("\x02", 4)
            reverted = re.search(r"This reverts commit ([0-9a-f]{7,64})", body)
            commit = {"sha": sha, "parents": parents.split(), "time_s": int(time), "subject": subject, "reverts": reverted[1] if reverted else None}
            changes, pending = {}, []
        token = token.lstrip("\n")
        if not token and not pending:
            continue
        pending.append(token)
        first = pending[0]
        if first.startswith(":"):
            modes, status = first[1:].split(" ")[:4], first.rsplit(" ", 1)[1]
            need = 3 if status[0] in "RC" else 2
            if len(pending) == need:
                path, source = pending[-1], pending[1] if need == 3 else None
                blank = lambda blob: None if set(blob) == {"0"} else blob
                changes[path] = Change(path, source if status[0] == "R" else None, status[0], blank(modes[2]), blank(modes[3]), status[0] == "T")
                pending = []
        else:
            added, deleted, name = first.split("\t", 2)
            if name or len(pending) == 3:
                path = name or pending[2]
                if path in changes:
                    changes[path].added = 0 if added == "-" else int(added)
                    changes[path].deleted = 0 if deleted == "-" else int(deleted)
                pending = []
    if commit is not None:
        yield commit, list(changes.values())


@dataclass
class Stretch(InputPartition):
    repository: str
    since: str | None
    until: str | None


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repositories = [p for p in options.get("path", "").split(",") if p]
        self.merges = options.get("merges", "false").lower() == "true"
        self.edges = [e for e in options.get("boundaries", "").split(",") if e]

    def partitions(self) -> list[InputPartition]:
        ends = [None, *self.edges, None]
        return [Stretch(r, a, b) for r in self.repositories for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        args = ["log", "--merges" if self.merges else "--no-merges", "-M", "--raw", "--no-abbrev", "--numstat", "-z", f"--format={_FORMAT}"]
        args += [f"--since={partition.since}"] if partition.since else []
        args += [f"--until={partition.until}"] if partition.until else []
        for pos, (c, changes) in enumerate(parse(run(args, partition.repository))):
            head = (partition.repository, pos, c["sha"], c["parents"], c["time_s"], c["subject"], c["reverts"])
            for x in changes:
                yield (*head, x.path, x.renamed_from, x.status == "D", x.status == "A", x.old, x.new, x.type_changed, x.added, x.deleted)
            if not changes:
                yield (*head, None, None, False, False, None, None, False, 0, 0)


class GitLogSource(DataSource):
    """Options: path (repositories, comma-separated), merges (true for merge commits only), boundaries (dates between partitions)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(dict(self.options))


def read_log(spark: SparkSession, *repositories: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of repositories; a commit without files has a row in ``commits`` only."""
    from pyspark.sql import functions as F

    spark.dataSource.register(GitLogSource)
    rows = spark.read.format("gitlog").options(**options).option("path", ",".join(repositories)).load()
    files = rows.where(F.col("path").isNotNull()).select("sha", "path", "renamed_from", "removed", "created", "blob_old", "blob_new", "type_changed", "added", "deleted")
    unchanged = F.col("blob_old").eqNullSafe(F.col("blob_new")) & F.col("renamed_from").isNotNull()
    commits = rows.groupBy("repository", "sha").agg(
        F.min("time_s").alias("time_s"), F.min("subject").alias("subject"), F.min("reverts").alias("reverts"), F.min("log_pos").alias("log_pos"), F.min("parents").alias("parents"),
        F.coalesce(F.bool_and(F.when(F.col("path").isNotNull(), unchanged)), F.lit(False)).alias("move_only"),
    )
    return commits, files
