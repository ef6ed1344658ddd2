"""Digests of patches: what a commit does to each file, and what would undo it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FILE = re.compile(r"^diff --git (?:\"?a/(.*?)\"?) (?:\"?b/(.*?)\"?)$")


def _hash(lines: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b"\n".join(lines), digest_size=8).digest(), "big", signed=True)


def digest(patch: str | None) -> list[tuple[str, int, int, bool, bool]]:
    """(path, forward, reverse, comparable, blank) of each file of a patch text.

    forward and reverse hash the hunks' removed and added lines, so that one patch undoes
    another if its forward hash is the other's reverse. Places and context do not count, nor
    does white space at line ends. A binary or mode-only change is not comparable. blank:
    removed and added lines are equal but for white space.
    """
    out: list[tuple[str, int, int, bool, bool]] = []
    path: str | None = None
    there: list[bytes] = []
    back: list[bytes] = []
    removed: list[str] = []
    added: list[str] = []
    gone: list[str] = []
    come: list[str] = []

    def hunk() -> None:
        nonlocal removed, added
        if removed or added:
            minus, plus = [("-" + x).encode() for x in removed], [("+" + x).encode() for x in added]
            there.extend([b"@", *minus, *plus])
            back.extend([b"@", *(b"-" + x[1:] for x in plus), *(b"+" + x[1:] for x in minus)])
            gone.extend(removed)
            come.extend(added)
        removed, added = [], []

    def close() -> None:
        hunk()
        if path is not None:
            squeeze = lambda lines: "".join("".join(lines).split())
            out.append((path, _hash(there), _hash(back), bool(there), bool(there) and squeeze(gone) == squeeze(come)))
        there.clear()
        back.clear()
        gone.clear()
        come.clear()

    inside = False
    for line in (patch or "").split("\n"):
        if m := _FILE.match(line):
            close()
            path, inside = m[2], False
        elif line.startswith("@@"):
            hunk()
            inside = True
        elif inside and line[:1] == "-":
            if added:  # removed lines after added ones begin another stretch
                hunk()
            removed.append(line[1:].rstrip())
        elif inside and line[:1] == "+":
            added.append(line[1:].rstrip())
        elif inside and not line.startswith("\\"):
            hunk()
    close()
    return out


def patch_files(patches: DataFrame) -> DataFrame:
    """``sha, path, forward, reverse, comparable, blank``: a row per file of each patch (sha, patch); null patches give none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(sha, *f) for sha, patch in zip(batch.column("sha").to_pylist(), batch.column("patch").to_pylist(), strict=True) for f in digest(patch)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["sha", "path", "forward", "reverse", "comparable", "blank"])

    return patches.select("sha", "patch").distinct().mapInArrow(run, "sha string, path string, forward long, reverse long, comparable boolean, blank boolean")


def whitespace_only(files: DataFrame, indented: DataFrame | None = None) -> DataFrame:
    """``sha``: commits all of whose files change in white space only; ``indented`` (path) names files where that matters."""
    rows = files
    if indented is not None:
        rows = rows.join(indented.select("path", F.lit(True).alias("matters")).distinct(), "path", "left").withColumn("blank", F.col("blank") & F.col("matters").isNull())
    return rows.groupBy("sha").agg(F.bool_and("blank").alias("all")).where("all").select("sha")


def undone_by_patch(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """``revert, original``: pairs whose patches undo each other, file by file; a file that cannot be compared confirms nothing."""
    mine = pairs.join(files.select(F.col("sha").alias("revert"), "path", F.col("forward").alias("f"), F.col("comparable").alias("x")), "revert")
    theirs = pairs.join(files.select(F.col("sha").alias("original"), "path", F.col("reverse").alias("r"), F.col("comparable").alias("y")), "original")
    both = mine.join(theirs, ["revert", "original", "path"], "full")
    same = F.coalesce(F.col("x") & F.col("y") & (F.col("f") == F.col("r")), F.lit(False))
    return both.groupBy("revert", "original").agg(F.bool_and(same).alias("ok")).where("ok").select("revert", "original")


def patch_ids(files: DataFrame) -> DataFrame:
    """``sha, patch_id``: one id for all of a commit's files, whatever their order; null if one cannot be compared."""
    each = F.xxhash64("path", "forward")
    out = files.groupBy("sha").agg(F.bool_and("comparable").alias("ok"), F.bit_xor(each).alias("x"), F.count(F.lit(1)).alias("n"))
    return out.select("sha", F.when(F.col("ok"), F.xxhash64("x", "n")).alias("patch_id"))
