import datetime
import subprocess

import pytest

from helpers import rows
from tidemark.sources.gitlog import LogError, read_log, run
from tidemark.streaming import activity


@pytest.fixture
def repository(tmp_path):
    env = {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin"}
    folder = tmp_path / "r"
    folder.mkdir()
    git = lambda *a: subprocess.run(["git", *a], cwd=folder, env=env, check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for i, (name, text, message) in enumerate([("a b.ts", "one\n" * 9, "feat: first (#1)"), ("ü.ts", "x\ny\n", "second"), ("bin", "\x00\x01", "third")]):
        env |= {"GIT_AUTHOR_DATE": f"2026-01-0{i + 1}T00:00:00Z", "GIT_COMMITTER_DATE": f"2026-01-0{i + 1}T00:00:00Z"}
        (folder / name).write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", message)
    git("mv", "a b.ts", "c.ts")
    git("commit", "-q", "-m", "move")
    git("commit", "-q", "--allow-empty", "-m", "nothing")
    git("revert", "--no-edit", "HEAD~2")
    return str(folder)


def test_log_source(spark, repository):
    commits, files = read_log(spark, repository)
    got = {r["subject"]: r for r in commits.collect()}
    assert list(sorted(got)) == sorted(["feat: first (#1)", "second", "third", "move", "nothing", 'Revert "third"'])
    assert got["move"]["move_only"] and not got["second"]["move_only"] and not got["nothing"]["move_only"]
    assert got['Revert "third"']["reverts"] == got["third"]["sha"] and got['Revert "third"']["log_pos"] == 0
    f = {(r["path"], r["renamed_from"], r["removed"], r["created"]): (r["added"], r["deleted"]) for r in files.collect()}
    assert f == {("a b.ts", None, False, True): (9, 0), ("ü.ts", None, False, True): (2, 0), ("bin", None, False, True): (0, 0), ("c.ts", "a b.ts", False, False): (0, 0), ("bin", None, True, False): (0, 0)}


def test_log_source_fails_clearly(tmp_path):
    with pytest.raises(LogError):
        list(run(["log"], str(tmp_path)))


def test_stream_equals_batch(spark, sf):
    from pyspark.sql import functions as F

    stream = activity.table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = activity.drain(activity.windowed_activity(stream, "ts", "event_type"), mode="complete")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    assert out.agg(F.sum("events")).first()[0] == batch.count()


def test_anchored_runs_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    data = [("k", at(s)) for s in (1, 5, 20, 22, 900)] + [("other", at(3)), ("other", at(2000))]
    spark.createDataFrame(data, "key string, ts timestamp").write.parquet(str(tmp_path / "runs.parquet"))
    stream = activity.table_stream(spark, str(tmp_path), "runs")
    out = activity.drain(activity.anchored_runs(stream, "ts", "key", 14), str(tmp_path / "out"))
    got = [(r["key"], r["events"]) for r in out.collect()]
    assert ("k", 2) in got and got.count(("k", 2)) == 2 and ("other", 1) in got
