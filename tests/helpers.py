"""Small frames for tests."""

COMMITS = "sha string, time_s bigint, subject string, reverts string, move_only boolean, log_pos int, change_id bigint, recorded_at timestamp"
COMMIT_FILES = "sha string, path string, renamed_from string, removed boolean, created boolean, blob_old string, blob_new string, type_changed boolean, added bigint, deleted bigint"
CHANGES = "window_id string, slice int, change_id bigint, time_s bigint, subject_kind string, size int"
ITEMS = "change_id bigint, item string"
STATS = "path string, module string, test boolean, score double, revisions bigint, changes bigint, lines_added bigint, lines_deleted bigint, breadth bigint, loc bigint, complexity struct<total:bigint,mean:double,max:bigint>"
MANIFESTS = "manifest_id bigint, path string, body string, read_at timestamp"


def frame(spark, schema, rows, extra=True):
    """A frame with further columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    have = set(df.columns)
    if extra:
        for name in ("n", "id", "key", "a", "b", "__part", "shared", "value"):
            if name not in have:
                df = df.withColumn(name, F.lit("x"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def commit(sha, pos, time=0, subject=None, move=False, reverts=None):
    return (sha, time, subject, reverts, move, pos, None, None)


def touch(sha, path, renamed=None, removed=False, created=False, old=None, new=None, added=1, deleted=0):
    return (sha, path, renamed, removed, created, old, new, False, added, deleted)


def change(i, size, kind="other", slice=0, window="current"):
    return (window, slice, i, 0, kind, size)


def stat(path, module=".", test=False, score=0.5, revisions=1, changes=1, breadth=0, loc=1, complexity=1):
    return (path, module, test, score, revisions, changes, 0, 0, breadth, loc, None if complexity is None else (complexity, 0.0, 0))
