"""Which file of today a change belongs to: renames carry history on, deletions end lives.

A name's history is cut by three kinds of events: a file was given the name (a birth), left it
by a rename, or was deleted under it. What they say is settled among the events alone, which are
few: renames point to newer renames, and deadness spreads from the deletions that ended a life to
the events that depend on them. Only then every other row looks up the nearest newer events of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.operators.heavy import last_before
from tidemark.operators.mechanical import FEW, commit_rows
from tidemark.operators.skew import salted_join, shuffled
from tidemark.session import durable

#: Object ids of empty content; two empty files are not the same file.
EMPTY_BLOBS = (
    "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391",
    "473a0f4c3be8a93681a267e3b1e9a7dcda1185436fe141f7749120a303721813",
)


#: The events of a name go along with its rows as a list up to this many.
LISTED = 64


def _cut() -> Column:
    """Whether a row of ``commit_files`` shows an event."""
    return F.coalesce("removed", F.lit(False)) | F.coalesce("created", F.lit(False)) | F.col("renamed_from").isNotNull()


def _events(commit_files: DataFrame, log: DataFrame) -> DataFrame:
    """``sha, path, renamed_from, removed, created, blob, row, log_pos`` of each distinct (sha, path) that shows an event and whose commit is known."""
    marked = commit_files.where(_cut())
    # a repeated row that shows none still counts for the blob
    rest = commit_files.where(~_cut()).withColumn("row", F.xxhash64("sha", "path"))
    again = durable(rest.select("row").join(shuffled(marked.select(F.xxhash64("sha", "path").alias("row")).distinct()), "row", "left_semi").distinct())
    again = rest.join(F.broadcast(again) if again.limit(FEW + 1).count() <= FEW else shuffled(again), "row", "left_semi")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    each = marked.withColumn("row", F.xxhash64("sha", "path")).unionByName(again).groupBy("sha", "path").agg(F.max("renamed_from").alias("renamed_from"), flag("removed"), flag("created"), F.max(F.coalesce("blob_new", "blob_old")).alias("blob"), F.max("row").alias("row"))
    return each.where(_cut()).join(shuffled(log), "sha")


def _at(entries: DataFrame, column: str) -> DataFrame:
    """``name, log_pos, own (null), column``: what is known of a name at each commit: the entry of the largest ``weight``."""
    return entries.groupBy("name", "log_pos").agg(F.max_by(column, "weight").alias(column))


def _uncut(commit_files: DataFrame, log: DataFrame) -> DataFrame:
    """``sha, name, log_pos`` of each distinct (sha, path) that shows no event and whose commit is known."""
    # dealt out by sha, so that neither the distinct rows nor the join with the log are shuffled again
    rows = commit_files.select("sha", "path", _cut().alias("cut")).repartition("sha").groupBy("sha", "path").agg(F.bool_or("cut").alias("cut")).where(~F.col("cut"))
    return rows.join(shuffled(log), "sha").select("sha", F.col("path").alias("name"), "log_pos")


def _known(rows: DataFrame) -> DataFrame:
    """``name, log_pos, event, leave``: what happened to a name at each commit: the event that counts, and a rename away.

    An event is known by the row that shows it and by what it does to the name.
    Where one commit does several things to a name, a rename away counts before an end, and that before a birth.
    """
    shows = lambda does: F.struct("row", F.lit(does).alias("does"))
    born = F.col("created") | F.col("renamed_from").isNotNull()
    own = rows.where(F.col("removed") | born).select(F.col("path").alias("name"), "log_pos", F.when(F.col("removed"), shows("end")).otherwise(shows("birth")).alias("event"), F.when(F.col("removed"), 1).otherwise(0).alias("weight"), F.lit(None).cast("bigint").alias("leave"))
    away = rows.where(F.col("renamed_from").isNotNull()).select(F.col("renamed_from").alias("name"), "log_pos", shows("leave").alias("event"), F.lit(2).alias("weight"), F.col("row").alias("leave"))
    return own.unionByName(away).groupBy("name", "log_pos").agg(F.max_by("event", F.struct("weight", "event")).alias("event"), F.max("leave").alias("leave"))


def _surroundings(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the nearest newer events of their path: ``event`` (of any kind) and ``leave`` (a rename away). Smaller ``log_pos`` is newer."""
    asked = rows.select(F.col("path").alias("name"), "log_pos", F.struct(*rows.columns).alias("own"))
    looked = last_before(asked.unionByName(known, allowMissingColumns=True), "name", "log_pos", ["event", "leave"]).where(F.col("own").isNotNull())
    return looked.select("own.*", F.col("before_event").alias("event"), F.col("before_leave").alias("leave"))


def _todays(renames: DataFrame) -> DataFrame:
    """``leave, today``: where the file that left a name is today. Each rename points to the newer one by which its file went on;
    pointers double until all have reached the end."""
    now = durable(renames.select(F.col("row").alias("leave"), F.col("leave").alias("next"), F.col("path").alias("today")))
    while not now.where(F.col("next").isNotNull()).isEmpty():
        far = now.select(F.col("leave").alias("next"), F.col("next").alias("after"), F.col("today").alias("then"))
        now = durable(now.join(far, "next", "left").select("leave", F.col("after").alias("next"), F.coalesce("then", "today").alias("today")))
    return now.select("leave", "today")


def _spread(ends: DataFrame, hands: DataFrame) -> DataFrame:
    """``row, does``: the events before (older than) which a name's file belongs to an earlier life, from the deletions that end one.

    Other deletions and renames away hand on what is known where they stand, each from one newer event; a birth
    begins anew. Pointers to those events double until all have met an end or a beginning.
    """
    at = F.xxhash64("from", "by")
    now = hands.join(ends.select("row", F.lit(True).alias("gone")), "row", "left").select("row", "does", F.xxhash64("row", "does").alias("id"), (F.coalesce("gone", F.lit(False)) & (F.col("does") == "end")).alias("gone"), at.alias("next"))
    now = durable(now.withColumn("next", F.when(~F.col("gone"), F.col("next"))))
    while not now.where(F.col("next").isNotNull()).isEmpty():
        far = now.select(F.col("id").alias("next"), F.col("gone").alias("then"), F.col("next").alias("after"))
        step = now.join(far, "next", "left").select("row", "does", "id", (F.col("gone") | F.coalesce("then", F.lit(False))).alias("gone"), F.col("after").alias("next"))
        now = durable(step.withColumn("next", F.when(~F.col("gone"), F.col("next"))))
    return now.where("gone").select("row", "does")


def _ended(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row`` of the deletions that end a life, and ``row, does`` of the events before which the name's file is of an earlier life.

    A deletion ends a life if a newer birth gave the name to a file that does not start with the
    content deleted, or is itself of an earlier life, and nothing between has used that birth up: a
    deletion that ended a life, or a file of an earlier life that left the name. What is used up
    depends on newer events only, so the rounds settle from the newest on.
    """
    born = F.col("created") | F.col("renamed_from").isNotNull()
    births = durable(events.where(born).select(F.col("path").alias("name"), "log_pos", F.struct(F.lit(True).alias("free"), F.when(F.col("created"), F.col("blob")).alias("blob"), F.col("event.row").alias("from"), F.col("event.does").alias("by")).alias("taken"), F.lit(0).alias("weight")))
    deletions = durable(events.where("removed").select(F.col("path").alias("name"), "log_pos", F.struct("row", "blob").alias("own")))
    leaves = events.where(F.col("renamed_from").isNotNull()).select("row", F.lit("leave").alias("does"), F.col("renamed_from").alias("name"), "log_pos")
    at = F.col("event.row").alias("from"), F.col("event.does").alias("by")
    hands = durable(events.where(F.col("event").isNotNull()).select("row", F.explode(F.array_compact(F.array(F.when(F.col("removed"), "end"), F.when(F.col("renamed_from").isNotNull(), "leave")))).alias("does"), *at))
    used = F.struct(F.lit(False).alias("free"), F.lit(None).cast("string").alias("blob"), F.lit(None).cast("bigint").alias("from"), F.lit(None).cast("string").alias("by"))
    spent, dead, before = None, None, None
    while True:
        entries = births if spent is None else births.unionByName(spent)
        looked = last_before(deletions.unionByName(_at(entries, "taken"), allowMissingColumns=True), "name", "log_pos", ["taken"]).where(F.col("own").isNotNull() & F.col("before_taken.free"))
        t = F.col("before_taken")
        same = F.coalesce((t["blob"] == F.col("own.blob")) & ~t["blob"].isin(*EMPTY_BLOBS), F.lit(False))
        rows = looked.select("own.row", "name", "log_pos", t["from"].alias("from"), t["by"].alias("by"), same.alias("same"))
        if dead is None:
            ends = rows.where("not same")
        else:
            gone = dead.select(F.col("row").alias("from"), F.col("does").alias("by"), F.lit(True).alias("gone"))
            ends = rows.join(gone, ["from", "by"], "left").where("not same or gone")
        ends = durable(ends.select("row", "name", "log_pos"))
        state = ends.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("row"))).first()
        dead = _spread(ends, hands)
        whole = (*state, *dead.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("row", "does"))).first())
        if whole == before:
            return ends.select("row"), dead
        before = whole
        spent = ends.select("name", "log_pos", used.alias("taken"), F.lit(1).alias("weight")).unionByName(leaves.join(dead, ["row", "does"], "left_semi").select("name", "log_pos", used.alias("taken"), F.lit(1).alias("weight")))


def _by_list(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``sha, path, today, earlier`` of rows (sha, name, log_pos) by the nearest newer of the known events (name, log_pos, gone, named) of their name, which go along as a list."""
    lists = known.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.col("log_pos").alias("at"), "gone", "named"))).alias("events"))
    asked = salted_join(rows, lists, "name", "sha", "left", salts=8)
    newer = F.filter("events", lambda e: e["at"].isNull() | F.coalesce(e["at"] < F.col("log_pos"), F.lit(False)))
    last = lambda events: F.try_element_at(events, F.lit(-1))
    return asked.withColumn("events", newer).select("sha", F.col("name").alias("path"), F.coalesce(last(F.filter("events", lambda e: e["named"].isNotNull()))["named"], "name").alias("today"), F.coalesce(last(F.col("events"))["gone"], F.lit(False)).alias("earlier"))


def _by_range(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same over range partitions, where a name may have any number of events."""
    far = last_before(rows.unionByName(known, allowMissingColumns=True), "name", "log_pos", ["gone", "named"]).where(F.col("sha").isNotNull())
    return far.select("sha", F.col("name").alias("path"), F.coalesce("before_named", "name").alias("today"), F.coalesce("before_gone", F.lit(False)).alias("earlier"))


def lives(commit_files: DataFrame, commits: DataFrame, listed: int = LISTED) -> DataFrame:
    """``sha, path, today, earlier``: each distinct (sha, path) with the path its file has today.

    ``earlier``: the change belongs to a file that was deleted later, its name given to another:
    the deletion itself and all older changes of that file, back to its birth. A deletion
    without a newer file of the name ends nothing, nor does one that a newer addition of the same (not empty) content
    undoes. Smaller ``log_pos`` is newer; the rows of one commit are all read against newer commits. Rows whose
    commit is not in ``commits`` are left out. A name may hold any share of the rows and of the events (``listed`` only says how they are looked up).
    """
    commit_files = commit_files.where(F.col("sha").isNotNull() & F.col("path").isNotNull())
    log = commit_rows(commits.select("sha", "log_pos", "recorded_at")).select("sha", "log_pos")
    events = durable(_events(commit_files, log))
    known = durable(_known(events))
    events = durable(_surroundings(events, known))
    today = _todays(events.where(F.col("renamed_from").isNotNull()))
    ends, dead = _ended(events)
    at = F.when(F.col("event").isNotNull(), F.xxhash64("event.row", "event.does")).alias("at")
    told = lambda rows: rows.join(shuffled(dead.select(F.xxhash64("row", "does").alias("at"), F.lit(True).alias("gone"))), "at", "left").join(shuffled(today.withColumnRenamed("today", "named")), "leave", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    known = durable(told(known.select("name", "log_pos", at, "leave")).select("name", "log_pos", "gone", "named"))
    own = told(events.select("sha", "path", "row", "leave", at)).join(shuffled(ends.withColumn("ends", F.lit(True))), "row", "left")
    own = own.select("sha", "path", F.coalesce("named", "path").alias("today"), (F.coalesce("ends", F.lit(False)) | F.col("gone")).alias("earlier"))
    many = durable(known.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > listed).select("name"))
    n = many.limit(FEW + 1).count()
    if not n:
        return own.unionByName(_by_list(_uncut(commit_files, log), known))
    many = F.broadcast(many) if n <= FEW else shuffled(many)
    of = lambda how: (_uncut(commit_files.join(many.withColumnRenamed("name", "path"), "path", how), log), known.join(many, "name", how))
    return own.unionByName(_by_list(*of("left_anti"))).unionByName(_by_range(*of("left_semi")))


def renamed_names(commit_files: DataFrame) -> DataFrame:
    """``name, family``: names that renames connect, with the smallest name of their family."""
    edges = commit_files.where(F.col("renamed_from").isNotNull() & F.col("path").isNotNull()).select(F.col("renamed_from").alias("a"), F.col("path").alias("b"))
    return components(edges).select(F.col("node").alias("name"), F.col("component").alias("family"))
