"""What must hold of the plans, whatever the size of the tables."""

import pytest
from pyspark.sql import functions as F

from helpers import CHANGES, COMMIT_FILES, COMMITS, ITEMS, STATS, change, commit, frame, rows, stat, touch
from tidemark.operators import coupling, entries, hotspots, lineage, modules, trends, views
from tidemark.operators.history import History
from tidemark.operators.skew import salted_join


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def history(spark):
    changes = frame(spark, CHANGES, [change(i, 2, "fix" if i % 2 else "other", i % 3) for i in range(12)], extra=False)
    items = frame(spark, ITEMS, [(i, p) for i in range(12) for p in ("x/a.ts", f"y/b{i % 2}.ts")], extra=False)
    stats = frame(spark, STATS, [stat("x/a.ts", "x"), stat("y/b0.ts", "y"), stat("y/b1.ts", "y")], extra=False)
    return History(changes, items, stats)


def _files(spark, history, folder):
    """The same history read from files, of whose size Spark has an estimate."""
    for name in ("changes", "change_items", "items"):
        getattr(history, name).write.parquet(f"{folder}/{name}")
    return History(*[spark.read.parquet(f"{folder}/{name}") for name in ("changes", "change_items", "items")])


def test_copies_of_a_salted_side_are_not_broadcast(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/right")
    left = spark.range(3000).select((F.col("id") % 1500).alias("k"), F.col("id").alias("s"))
    for how, n in (("inner", 2000), ("left", 3000)):
        joined = salted_join(left, spark.read.parquet(f"{tmp_path}/right"), "k", "s", how)
        assert "Broadcast" not in _plan(joined)
        assert joined.count() == n and joined.where("v <> k").count() == 0


@pytest.mark.parametrize("query", ["used", "touched", "fixes", "slices", "couplings"])
def test_sides_with_a_row_per_change_or_file_are_not_broadcast(spark, history, tmp_path, query):
    make = {"used": History.used, "touched": History.touched, "fixes": modules.fix_density, "slices": trends.slice_measures, "couplings": coupling.couplings}[query]
    read = _files(spark, history, str(tmp_path))
    plan = _plan(make(read)).split("Subquery")[0]
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [change_id" in line or "BroadcastHashJoin [item" in line or "BroadcastHashJoin [a#" in line or "BroadcastHashJoin [b#" in line]
    assert rows(make(read)) == rows(make(history))


@pytest.mark.parametrize("query", ["along", "direction"])
def test_import_edges_and_their_owners_are_not_broadcast(spark, history, tmp_path, monkeypatch, query):
    read = _files(spark, history, str(tmp_path))
    spark.createDataFrame([("x/a.ts", "y/b0.ts")], "src string, dst string").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    make = {"along": modules.changed_along, "direction": lambda h, e: modules.dependency_direction(h, e, volatility=0)}[query]
    expected = rows(make(history, edges))
    assert expected
    monkeypatch.setattr(modules, "durable", lambda df: df, raising=True)
    plan = _plan(make(read, edges)).split("Subquery")[0]
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [src" in line or "BroadcastHashJoin [dst" in line or "BroadcastHashJoin [a#" in line]
    assert rows(make(read, edges)) == expected


def test_heat_of_files_is_not_broadcast_to_findings(spark, history, tmp_path):
    plan = _plan(entries.hidden_couplings(_files(spark, history, str(tmp_path)))).split("Subquery")[0]
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [a#" in line or "BroadcastHashJoin [b#" in line]


@pytest.mark.parametrize("query", ["weak", "verdict"])
def test_a_judgement_of_areas_makes_what_changes_touched_once(spark, history, monkeypatch, query):
    made, touched = [], History.touched
    monkeypatch.setattr(History, "touched", lambda self: made.append(1) or touched(self))
    result = {"weak": views.weak_structure, "verdict": modules.verdict}[query](history)
    assert made == [1]
    assert rows(result) is not None


def test_a_history_keeps_the_named_results_only(history):
    kept = history.keeping("touched_areas")
    areas = kept.touched_areas()
    assert areas is kept.touched_areas() and set(kept.kept) == {"touched_areas"}
    assert rows(areas) == rows(history.touched_areas())


def test_every_unstable_interface_is_a_candidate(spark):
    hubs, importers = range(55), range(5)
    held = [(6 * h + i, f"h/hub{h}.ts") for h in hubs for i in range(6)] + [(6 * h, f"u/use{h}_0.ts") for h in hubs]
    changes = frame(spark, CHANGES, [change(i, 2) for i in range(6 * len(hubs))], extra=False)
    stats = frame(spark, STATS, [stat(f"u/use{h}_{i}.ts", "u") for h in hubs for i in importers], extra=False)
    edges = spark.createDataFrame([(f"u/use{h}_{i}.ts", f"h/hub{h}.ts") for h in hubs for i in importers], "src string, dst string")
    found = entries.hub_findings(History(changes, frame(spark, ITEMS, held, extra=False), stats), edges)
    assert {r["subject"] for r in found.collect() if r["score"] > 0} == {f"h/hub{h}.ts" for h in hubs}


@pytest.mark.parametrize("listed", [0, 2, 64])
def test_only_events_are_settled_and_rows_are_not_written_for_it(spark, monkeypatch, listed):
    # newest first: hot is deleted, recreated, and renamed to new; calm has no event
    cm = [commit(f"c{i}", i, 100 - i) for i in range(10)]
    cf = [touch("c1", "new", renamed="hot"), touch("c3", "hot", created=True, new="y"), touch("c5", "hot", removed=True, old="x"), *[touch(f"c{i}", "hot") for i in (2, 4, 6, 7, 8, 9)], *[touch(f"c{i}", "calm") for i in range(10)], touch("c5", "hot")]
    written, durable = [], lineage.durable
    monkeypatch.setattr(lineage, "durable", lambda df: written.append(durable(df)) or written[-1])
    got = {(r["sha"], r["path"]): (r["today"], r["earlier"]) for r in lineage.lives(frame(spark, COMMIT_FILES, cf), frame(spark, COMMITS, cm), listed=listed).collect()}
    assert {k: got[k, "hot"] for k in ("c2", "c3", "c4", "c5", "c9")} == {"c2": ("new", False), "c3": ("new", False), "c4": ("new", False), "c5": ("new", True), "c9": ("new", True)}
    assert len(got) == 19 and all(got[f"c{i}", "calm"] == ("calm", False) for i in range(10))
    assert not [df for df in written if "path" in df.columns and df.where("path = 'calm'").count()]


def test_activity_of_lives_shuffles_a_row_once_by_its_commit(spark):
    cf = frame(spark, COMMIT_FILES, [touch("a", "p", added=3), touch("a", "p", added=3), touch("a", "p", added=4), touch("a", "q", added=5), touch("b", "p"), touch("c", "p"), touch("d", "gone")], extra=False)
    cm = frame(spark, COMMITS, [commit(c, i) for i, c in enumerate("abcd")], extra=False)
    kinds = spark.createDataFrame([("a", None), ("b", None), ("c", "moves"), ("d", None)], "sha string, kind string")
    lives = spark.createDataFrame([("a", "p", "new", False), ("a", "q", "new", False), ("b", "p", "p", True), ("c", "p", "new", False), ("d", "gone", "gone", False)], "sha string, path string, today string, earlier boolean")
    h = History(frame(spark, CHANGES, [change(1, 1)], extra=False), frame(spark, ITEMS, [(1, "new")], extra=False))
    got = hotspots.item_activity(cf, cm, h, kinds, lives)
    assert rows(got) == [("gone", 1, 1, 0, 0), ("new", 1, 12, 0, 1)]
    plan = _plan(got)
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning(sha#" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(" in line and "sha#" in line and "path#" in line]
