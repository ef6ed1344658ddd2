from collections import Counter
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tidemark.functions import windows
from tidemark.operators import groups, merges, patches
from tidemark.operators.coupling import area_pairs


def day(*a):
    return datetime(*a, tzinfo=UTC)


def test_windows():
    now = day(2026, 3, 31, 12)
    assert windows.window("1m", now).since == day(2026, 2, 28, 12)
    assert windows.window("1y", day(2024, 2, 29)).since == day(2023, 2, 28)
    assert windows.window("2w", now).since == day(2026, 3, 17, 12) and windows.window("2026-01-02", now).since == day(2026, 1, 2)
    current, previous = windows.comparison("3m", now)
    assert current.since == previous.until == day(2025, 12, 31, 12) and previous.since == day(2025, 9, 30, 12)
    for bad in ("", "0d", "12", "1h", "2026-02-30", "2027-01-01", "99999999y", "01d"):
        with pytest.raises(windows.InvalidWindow):
            windows.window(bad, now)
    assert windows.series_since(windows.window("1y", now), day(2020, 1, 1)) == day(2024, 3, 31, 12)
    assert windows.series_since(windows.window("1y", now), day(2025, 12, 1)) == day(2025, 12, 1)


def test_slices(spark):
    now = day(2026, 1, 1)
    assert windows.slices(windows.window("4m", now)) == [] and len(windows.slices(windows.window("10y", now))) == 12
    cut = windows.slices(windows.window("1y", now))
    assert len(cut) == 4 and cut[0].since == day(2025, 1, 1) and cut[-1].until == now and all(a.until == b.since for a, b in zip(cut, cut[1:], strict=False))
    times = [cut[0].seconds[0] - 1, cut[0].seconds[0], cut[1].seconds[0] - 1, cut[1].seconds[0], cut[3].seconds[1], None]
    df = spark.createDataFrame([(t,) for t in times], "t long").select(windows.slice_of(F.col("t"), cut).alias("s"))
    assert [r["s"] for r in df.collect()] == [None, 0, 0, 1, 3, None]
    steps = spark.createDataFrame([(-1.0,), (0.1,), (0.5,), (None,)], "x double").select(windows.step(F.col("x"), (0.0, 0.25, 0.5)).alias("s"))
    assert [r["s"] for r in steps.collect()] == [0, 1, 3, None]


def test_merge_attribution(spark):
    # main: m0 <- m1 (merge of f2, f1) <- m2 (merge of develop: d2 is a squash) <- m3 (git pull: p1)
    graph = {"m3": ["m2", "p1"], "m2": ["m1", "d2"], "m1": ["m0", "f2"], "m0": [], "f2": ["f1", "g1"], "f1": ["m0"], "g1": ["m0"], "d2": ["d1"], "d1": ["m0"], "p1": ["m0"]}
    subjects = {"m1": "Merge pull request #1 from a/feature", "m2": "Merge pull request #2 from a/topic", "m3": "Merge branch 'x'", "d2": "work (#7)"}
    assert merges.attribute(graph, "m3", {"m1": "branch", "m2": "branch"}, {"d2"}) == {"f2": "m1/1", "f1": "m1/1", "g1": "m1/1"}
    assert merges.attribute({"a": ["b"], "b": ["a"]}, "a", {}, set()) == {}
    order = list(graph)
    df = spark.createDataFrame([("r", s, graph[s], order.index(s), subjects.get(s)) for s in order], "repository string, sha string, parents array<string>, log_pos long, subject string")
    assert rows(merges.merged_commits(df.unionAll(df))) == [("f1", "m1/1"), ("f2", "m1/1"), ("g1", "m1/1")]
    assert merges.merged_commits(df.where("false")).count() == 0


def test_supported_parts():
    c = lambda *parts: Counter({frozenset(p): n for p, n in parts})
    assert groups.supported("abcde", c(("abcd", 2), ("abce", 1), ("de", 9))) == ([("a", "b", "c")], False)
    assert groups.supported("abcd", c(("abcd", 3), ("abc", 5))) == ([("a", "b", "c", "d")], False)
    assert groups.supported("abc", c()) == ([], False)
    many = Counter({frozenset(f"m{j}" for j in range(14) if i >> j & 1): 1 for i in range(1 << 14)})
    assert groups.supported([f"m{j}" for j in range(14)], many)[1] is True


def test_distinct_groups():
    everything = lambda a, b: True
    rows_ = [(("a", "b", "c", "d"), 5), (("a", "b", "c"), 9), (("a", "b", "c", "e"), 3), (("x", "y", "z"), 1)]
    assert groups.distinct(rows_, everything) == [(("a", "b", "c", "d"), 5), (("x", "y", "z"), 1)]
    unlinked = lambda a, b: {a, b} != {"d", "e"}
    assert [m for m, _ in groups.distinct(rows_, unlinked)] == [("a", "b", "c", "d"), ("a", "b", "c", "e"), ("x", "y", "z")]


def test_clique_groups(spark):
    baskets = [("a", "b", "c")] * 4 + [("a", "b"), ("b", "c"), ("a", "c")] * 3 + [("d", "e")] * 5
    touched = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "change_id long, area string")
    got = groups.clique_groups(touched, area_pairs(touched)).collect()
    assert [(r["members"], r["shared"], r["partial"]) for r in got] == [(["a", "b", "c"], 4, False)]


def test_maximal_parts_have_no_bound():
    import itertools
    import random

    dice = random.Random(5)
    for _ in range(200):
        names = [f"m{i}" for i in range(dice.randint(3, 8))]
        parts = Counter(frozenset(dice.sample(names, dice.randint(1, len(names)))) for _ in range(dice.randint(0, 25)))
        want, cut = groups.supported(names, parts)
        assert not cut and groups.maximal_parts(names, parts) == want
    # more parts than supported() takes: the pair of changes that it drops makes the third of one set
    names = [f"m{j:02}" for j in range(24)]
    wide = Counter({frozenset(names[:3]) | {names[3 + i % 20], names[4 + i // 20 % 20]}: 9 for i in range(400)})
    wide += Counter({frozenset([*names[20:24], n]): 1 for n in names[:3]}) + Counter({frozenset(c): 2 for c in itertools.combinations(names[3:20], 3)})
    assert groups.supported(names, wide)[1] is True and tuple(names[20:24]) in groups.maximal_parts(names, wide)


def test_cliques_of_many_components(spark):
    from tidemark.operators import graph

    n = 5001  # triangles, beyond 20 000 steps together
    links = spark.range(3 * n).selectExpr("concat(id div 3, substr('xxy', 1 + int(id % 3), 1)) as a", "concat(id div 3, substr('yzz', 1 + int(id % 3), 1)) as b", "5L as shared", "9L as changes_a", "8L as changes_b")
    found = graph.area_cliques(links).collect()
    assert len(found) == n and {(r["size"], r["partial"]) for r in found} == {(3, False)}


PATCH = """diff --git a/x.ts b/x.ts
index 1..2 100644
--- a/x.ts
+++ b/x.ts
@@ -1,2 +1,2 @@
 same
-old line
+new line
@@ -9 +9 @@
-  gone
diff --git a/img.png b/img.png
Binary files a/img.png and b/img.png differ
"""
UNDO = """diff --git a/x.ts b/x.ts
--- a/x.ts
+++ b/x.ts
@@ -5,2 +5,2 @@
 other context
-new line
+old line
@@ -20 +20 @@
+  gone
"""
BLANK = "diff --git a/y.py b/y.py\n@@ -1 +1 @@\n-if a:b\n+if a:   b\n"


def test_patches(spark):
    there, back = patches.digest(PATCH), patches.digest(UNDO)
    assert [f[0] for f in there] == ["x.ts", "img.png"] and [f[3] for f in there] == [True, False]
    assert there[0][1] == back[0][2] and there[0][2] == back[0][1] and there[0][1] != there[0][2]
    assert patches.digest(None) == patches.digest("") == [] and patches.digest(BLANK)[0][4] is True
    only = PATCH.split("diff --git a/img")[0]
    df = spark.createDataFrame([("o", only), ("u", UNDO), ("o2", only), ("b", BLANK), ("n", None), ("bin", PATCH)], "sha string, patch string")
    files = patches.patch_files(df)
    assert rows(patches.whitespace_only(files)) == [("b",)]
    assert rows(patches.whitespace_only(files, spark.createDataFrame([("y.py",)], "path string"))) == []
    pairs = spark.createDataFrame([("u", "o"), ("b", "o"), ("u", "bin")], "revert string, original string")
    assert rows(patches.undone_by_patch(pairs, files)) == [("u", "o")]
    ids = dict(rows(patches.patch_ids(files)))
    assert ids["o"] == ids["o2"] is not None and ids["u"] not in (None, ids["o"]) and ids["bin"] is None
