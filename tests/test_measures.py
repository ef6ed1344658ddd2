from pyspark.sql import functions as F

from helpers import CHANGES, COMMIT_FILES, COMMITS, ITEMS, STATS, change, commit, frame, rows, stat, touch
from tidemark.functions import paths, subjects
from tidemark.functions.numbers import rounded
from tidemark.operators import coupling, graph, grouping, hotspots, lineage, mechanical, modules, textual, trends
from tidemark.operators.history import History


def history(spark, baskets, stats=(), sizes=None):
    ch = [change(i, (sizes or {}).get(i, len(set(b)))) for i, b in enumerate(baskets)]
    ci = [(i, p) for i, b in enumerate(baskets) for p in b]
    return History(frame(spark, CHANGES, ch), frame(spark, ITEMS, ci), frame(spark, STATS, list(stats)))


def test_thresholds_are_kept_at_their_edges(spark):
    # 3 shared of 10 and 10: degree 0.3 exactly; two shared are too few
    baskets = [["a", "b"]] * 3 + [["a"]] * 7 + [["b"]] * 7 + [["c", "d"]] * 2
    got = {(r["a"], r["b"]): r["degree"] for r in coupling.couplings(history(spark, baskets)).collect()}
    assert got == {("a", "b"): 0.3}


def test_fifty_files_count_and_fifty_one_do_not(spark):
    h = history(spark, [["a", "b"]] * 3 + [["c", "d"]] * 3, sizes={3: 51, 4: 51, 5: 51, 0: 50})
    assert [r["a"] for r in coupling.couplings(h).collect()] == ["a"]
    assert h.counted().count() == 3


def test_empty_history(spark):
    h = history(spark, [])
    for operator in (coupling.couplings, coupling.breadth, coupling.partners, coupling.ubiquitous, coupling.module_couplings, modules.cohesion, modules.area_radius, hotspots.hotspots, hotspots.hot_items, hotspots.heat_kinds, trends.erosion, trends.area_lines, trends.repository_erosion, hotspots.territory_heat):
        assert operator(h).count() == 0, operator
    assert modules.change_radius(h).collect()[0]["measured"] == 0
    assert modules.propagation_cost(h).collect()[0]["cost"] is None
    assert modules.verdict(h).collect()[0]["level"] == "unknown"


def test_cohesion_and_partners(spark):
    stats = [stat("m/a", "m"), stat("m/b", "m"), stat("n/c", "n")]
    h = history(spark, [["m/a", "m/b"], ["m/a", "n/c"], ["n/c"], ["m/a", "n/c"], ["m/b", "n/c"]], stats)
    got = {r["area"]: (r["changes"], r["local"], r["cohesion"]) for r in modules.cohesion(h).collect()}
    assert got == {"m": (4, 1, 0.25), "n": (4, 1, 0.25)}
    assert rows(coupling.strongest_partner(h.touched())) == [("m", "n", 3), ("n", "m", 3)]


def test_rounding_goes_up_at_ties(spark):
    df = spark.createDataFrame([(-0.00005,), (0.00005,), (0.12344999,), (None,)], "x double").select(rounded("x").alias("x"))
    assert [r["x"] for r in df.collect()] == [0.0, 0.0001, 0.1234, None]


def test_paths(spark):
    data = ["src/a/b.test.ts", "test/a/b.ts", "spec/main.tsp", ".eslintrc", "a/.b.ts", "x_spec.rb", "Makefile", "lib/openapi.v1.yaml", "a.b/c", "vite.config.mjs", ""]
    p = F.col("p")
    df = spark.createDataFrame([(x,) for x in data], "p string")
    got = {r[0]: tuple(r)[1:] for r in df.select("p", paths.is_test(p), paths.is_contract(p), paths.is_source(p), paths.is_indentation_significant(p)).collect()}
    assert got["src/a/b.test.ts"] == (True, False, True, False)
    assert got["test/a/b.ts"][0] and not got["spec/main.tsp"][0] and got["spec/main.tsp"][1]
    assert not got[".eslintrc"][2] and got["a/.b.ts"][2] is True and got["x_spec.rb"][0]
    assert got["Makefile"][3] and got["lib/openapi.v1.yaml"][1] and got[""] == (False, False, False, False)


def test_distance_and_test_pairs(spark):
    cases = [("src/a/x", "src/b", 1, False), ("a", "b", 0, False), ("a/b/c", "d/e", 3, False), ("src/a.ts", "src/a.test.ts", 0, True), ("src/a/b.ts", "test/a/b.test.ts", 4, True), ("p/y.ts", "p/tests/y.test.ts", 1, True), ("lib/x.ts", "__tests__/x.test.ts", 2, True), ("p/fixtures/y.ts", "p/fixtures/tests/y.test.ts", 1, False)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(paths.directory_distance(F.col("a"), F.col("b")).alias("d"), paths.is_test_pair(F.col("a"), F.col("b")).alias("t"))
    assert [(r["d"], r["t"]) for r in df.collect()] == [c[2:] for c in cases]


def test_subjects(spark):
    data = {"fix: x": "fix", "Fix typo": "fix", "Bug 12 - x": "other", "mm: fixes y": "fix", "feat: fix x": "convention", 'Revert "x"': "fix", "docs(a)!: b": "convention", "hello": "other", None: "other"}
    df = spark.createDataFrame([(s,) for s in data], "s string").select("s", subjects.subject_kind(F.col("s")).alias("k"))
    assert {r["s"]: r["k"] for r in df.collect()} == data
    t = spark.createDataFrame([("UTF-8 and AB-12 in (#7)",), ("x",), (None,)], "s string").select(subjects.ticket_of(F.col("s")), subjects.pull_request_of(F.col("s")))
    assert [tuple(r) for r in t.collect()] == [("AB-12", "7"), (None, None), (None, None)]
    m = ["Merge pull request #12 from a/feature", "Merge pull request #1 from a/develop", "Merge branch 'x'", "Merged PR 4: y", None]
    k = spark.createDataFrame([(x,) for x in m], "s string").select(subjects.merge_kind(F.col("s")).alias("k"))
    assert [r["k"] for r in k.collect()] == ["branch", "integration", None, "branch", None]


def test_complexity_and_tokens(spark):
    text = "a\n  b\n    c\n\td\n\n  \r\n  e"
    df = spark.createDataFrame([(text,), ("",), (None,), ("x" * 100_000,)], "t string")
    got = [r["c"] and tuple(r["c"]) for r in df.select(textual.complexity(F.col("t")).alias("c")).collect()]
    assert got[0] == (5, 5, 1.0, 2) and got[1] == (0, 0, 0.0, 0) and got[2] is None and got[3] == (1, 0, 0.0, 0)
    code = "let a = 'it' + 12.5; // note\n/* b */ f(`x\ny`, \"q\\\"r\");"
    one = spark.createDataFrame([(code,), ('"' + "z" * 200_000 + '"',)], "t string").select(textual.tokens(F.col("t")).alias("t"))
    got = [r["t"] for r in one.collect()]
    assert got[0] == ["let", "a", "=", '"', "+", "0", ";", "f", "(", '"', ",", '"', ")", ";"] or got[0][7:9] == ["f", "("]
    assert got[1] == ['"']


def test_copies_make_families(spark):
    text = " ".join(f"w{i} = f{i}(x{i});" for i in range(40))
    texts = spark.createDataFrame([("a", text), ("b", text + " more"), ("c", text + " less"), ("d", "short"), ("e", None)], "item string, text string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("a", "e")], "a string, b string")
    assert rows(textual.copy_families(pairs, texts)) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_components_and_reach(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("x", "y"), ("z", "z"), (None, "q"), ("y", "x")]
    df = spark.createDataFrame(chain, "a string, b string")
    got = dict(rows(graph.components(df)))
    assert {got[f"n{i:03}"] for i in range(71)} == {"n000"} and got["y"] == "x" and "z" not in got and len(got) == 73
    r = graph.reach(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string"), 3)
    assert ("a", "d", 3) in rows(r) and ("a", "c", 2) in rows(r) and not [x for x in rows(r) if x[0] == x[1]]
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_cliques():
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("c", "e"), ("e", "f")]
    assert graph.maximal_cliques(links) == ([("a", "b", "c"), ("c", "d", "e")], False)
    dense = [(f"{i}", f"{j}") for i in range(24) for j in range(i) if (i + j) % 7]
    assert graph.maximal_cliques(dense, most=5)[1] is True


def test_trend_line_golden_case(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([0.8, 0.62, 0.45, 0.3])] + [("short", 0, 1.0), ("short", 1, 2.0)], "k string, i int, v double")
    got = trends.theil_sen(df, "k", "i", "v").collect()
    assert [(r["k"], round(r["slope"], 4), round(r["from"], 4), round(r["to"], 4)) for r in got] == [("k", -0.1683, 0.7942, 0.2892)]


def verdicts(spark, *series):
    """The verdict of each series of (share, changes); None stands for a slice without evidence."""
    rows = [(k, [(float(i), float(v), float(n)) for i, p in enumerate(s) if p for v, n in [p]]) for k, s in enumerate(series)]
    return [r["verdict"] for r in trends.judged(spark.createDataFrame(rows, "k int, s array<struct<x:double,y:double,n:double>>")).orderBy("k").collect()]


def test_a_share_moves_only_beyond_noise_and_without_its_ends(spark):
    fall = [(0.9 - 0.12 * i, 400) for i in range(6)]
    got = verdicts(spark, fall, fall[::-1], [(0.5, 400)] * 6, [(1.0, 1)], fall[:4], [(0.9, 400), *[(0.5, 400)] * 5, (0.1, 400)], [(0.9 - 0.12 * i, 8) for i in range(6)], [fall[0], None, *fall[1:]])
    # four slices are too few for a verdict, two are no trend; what only the ends say does not count; eight changes prove little
    assert got == ["eroding", "improving", "holding", None, "holding", "holding", "holding", "eroding"]


def sliced(spark, slices, stats):
    """A history of baskets by slice."""
    baskets = [(i, b) for i, s in enumerate(slices) for b in s]
    ch = [change(k, len(set(b)), slice=i) for k, (i, b) in enumerate(baskets)]
    return History(frame(spark, CHANGES, ch), frame(spark, ITEMS, [(k, p) for k, (_, b) in enumerate(baskets) for p in b]), frame(spark, STATS, stats))


def test_slices_count_from_ten_changes_and_test_areas_never(spark):
    stats = [stat("m/a", "m"), stat("n/b", "n"), stat("t/x.test.ts", "t", test=True)]
    h = sliced(spark, [[["m/a"]] * 9 + [["n/b"]] * 10, [["m/a"]] * 10 + [["t/x.test.ts"]] * 12, [["m/a", "n/b"]] * 10], stats)
    assert rows(trends.slice_cohesion(h).select("slice", "area", "share")) == [(0, "n", 1.0), (1, "m", 1.0), (2, "m", 0.0), (2, "n", 0.0)]
    assert trends.repository_erosion(h).collect()[0]["verdict"] == "holding" and trends.erosion(h).count() == 0
    quiet = sliced(spark, [[["m/a"]] * 10, [["m/a"]] * 10, [["m/a"]] * 2], stats)
    assert tuple(trends.repository_erosion(quiet).first()) == (2, None, None, "unknown", 2)


def test_a_quiet_end_of_the_series_takes_part_in_now(spark):
    stats = [stat(f"m/f{i}", "m", loc=10) for i in range(10)]
    hot = [["m/f0"]] * 10
    h = sliced(spark, [hot, hot, hot, hot, [["m/f1"]]], stats)
    # the last two slices are the fourth and the quiet fifth: three earlier ones count
    assert {r["path"]: (r["active"], r["hot"], r["kind"]) for r in hotspots.heat_kinds(h).collect()}["m/f0"] == (4, 4, "chronic")
    short = sliced(spark, [hot, hot, hot, [["m/f1"]]], stats)
    assert {r["path"]: r["kind"] for r in hotspots.heat_kinds(short).collect()}["m/f0"] == "other"


def test_only_ranked_areas_are_compared(spark):
    stats = [stat(f"{m}/x", m) for m in "mno"] + [stat("t/x.test.ts", "t", test=True)]
    h = history(spark, [["m/x", "n/x", "t/x.test.ts"]] * 6 + [["o/x", "m/x"]] * 4, stats)
    assert rows(coupling.module_couplings(h)) == [("m", "n", 6, 1.0)]


def test_dependency_direction(spark):
    stats = [stat("a/x", "a"), stat("a/y", "a"), stat("b/z", "b"), stat("c/q", "c"), stat("t/x.test.ts", "t", test=True), stat("idle/i", "idle")]
    h = history(spark, [["b/z"]] * 8 + [["a/x", "b/z"]] * 3 + [["a/y", "b/z"]] + [["c/q"]], stats)
    edges = spark.createDataFrame([("a/x", "b/z"), ("a/x", "b/z"), ("c/q", "b/z"), ("idle/i", "b/z"), ("t/x.test.ts", "b/z"), ("b/z", "b/z")], "src string, dst string")
    got = {(r["from"], r["to"]): (r["imports"], r["changes_from"], r["changes_to"], r["together"]) for r in modules.dependency_direction(h, edges).collect()}
    # a/y changed with b/z but does not import it; a module that never changed is told as well
    assert got == {("a", "b"): (1, 4, 12, 3), ("c", "b"): (1, 1, 12, 0), ("idle", "b"): (1, 0, 12, 0)}


def test_unstable_interfaces(spark):
    users = [f"u{i}" for i in range(5)]
    h = history(spark, [["api", "u0"], ["api", "u0"], ["api", "u1"], ["api"], ["api", "u2", *[f"w{i}" for i in range(60)]]], [stat("api", "m")])
    edges = spark.createDataFrame([(u, "api") for u in users] + [("x.test.ts", "api")], "src string, dst string")
    got = modules.unstable_interfaces(h, edges).collect()
    # five logical changes count, one of them too large to say what changed together
    assert [(r["item"], r["module"], r["fan_in"], r["changes"], r["typical"], r["changed_dependents"], [tuple(d) for d in r["dependents"]]) for r in got] == [("api", "m", 5, 5, 1, 2, [("u0", 2), ("u1", 1)])]


def test_verdict_takes_parts_of_all_heat(spark):
    states = lambda data: spark.createDataFrame(data, "area string, heat_share double, state string")
    h = history(spark, [["m/a"]])
    got = lambda data: tuple(modules.verdict(h, areas=states(data)).first())
    assert got([("a", 0.4, "leaks"), ("b", 0.3, "holds"), ("c", 0.3, "unjudged")]) == ("mixed", None, 0.4, 0.7, False, ["a", "b"], ["a"])
    assert got([("a", 0.2, "leaks"), ("b", 0.29, "holds")])[:4] == ("unknown", "too-little-evidence", 0.2, 0.49)
    assert got([])[:2] == ("unknown", "no-territories") and got([("a", 0.6, "leaks")])[0] == "strained" and got([("a", 0.6, "holds")])[0] == "holds"
    stats = [stat("m/a", "m"), stat("n/b", "n")]
    worse = sliced(spark, [[["m/a"]] * (40 - 8 * i) + [["m/a", "n/b"]] * (8 * i) for i in range(6)], stats)
    assert tuple(modules.verdict(worse, areas=states([("a", 0.6, "holds")])).first())[:1] == ("mixed",)


def test_modules_are_split_until_none_dominates(spark):
    from tidemark.operators import territories

    frame_ = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    deep = [f"src/a/b/c/d/e/f/g/h/i/x{i}/y{j}.ts" for i in range(3) for j in range(10)] + ["src/z.ts"]
    assert {m for _, m in rows(territories.detect_modules(frame_(deep)))} == {"src", *[f"src/a/b/c/d/e/f/g/h/i/x{i}" for i in range(3)]}
    packages = spark.createDataFrame([("p",), ("q",)], "directory string")
    two = [f"p/{d}/f{i}.ts" for d in "ab" for i in range(20)] + ["q/x.ts"]
    assert {m for _, m in rows(territories.detect_modules(frame_(two), packages))} == {"p", "q"}
    only = [f"p/{d}/f{i}.ts" for d in "ab" for i in range(20)] + ["q/x.test.ts"]
    assert {m for _, m in rows(territories.detect_modules(frame_(only), packages))} == {"p/a", "p/b", "q"}
    assert rows(territories.detect_modules(frame_([]))) == []


def test_reverts_and_duplicates(spark):
    cm = [commit("r", 0, 30, reverts="o"), commit("o", 5, 10), commit("half", 1, 20, reverts="p"), commit("p", 6, 5), commit("c1", 7, 1), commit("c2", 2, 40), commit("self", 3, 1, reverts="self"), commit("gone", 4, 1, reverts="nowhere")]
    cf = [touch("o", "a", old="1", new="2"), touch("o", "b", old="3", new="4"), touch("r", "a", old="2", new="1"), touch("r", "b", old="4", new="3"), touch("p", "a", old="1", new="9"), touch("p", "b", old="1", new="2"), touch("half", "a", old="9", new="1"), touch("c1", "x", old="7", new="8"), touch("c2", "x", old="7", new="8"), touch("self", "y"), touch("gone", "z", new="5")]
    c, f = frame(spark, COMMITS, cm + cm[:1]), frame(spark, COMMIT_FILES, cf + cf[:2])
    assert rows(mechanical.named_reverts(c)) == [("half", "p"), ("r", "o")]
    assert rows(mechanical.confirmed_reverts(c, f)) == [("r", "o", 2)]
    assert rows(mechanical.duplicates(c, f)) == [("c2", "c1")]
    assert rows(mechanical.kind_counts(c, f)) == [(0, 0, 0, 2, 1, 5)]


def test_reverts_pair_newest_first(spark):
    # b reverts a, c reverts b: a stays; d reverts e, as older f does: f stays; u repeats the undone e and is its own first
    cm = [commit("c", 0, 90, reverts="b"), commit("b", 1, 80, reverts="a"), commit("a", 2, 70), commit("d", 3, 60, reverts="e"), commit("f", 4, 50, reverts="e"), commit("e", 6, 10), commit("u", 5, 40), commit("v", 7, 95)]
    there, back = {"old": "1", "new": "2"}, {"old": "2", "new": "1"}
    cf = [touch("a", "x", **there), touch("b", "x", **back), touch("c", "x", **there), touch("e", "y", **there), touch("d", "y", **back), touch("f", "y", **back), touch("u", "y", **there), touch("v", "y", **there)]
    c, f = frame(spark, COMMITS, cm), frame(spark, COMMIT_FILES, cf)
    assert rows(mechanical.paired_reverts(c, f)) == [("c", "b"), ("d", "e")]
    assert dict(rows(mechanical.kinds(c, f))) == {"a": None, "b": "reverts", "c": "reverts", "d": "reverts", "e": "reverts", "f": None, "u": None, "v": "duplicates"}
    # a chain of five: the newest two pairs count, the first commit stays
    chain = [commit(f"k{i}", i, 9 - i, reverts=f"k{i + 1}") for i in range(4)] + [commit("k4", 4, 5)]
    files = [touch(f"k{i}", "x", **(back if i % 2 else there)) for i in range(5)]
    assert rows(mechanical.paired_reverts(frame(spark, COMMITS, chain), frame(spark, COMMIT_FILES, files))) == [("k0", "k1"), ("k2", "k3")]


def test_logical_changes(spark):
    day = 86_400
    cm = [commit("a", 0, 0, "x (#5)"), commit("b", 1, 14 * day, "y (#5)"), commit("c", 2, 14 * day + 1, "z (#5)"), commit("t1", 3, 0, "AB-1 one"), commit("t2", 4, day, "AB-1 two (#9)"), commit("t3", 5, 2 * day, "three (#9)"), commit("m", 6, 0, "AB-1", move=True), commit("n", 7, 0, None)]
    cf = [touch(s, f"{s}.ts") for s in ("a", "b", "c", "t1", "t2", "t3", "n")]
    members = grouping.logical_changes(frame(spark, COMMITS, cm), frame(spark, COMMIT_FILES, cf))
    assert dict(rows(members)) == {"a": "a", "b": "a", "c": "c", "t1": "t1", "t2": "t1", "t3": "t1", "n": "n"}
    table = {r["change"]: (r["commits"], r["size"]) for r in grouping.change_table(members, frame(spark, COMMITS, cm), frame(spark, COMMIT_FILES, cf)).collect()}
    assert table == {"a": (2, 2), "c": (1, 1), "t1": (3, 3), "n": (1, 1)}
    # forty files in each part: the ticket would make one change of more than fifty files
    wide = [touch(s, f"{s}{i}") for s in ("t1", "t2") for i in range(40)]
    assert dict(rows(grouping.logical_changes(frame(spark, COMMITS, cm), frame(spark, COMMIT_FILES, wide))))["t1"] == "t1"
    assert dict(rows(grouping.logical_changes(frame(spark, COMMITS, cm), frame(spark, COMMIT_FILES, wide))))["t2"] == "t2"


def test_lineage(spark):
    # newest first: new.ts was renamed from old.ts; dead.ts was deleted, its name given to another file later
    cm = [commit(f"c{i}", i, 100 - i) for i in range(8)]
    cf = [
        touch("c0", "new.ts"), touch("c1", "new.ts", renamed="old.ts"), touch("c2", "old.ts"),
        touch("c0", "dead.ts"), touch("c3", "dead.ts", created=True, new="n1"), touch("c4", "dead.ts", removed=True, old="n0"), touch("c5", "dead.ts"),
        touch("c3", "back.ts", created=True, new="same"), touch("c4", "back.ts", removed=True, old="same"), touch("c6", "back.ts"), touch("c7", "plain.ts"),
    ]
    got = {(r["sha"], r["path"]): (r["today"], r["earlier"]) for r in lineage.lives(frame(spark, COMMIT_FILES, cf), frame(spark, COMMITS, cm)).collect()}
    assert got[("c2", "old.ts")] == ("new.ts", False) and got[("c1", "new.ts")] == ("new.ts", False)
    assert got[("c4", "dead.ts")] == ("dead.ts", True) and got[("c5", "dead.ts")] == ("dead.ts", True) and got[("c3", "dead.ts")] == ("dead.ts", False)
    assert got[("c4", "back.ts")] == ("back.ts", False) and got[("c6", "back.ts")] == ("back.ts", False)
    assert got[("c7", "plain.ts")] == ("plain.ts", False) and len(got) == len(cf)


def test_nearest_ancestor(spark):
    p = spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("z.ts",)], "path string")
    h = spark.createDataFrame([("a",), ("a/b",), ("a",)], "directory string")
    assert rows(textual.nearest_ancestor(p, h)) == [("a/b/c.ts", "a/b"), ("a/x.ts", "a"), ("z.ts", None)]
