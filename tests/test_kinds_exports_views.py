from pyspark.sql import functions as F

from helpers import CHANGES, COMMIT_FILES, COMMITS, ITEMS, STATS, change, commit, frame, rows, stat, touch
from tidemark.operators import coupling, exports, hotspots, mechanical, modules, views
from tidemark.operators.heavy import last_before
from tidemark.operators.history import History

PATCH = "diff --git a/{p} b/{p}\n@@ -1 +1 @@\n-{a}\n+{b}\n"


def history(spark, baskets, stats=()):
    return History(frame(spark, CHANGES, [change(i, len(set(b))) for i, b in enumerate(baskets)]), frame(spark, ITEMS, [(i, p) for i, b in enumerate(baskets) for p in b]), frame(spark, STATS, list(stats)))


def test_every_mechanical_kind(spark):
    # skip is listed, moved is a move, blank changes white space only, back undoes gone by its patch, copy repeats first, real stays
    cm = [commit("real", 0, 99), commit("skip", 1, 90), commit("moved", 2, 80, move=True), commit("blank", 3, 70), commit("back", 4, 60, reverts="gone"), commit("gone", 5, 50), commit("copy", 6, 40), commit("first", 7, 30), commit("indented", 8, 20)]
    cf = [touch(c[0], "a.ts", new=c[0]) for c in cm]
    patch = lambda sha, p, a, b: (sha, PATCH.format(p=p, a=a, b=b))
    patches = spark.createDataFrame([patch("real", "a.ts", "1", "2"), patch("skip", "a.ts", "1", "3"), patch("blank", "a.ts", "x  y", "xy"), patch("back", "a.ts", "new", "old"), patch("gone", "a.ts", "old", "new"), patch("copy", "a.ts", "p", "q"), patch("first", "a.ts", "p", "q"), patch("indented", "b.py", "x", "  x")], "sha string, patch string")
    listed = spark.createDataFrame([("SKIP".ljust(40, "0").lower().replace("skip", "5c19"),), ("# note",), ("abc",)], "value string")
    assert mechanical.ignored_revisions(listed).count() == 1
    ignored, indented = spark.createDataFrame([("skip",), ("nowhere",)], "sha string"), spark.createDataFrame([("b.py",)], "path string")
    c, f = frame(spark, COMMITS, cm), frame(spark, COMMIT_FILES, cf)
    got = dict(rows(mechanical.kinds(c, f, ignored=ignored, patches=patches, indented=indented)))
    assert got == {"real": None, "skip": "ignored", "moved": "moves", "blank": "whitespace", "back": "reverts", "gone": "reverts", "copy": "duplicates", "first": None, "indented": None}
    # a copy on a parallel line repeats; one on top of the first lands again
    for up, want in ([("copy", ["other"]), ("other", []), ("first", [])], "duplicates"), ([("copy", ["gone"]), ("gone", ["first"]), ("first", [])], None):
        parents = spark.createDataFrame(up, "sha string, parents array<string>")
        assert dict(rows(mechanical.kinds(c, f, ignored=ignored, patches=patches, parents=parents)))["copy"] == want
    counts = mechanical.kind_counts(c, f, ignored=ignored, patches=patches, indented=indented).first().asDict()
    assert counts == {"ignored": 1, "moves": 1, "whitespace": 1, "reverts": 2, "duplicates": 1, "real": 3}
    assert rows(mechanical.kind_counts(frame(spark, COMMITS, []), frame(spark, COMMIT_FILES, []))) == [(0,) * 6]


def test_activity_of_todays_files(spark):
    cm = [commit("c0", 0, 9), commit("c1", 1, 8), commit("c2", 2, 7), commit("m", 3, 6, move=True)]
    cf = [touch("c0", "new.ts", added=5), touch("c1", "new.ts", renamed="old.ts", added=0), touch("c2", "old.ts", added=7, deleted=1), touch("m", "new.ts", added=99)]
    c, f = frame(spark, COMMITS, cm), frame(spark, COMMIT_FILES, cf)
    from tidemark.operators import lineage

    got = hotspots.item_activity(f, c, history(spark, [["new.ts"]]), mechanical.kinds(c, f), lineage.lives(f, c))
    assert rows(got) == [("new.ts", 3, 12, 1, 1)]


def test_last_before_spans_ranges(spark):
    data = [("hot", i, f"v{i}" if i % 50 == 0 else None) for i in range(400)] + [("b", 3, "x"), ("b", 3, None), ("b", 4, None), ("c", 1, None), (None, 1, "n"), (None, 2, None)]
    df = spark.createDataFrame(data, "k string, t long, v string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["t"], r["v"]): r["before_v"] for r in last_before(df, "k", "t", ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(got["hot", i, v] == (f"v{(i - 1) // 50 * 50}" if i else None) for _, i, v in data[:400])
    assert got["b", 3, "x"] is None and got["b", 3, None] is None and got["b", 4, None] == "x" and got["c", 1, None] is None and len(got) == len(data)


def test_exports_follow_stars_and_re_exports(spark):
    files = {
        "m/index.ts": 'export * from "./a";\nexport * from "./b";\nexport { own as mine } from "./a";\nexport * as space from "./c";\nexport { pkg } from "lib";\nexport default function f() {}\n',
        "m/a.ts": 'export const own = 1;\nexport const both = 1;\nexport default class A {}\nexport * from "./loop";\n',
        "m/b.ts": 'export const both = 2;\nexport type { T } from "./c";\n',
        "m/c.ts": "export interface T {}\n", "m/loop.ts": 'export * from "./a";\nexport const looped = 1;\n',
        "n/index.ts": 'export * from "outside";\nexport const x = 1;\n', "o/main.py": "x = 1\n", "o/impl.ts": "let a;\n", "n/impl.ts": "let a;\n", "m/x.test.ts": "export const test = 1;\n",
    }
    texts = spark.createDataFrame([*files.items(), ("m/null.ts", None), (None, "export const a = 1;")], "item string, text string")
    known, unknown = exports.visible_exports(texts, texts.where("item is not null").select(F.col("item").alias("path")))
    got = {(r["file"], r["name"]): r["binding"] for r in known.collect()}
    own = {n: b for (f, n), b in got.items() if f == "m/index.ts"}
    # two stars bring different things called both; default is not handed on
    assert own == {"own": "m/a.ts#own", "mine": "m/a.ts#own", "looped": "m/loop.ts#looped", "T": "m/c.ts#T", "space": "m/c.ts#*", "pkg": "ext:#lib#pkg", "default": "m/index.ts#default"}
    assert got["m/a.ts", "looped"] == "m/loop.ts#looped" and rows(unknown) == [("n/index.ts",)]
    places = spark.createDataFrame([(p, p[0], ".test." in p, 10) for p in files], "item string, area string, test boolean, loc long")
    entries = spark.createDataFrame([("m/index.ts", "m"), ("n/index.ts", "n"), ("o/main.py", "o")], "item string, area string")
    assert rows(exports.module_depth(texts, places, entries)) == [("m", 7, 40, 5.7143)]
    assert exports.module_depth(texts.where("false"), places, entries).count() == 0


def test_views(spark):
    stats = [stat("m/index.ts", "m", changes=9, loc=50), stat("m/x.ts", "m", changes=9, loc=90), stat("n/y.ts", "n", changes=5, loc=20), stat("t/z.test.ts", "t", test=True, changes=9, loc=900)]
    h = history(spark, [["m/index.ts", "m/x.ts"]] * 5 + [["m/x.ts", "n/y.ts"]] * 6 + [["n/y.ts"]], stats)
    entries = spark.createDataFrame([("m/index.ts", "m"), ("n/none.ts", "n")], "item string, area string")
    assert rows(views.leaking_entry_points(h, entries)) == []  # five of eleven changes leak
    more = history(spark, [["m/index.ts", "m/x.ts"]] * 5 + [["m/x.ts"]] * 5, stats)
    assert rows(views.leaking_entry_points(more, entries)) == [("m/index.ts", "m", 0.5)]
    assert [r["area"] for r in views.least_cohesive(h).collect()] == ["n", "m"]
    top = views.overview_hotspots(h).collect()
    assert [r["path"] for r in top][:1] == ["m/x.ts"] and len(top) == 3 and top[0]["toggleable"] and not top[0]["includes_tests"]
    assert len(views.overview_hotspots(h, include_tests=True).collect()) == 4
    weak = {r["area"]: (r["leaks"], r["partner"], r["partner_share"]) for r in views.weak_structure(h).collect()}
    assert weak == {"m": (True, "n", 0.5455), "n": (True, "m", 0.8571)}
    relations = spark.createDataFrame([("m/x.ts", "n/y.ts", "none")], "a string, b string, relation string")
    assert rows(views.co_change(h, relations)) == [("m", "n", 6, 1, 1)]
    assert dict(rows(views.thresholds(h)))["module_changes"] == 5.0
    contracts = views.contract_activity(frame(spark, COMMIT_FILES, [touch("c", "api/a.proto", added=3), touch("c", "b.ts")]), frame(spark, COMMITS, [commit("c", 0)]), h)
    assert rows(contracts) == [("api/a.proto", ".", 1, 0, 3, 0)]
    empty = history(spark, [])
    for view in (views.weak_structure, views.least_cohesive, views.overview_hotspots, views.leaking_entry_points):
        assert view(empty).count() == 0


def test_a_keeping_history_gives_the_same(spark):
    stats = [stat("m/a", "m"), stat("n/b", "n")]
    h = history(spark, [["m/a", "n/b"]] * 5 + [["m/a"]] * 3, stats)
    kept = h.keeping()
    for measure in (coupling.couplings, coupling.module_couplings, modules.cohesion, modules.standings, hotspots.hotspot_scores, modules.fix_density):
        assert rows(measure(h)) == rows(measure(kept)) == rows(measure(kept))
    assert kept.keeping() is kept and "pairs" in kept.kept and h.kept is None
