import json

from pyspark.sql import functions as F

from helpers import CHANGES, ITEMS, STATS, change, frame, rows, stat
from tidemark.functions import descriptions as D
from tidemark.functions.paths import glob_pattern
from tidemark.operators import imports, territories
from tidemark.operators.heavy import value_ranks
from tidemark.operators.history import History
from tidemark.plans import report
from tidemark.sources.inventory import contract_homes, inventory, read_files


def small_history(spark):
    stats = [stat(f"m/src/f{i}.ts", "m", revisions=i, changes=i, loc=10 * i, complexity=i) for i in range(1, 9)] + [stat(f"n/lib/g{i}.ts", "n", revisions=2, changes=3, loc=5) for i in range(4)]
    baskets = [["m/src/f1.ts", "n/lib/g0.ts"]] * 6 + [["m/src/f2.ts", "m/src/f3.ts"]] * 5 + [["n/lib/g1.ts"]] * 4
    return History(frame(spark, CHANGES, [change(i, len(b), "fix" if i % 3 else "convention", slice=i % 3) for i, b in enumerate(baskets)]), frame(spark, ITEMS, [(i, p) for i, b in enumerate(baskets) for p in b]), frame(spark, STATS, stats))


def test_value_ranks_equal_a_window(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("k" if i % 4 else f"o{i % 8}", float(i * 7 % 23)) for i in range(300)] + [(None, 1.0), ("k", None)], "k string, v double")
    want = df.where("k is not null and v is not null").select("k", "v", F.rank().over(Window.partitionBy("k").orderBy(F.desc("v"))).alias("rank"), F.count("*").over(Window.partitionBy("k")).alias("total")).distinct()
    assert rows(value_ranks(df, "k", "v")) == rows(want)
    assert value_ranks(df.where("false"), None, "v").count() == 0


def test_globs():
    import re

    hit = lambda g, p: re.fullmatch(glob_pattern(g), p) is not None
    assert hit("src/**/*.ts", "src/a.ts") and hit("src/**/*.ts", "src/a/b/c.ts") and not hit("src/*.ts", "src/a/b.ts")
    assert hit("**/*.{ts,js}", "x.js") and hit("a?.go", "ab.go") and not hit("a.go", "abgo") and hit("**", ".x/y")


def test_import_scan(spark):
    a = 'import x from "./b.js";\nimport { type T,\n y } from "../n/c";\nimport "pkg";\nconst z = require("./gone");\nexport * from "./d";\nexport const one = 1, q = 2;\nexport { two as three, four };\nexport default function five() {}\n'
    texts = spark.createDataFrame([("m/a.ts", a), ("m/b.ts", "export class B {}"), ("n/c/index.ts", "let a;"), ("m/d.tsx", 'import "../../../out";'), ("m/x.py", "import os"), ("m/null.ts", None), (None, a)], "item string, text string")
    found = imports.resolved(imports.scan(texts), texts.where("item is not null").select(F.col("item").alias("path")))
    got = {(r["item"], r["specifier"]): (r["target"], r["state"]) for r in found.collect()}
    assert got == {("m/a.ts", "./b.js"): ("m/b.ts", "file"), ("m/a.ts", "../n/c"): ("n/c/index.ts", "file"), ("m/a.ts", "pkg"): (None, "external"), ("m/a.ts", "./gone"): (None, "missing"), ("m/a.ts", "./d"): ("m/d.tsx", "file"), ("m/d.tsx", "../../../out"): (None, "missing")}
    done = imports.complete_files(imports.scan(texts), texts, found)
    assert rows(done) == [("m/b.ts",), ("n/c/index.ts",)]
    links = found.where("state = 'file'").select(F.col("item").alias("src"), F.col("target").alias("dst"))
    pairs = spark.createDataFrame([("m/a.ts", "m/b.ts"), ("m/b.ts", "n/c/index.ts"), ("m/b.ts", "m/x.py")], "a string, b string")
    assert rows(imports.linked_pairs(pairs, links, done)) == [("m/a.ts", "m/b.ts", "a→b"), ("m/b.ts", "m/x.py", None), ("m/b.ts", "n/c/index.ts", "none")]


def test_descriptions(spark):
    assert D.readme_sentence("# Title\n\n![b](x)\n\n- list\n\nA **small** [tool](u) for `x`. More text.\n") == "A small tool for x."
    assert D.readme_sentence("") is None and D.readme_sentence(None) is None and D.readme_sentence("# only\n```\ncode is here now\n```") is None
    assert D.readme_sentence("[" * 100_000 + "(" * 100_000) is None
    assert D.json_description('{"description": " a  b "}') == "a b" and D.json_description("[") is None
    assert D.toml_description('[project]\ndescription = "x y"') == "x y" and D.toml_description("= 1") is None
    assert D.pom_description("<project xmlns='u'><parent><description>no</description></parent><description>yes it is</description></project>") == "yes it is"
    assert D.pom_description("<!DOCTYPE a [<!ENTITY b 'c'>]><a/>") is None and len(D.tidy("word " * 100)) <= D.LONGEST
    df = spark.createDataFrame([("a/README.md", "One two three."), ("a/package.json", '{"description": "d"}'), ("a/x.ts", "t"), ("a/pom.xml", None)], "path string, text string")
    assert [r[0] for r in df.select(D.description(F.col("path"), F.col("text"))).collect()] == ["One two three.", "d", None, None]


def test_inventory(spark, tmp_path):
    files = {"src/a.ts": b"let a;\n  b;\n", "src/bin.ts": b"a\x00b", "api/main.proto": b"x", "notes.txt": b"t", "gen/g.ts": b"let g;\n", "long.js": b"x" * 400, "src/ignored.ts": b"i", "bad.py": b"\xff\xfe = 1\n"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    ignored = spark.createDataFrame([("src/ignored.ts",)], "path string")
    got = {r["path"]: (r["kind"], r["complexity"] and r["complexity"]["loc"]) for r in inventory(read_files(spark, str(tmp_path)), exclude=["gen/**"], ignored=ignored).collect()}
    assert got == {"src/a.ts": ("code", 2), "api/main.proto": ("contract", None), "bad.py": ("code", 1)}
    homes = contract_homes(spark.createDataFrame([("api/v1/main.proto",), ("src/x.proto",), ("pkg/y.proto",)], "path string"), spark.createDataFrame([("pkg",)], "directory string"), spark.createDataFrame([("src/a.ts",)], "path string"))
    assert dict(rows(homes)) == {"api/v1/main.proto": "api", "src/x.proto": "src", "pkg/y.proto": "pkg"}


def test_territories(spark):
    h = small_history(spark)
    tree = territories.territories(h)
    assert {r["directory"] for r in tree.collect()} >= {"m/src", "n/lib"} or {r["directory"] for r in tree.collect()} >= {"m", "n"}
    level = territories.recommended_level(tree)
    fit = {r["area"]: r["containment"] for r in territories.containment(h, tree, level).collect()}
    assert set(fit.values()) <= {round(5 / 11, 4), 0.4} and len(fit) == 2
    files = spark.createDataFrame([(f"big/{'a' if i % 2 else 'b'}/f{i}",) for i in range(60)] + [("x/y",), (None,)], "path string")
    assert {r[0] for r in territories.detect_modules(files).select("module").distinct().collect()} == {"big/a", "big/b", "x"}
    empty = History(frame(spark, CHANGES, []), frame(spark, ITEMS, []), frame(spark, STATS, []))
    assert territories.territories(empty).count() == 0


def test_report_round_trip(spark):
    h = small_history(spark)
    edges = spark.createDataFrame([(f"m/src/f{i}.ts", "m/src/f1.ts") for i in range(2, 8)], "src string, dst string")
    relations = spark.createDataFrame([("m/src/f1.ts", "n/lib/g0.ts", "none")], "a string, b string, relation string")
    tables = report.report(h, edges, relations)
    text = report.to_json({k: tables[k] for k in ("files", "couplings", "verdict", "distantCouplings")}, 3, {"files": 12})
    back = report.from_json(text)
    assert len(back["files"]) == 3 and back["files"][0]["path"] == "m/src/f8.ts" and back["totals"] == {"files": 12} and back["erosion"] == []
    assert back["distantCouplings"][0]["hidden"] is True and json.loads(text)["schemaVersion"] == 1
    focus = report.inspect({k: tables[k] for k in ("files", "couplings", "changeRadius")}, ["n/**"])
    assert rows(focus["couplings"].select("a", "b")) == [("m/src/f1.ts", "n/lib/g0.ts")] and focus["files"].count() == 4
    found = tables["entryPoints"].collect()
    assert all(0 < r["score"] for r in found) and [r["place"] for r in sorted(found, key=lambda r: r["place"])] == list(range(1, len(found) + 1))


def test_entry_points_pair_copies_and_folds(spark):
    from tidemark.operators import entries

    stats = [stat(p, p[0], revisions=9, changes=9, loc=10) for p in ("m/a.ts", "n/b.ts", "o/c.ts")]
    baskets = [["m/a.ts", "n/b.ts"]] * 6 + [["o/c.ts"]] * 3
    h = History(frame(spark, CHANGES, [change(i, len(b)) for i, b in enumerate(baskets)]), frame(spark, ITEMS, [(i, p) for i, b in enumerate(baskets) for p in b]), frame(spark, STATS, stats))
    words = " ".join(f"w{i}" for i in range(60))
    texts = spark.createDataFrame([("m/a.ts", words), ("n/b.ts", words), ("o/c.ts", "let x")], "item string, text string")
    edges = spark.createDataFrame([], "src string, dst string")
    got = {r["kind"]: (r["subject"], r["score"]) for r in entries.entry_points(h, edges, texts=texts).collect()}
    # the pair has both thirds of the heat; the copies change in lockstep and the coupling names the same files
    assert got["boundary"] == ("m + n", 0.6667) and ("copies" in got) != ("coupling" in got)
    assert rows(entries.copy_findings(h, texts).select("kind", "subject", F.round("score", 4))) == [("copies", "m/a.ts + n/b.ts", 0.6667)]


def test_entry_points_settle():
    from tidemark.operators.entries import Finding, Limits, settled

    pair, small, large = Finding("boundary", "a + b", 0.5, ("a", "b")), Finding("clique", "a + b + c", 0.4, ("a", "b", "c")), Finding("clique", "a + b + c + d", 0.3, ("a", "b", "c", "d"))
    alone, weak = Finding("boundary", "d", 0.2, ("d",)), Finding("hotspot", "f", 0.001, (), ("f",))
    picked, out = settled([weak, alone, large, small, pair], Limits())
    assert picked == [pair, large, weak] and out == {small, alone}


def test_interface_files(spark):
    from tidemark.operators import modules

    files = ["m/index.ts", "m/src/index.tsx", "m/src/deep/index.ts", "m/src/a.ts", "m/lib/b.js", "m/src/c.ts", "m/index.test.ts", "m/vite.config.ts", "lib.rs", "src/__init__.py", "m/index.html"]
    h = History(frame(spark, CHANGES, [change(0, 2), change(1, 1), change(2, 1)]), frame(spark, ITEMS, [(0, "m/index.ts"), (0, "m/src/a.ts"), (1, "m/src/a.ts"), (2, "m/src/c.ts")]), frame(spark, STATS, [stat(f, "m" if f.startswith("m/") else ".", test="test" in f) for f in files]))
    assert [r[0] for r in rows(modules.entry_points(h))] == ["lib.rs", "m/index.ts", "m/src/index.tsx", "src/__init__.py"]
    targets = spark.createDataFrame([("m", "./lib/b.js"), ("m", "./dist/c.d.ts"), ("m", "./src/a"), ("m", "./gone.js"), ("m", "./x/*")], "area string, target string")
    assert [r[0] for r in rows(modules.entry_points(h, targets))] == ["lib.rs", "m/index.ts", "m/lib/b.js", "m/src/a.ts", "m/src/c.ts", "m/src/index.tsx", "src/__init__.py"]
    assert [r[0] for r in rows(modules.entry_points(h, globs=["m/src/*.ts"]))] == ["m/src/a.ts", "m/src/c.ts"]
    got = {r["area"]: (r["interface"], r["implementation"], r["leaked"], r["leakage"]) for r in modules.interface_churn(h).collect()}
    assert got == {"m": (1, 3, 1, 0.3333)}
