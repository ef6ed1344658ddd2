import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import CHANGES, COMMIT_FILES, COMMITS, ITEMS, MANIFESTS, change, commit, frame, rows, touch
from tidemark.operators import manifests as M
from tidemark.operators.heavy import distinct_per_key, key_dictionary, number_within_key
from tidemark.operators.revisions import path_activity
from tidemark.operators.shred import _deep, nodes_of, parse_strict, shred
from tidemark.operators.skew import salted_join


def expected_targets(body, steps=8):
    def no(x):
        raise ValueError(x)

    try:
        v = json.loads(body, parse_constant=no)
    except (ValueError, TypeError):
        return set()
    if not isinstance(v, dict):
        return set()
    out = []

    def walk(x, path, left):
        if isinstance(x, str):
            out.append((" > ".join(path), x))
        elif left:
            for k, y in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
                walk(y, [*path, str(k)], left - 1)

    if "exports" in v:
        walk(v["exports"], ["exports"], steps)
    e = v.get("exports")
    dotted = isinstance(e, dict) and any(k.startswith(".") for k in e)
    found = [(p, t, int(not dotted or (p.split(" > ") + [""])[1] == ".")) for p, t in out]
    none = not any(f[2] for f in found)
    return set(found) | {(f, v[f], int(none)) for f in ("main", "module", "types") if isinstance(v.get(f), str)}


BODIES = [
    None, "", "  ", "null", '"x"', "[1]", "{}", '{"exports": "./a.js"}', '{"exports": {".": "./a", "./b": ["./c", {"d": "./e"}]}, "main": "m"}',
    '{"exports": {".": {}, "./b": "./c"}, "main": "m", "types": "t"}', '{"exports": {"import": "./i", "default": null}, "module": 3}', "{'exports': 'a'}", '{"exports": "a",}',
    '{"exports": NaN}', '{"main": "a"} x', '// c\n{"main": "a"}', '{"main": "\\u00e9\\n\\ud83d\\ude00"}', '{"main": "\t"}', '{"main": "a", "main": "b"}', '{"exports": []}', '{"main": 01}',
    '{"exports": {"1": {"2": {"3": {"4": {"5": {"6": {"7": {"8": "in", "9": {"x": "out"}}}}}}}}}}',
]


def test_targets_match_a_plain_walk(spark):
    data = [(i, "p", b, None) for i, b in enumerate(BODIES)] * 2 + [(None, None, '{"main": "lost id"}', None)]
    got = rows(M.targets(frame(spark, MANIFESTS, data)))
    want = {(i, *t) for i, b in enumerate(BODIES) for t in expected_targets(b)} | {(None, "main", "lost id", 1)}
    assert set(got) == want and len(got) == len(want)


def test_shredding_empty_and_wide(spark):
    assert M.targets(frame(spark, MANIFESTS, [])).count() == 0
    assert M.packages(frame(spark, MANIFESTS, [])).count() == 0
    body = json.dumps({"exports": {str(i): "./x" for i in range(20_000)}, "name": "n", "dependencies": {"d": "1", "e": 2}})
    df = frame(spark, MANIFESTS, [(1, "p", body, None), (2, "p", None, None)])
    assert M.targets(df).count() == 20_000
    assert rows(M.packages(df)) == [(1, "n", None, None, None, None)]
    assert rows(M.dependencies(df)) == [(1, "dependencies", "d", "1")]
    out = shred(df.select("manifest_id", "body"), "body")
    assert {r["manifest_id"]: r["nodes"] is None for r in out.collect()} == {1: False, 2: True}


def test_deep_json_and_lone_surrogates():
    deep = "[" * 60_000 + '"x"' + "]" * 60_000
    nodes = nodes_of(deep)
    assert len(nodes) == 60_001 and nodes[-1][5] == "x"
    assert nodes_of("[" * 60_000) is None
    assert nodes_of('{"main": "\\ud800"}')[1][5] == "�"


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12), st.integers(0, 3))
def test_stack_parser_equals_recursive_one(value, cut):
    text = json.dumps(value)
    for t in (text, text[: len(text) - cut], text + "}" * cut, text.replace(",", ",,") if cut else text):
        def attempt(f, t=t):
            try:
                return repr(f(t))
            except ValueError:
                return "error"

        assert attempt(_deep) == attempt(parse_strict)


def test_activity_against_brute_force(spark):
    rng = random.Random(5)
    shas = [f"s{i}" for i in range(60)]
    paths = ["hot"] * 20 + [f"p{i}" for i in range(12)]
    cf = [touch(rng.choice(shas), rng.choice(paths)) for _ in range(400)] + [touch(None, "hot"), touch("s1", None)]
    cm = [commit(s, i, move=m) for i, s in enumerate(shas[:50]) for m in [rng.choice([True, False, False, None])]] * 2
    ch = [change(i, rng.choice([3, 50, 51])) for i in range(40)] + [change(99, None)]
    ci = [(rng.randrange(45), rng.choice(paths)) for _ in range(300)] + [(None, "hot"), (1, None)]
    got = path_activity(frame(spark, COMMIT_FILES, cf), frame(spark, COMMITS, cm), frame(spark, ITEMS, ci), frame(spark, CHANGES, ch * 2))
    real = {c[0] for c in cm if c[4] is False}
    counted = {c[2] for c in ch if c[5] is not None and c[5] <= 50}
    held = {(i, p) for i, p in ci if i in counted and p is not None}
    want = []
    for p in {c[1] for c in cf if c[1]}:
        near = {q for i, q in held for j, r in held if i == j and r == p and q != p}
        want.append((p, len({c[0] for c in cf if c[1] == p and c[0] in real}), len(near)))
    assert rows(got) == sorted(want, key=repr)


def test_activity_of_empty_tables(spark):
    empty = [frame(spark, s, []) for s in (COMMIT_FILES, COMMITS, ITEMS, CHANGES)]
    assert path_activity(*empty).count() == 0
    one = path_activity(frame(spark, COMMIT_FILES, [touch("s", "p")]), *empty[1:])
    assert rows(one) == [("p", 0, 0)]


def test_heavy_key_is_numbered_without_gaps(spark):
    data = [("hot" if i % 3 else f"k{i}", i // 2, i) for i in range(900)] + [(None, 1, -1), (None, 2, -2)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    got = number_within_key(df, "k", ["o", "v"], "n", "of").collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["n"], r["o"], r["v"], r["of"]))
    assert len(got) == len(data)
    for part in by.values():
        part.sort()
        assert [x[0] for x in part] == list(range(1, len(part) + 1)) and {x[3] for x in part} == {len(part)}
        assert [x[1:3] for x in part] == sorted(x[1:3] for x in part)


def test_distinct_counts_and_dictionary(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 3)], "k string, v long")
    assert rows(distinct_per_key(df, "k", "v", "n")) == [("a", 2)]
    assert sorted(r["key"] for r in key_dictionary(df, "k").collect()) == ["a", "b"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("z", 3)], "k string, v long")
    right = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, w long")
    assert rows(salted_join(left, right, "k", "v", how).select("k", "v", "w")) == rows(left.join(right, "k", how).select("k", "v", "w"))
