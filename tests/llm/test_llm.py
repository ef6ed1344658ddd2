import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import CHANGES, ITEMS, STATS, change, frame, rows, stat
from tidemark.llm import fusion, language, leakage, provenance, stripes, tokenizer
from tidemark.llm.prose import sentences
from tidemark.llm.queries import tokenizer_file

TEXTS = "item string, text string, n_bytes bigint"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string"


# provenance


GENERATED = [
    "// Code generated by x-gen v1.2; DO NOT EDIT.\npackage x\n", "# This file was automatically generated. Do not modify it by hand.\nx = 1\n", "/*\n * @generated by tool from a.proto\n */\nlet a;\n",
    '"""AUTO-GENERATED FILE - changes will be overwritten by y"""\nx = 1\n', "// <auto-generated> g 3.1 </auto-generated>\r\nlet a;\r\n", "// Generated from a.tsp on 2020-01-01; run `g sync` to refresh.\nlet a;\n",
    "// Diese Datei wurde automatisch aus a.proto erzeugt. Nicht bearbeiten.\nlet a;\n", "// THIS IS A MACHINE-WRITTEN FILE (g). Edit a.json instead.\nlet a;\n",
]
BY_HAND = [
    None, "", " \n", "let a = 1;\n", '// Writes the files below out/; they start with a "DO NOT EDIT" banner.\nlet a;\n', "// Ids are generated by f, see the vendor table in a/b.ts.\nlet a;\n",
    "// Adapted by hand from an older helper; the minified copy is gone.\nlet a;\n", "// Please do not edit the order of these cases without asking.\nlet a;\n", 'let a;\nconst banner = "// Code generated by x; DO NOT EDIT.";\n',
    "// Copyright the X project authors. Internal use.\nlet a;\n", 'let a = 1;\nconst icon = "' + "M1 2L3 4 " * 400 + '";\nlet b = 2;\nlet c = 3;\n',
    "const cases = [\n" + '  ["a", 1],\n' * 3 + "];\nfor (const c of cases) {\n  check(c);\n  more(c);\n  again(c);\n}\n",
]


#: Wordings held out while the rules were written.
UNSEEN = [
    "// NOTICE: produced with schemac 4 from orders.idl; never edit by hand.\nlet a;\n", "# Emitted by wirec 0.9\nx = 1\n", "/**\n * The contained code was transpiled from lib.ml\n * by mlc, re-run `make js`.\n */\nlet a;\n",
    "// grammarc v7 generated this module from calc.y\nlet a;\n", "// Source: calc.proto. File generated on 2021-04-05.\nlet a;\n", "-- This document has been automatically generated\nlet a;\n",
    "// Questo file è stato generato da x.\nlet a;\n", "// 此文件由 gen 自动生成。\nlet a;\n",
]
UNSEEN_BY_HAND = [
    "// Wraps clients generated by the compiler and adds retries.\nlet a;\n", "// Generated names are sorted before they are compared.\nlet a;\n", "# Compares the output of both parsers.\nx = 1\n",
    "// This class holds rows produced by the reader; do not modify the order of its fields.\nlet a;\n", "// Writes //# sourceMappingURL= lines for the bundler.\nlet a = '//# sourceMappingURL=' + f;\n",
    "/* Copyright 2019 The Lake Authors\n * Licensed under the Apache License, Version 2.0;\n * see https://www.apache.org/licenses/LICENSE-2.0 */\nlet a;\n",
    "enum Kind {\n  A = 1,\n  B = 2,\n  C = 3,\n  D = 4,\n  E = 5,\n  F = 6,\n  G = 7,\n  H = 8,\n}\n",
]


def test_reasons_of_unseen_wordings():
    assert [provenance.reason_of(t) for t in UNSEEN] == ["generated"] * len(UNSEEN)
    assert [provenance.reason_of(t) for t in UNSEEN_BY_HAND] == [None] * len(UNSEEN_BY_HAND)
    for text in ("/*\n * lib v2.3.1\n * MIT License\n * Copyright (c) 2015 Jane\n */\nlet a;\n", "// Vendored from https://x.example/a/b at 1a2b3c4\nlet a;\n"):
        assert provenance.reason_of(text) == "third party"
    assert provenance.reason_of("class A {\n" + "".join(f"  int getX{i}() {{\n    return this.raw[{i}];\n  }}\n" for i in range(5, 40))) == "generated"
    assert provenance.reason_of("module.exports = {\n" + "".join(f"  'k{i}': 'it is {'text ' * 80}' + f(),\n" for i in range(3))) == "packed"
    assert provenance.reason_of("İ" * 9 + "\nlet a;\n// Generated by x\n") is None


def test_reasons_of_files():
    assert {provenance.reason_of(t) for t in GENERATED} == {"generated"}
    assert [provenance.reason_of(t) for t in BY_HAND] == [None] * len(BY_HAND)
    assert provenance.reason_of("!function(a){" + "b.c(d);" * 100 + "}") == "packed"
    assert provenance.reason_of("export default [\n" + "  0x1f, 0x2b, 0x00,\n" * 30) == "data"
    assert provenance.reason_of('"use strict";\nexports.__esm = true;\nvar a = 1;\n') == "compiled"
    assert provenance.reason_of("/*!\n * lib v1.2.3\n * (c) lib contributors, released under the X-2 licence\n */\nlet a;\n") == "third party"
    assert provenance.reason_of("/* " + "a " * 300_000 + "*/" + "\n" * 100_000) is None


def test_found_paths(spark):
    data = [("a/vendor/x.ts", "let a;", 6), ("a/src/vendors/x.ts", "let a;", 6), ("d/x.min.js", None, 9), ("gen.ts", GENERATED[0], 9), ("gen.ts", GENERATED[0], 9), ("null.ts", None, None), ("dense.ts", None, 90_000), (None, GENERATED[0], 1), ("lib/x-1.2.3.js", "let a;", 1), ("package-lock.json", "{}", 2)]
    stats = [stat("dense.ts", loc=3), stat("dense.ts", loc=3), stat("null.ts", loc=None, complexity=None)]
    got = provenance.foreign_files(frame(spark, TEXTS, data), frame(spark, STATS, stats))
    assert [r[0] for r in rows(got)] == ["a/vendor/x.ts", "d/x.min.js", "dense.ts", "gen.ts", "lib/x-1.2.3.js", "package-lock.json"]
    assert provenance.foreign_files(frame(spark, TEXTS, []), frame(spark, STATS, [])).count() == 0


# one ranking of several scores


def test_fused_ranking(spark):
    rng = random.Random(1)
    stats = [stat(f"m/{i:02}", "m", score=rng.random() / 2, revisions=rng.randrange(50), loc=rng.randrange(100), complexity=rng.randrange(100)) for i in range(40)]
    stats += [stat("m/best", "m", score=0.8, revisions=60, loc=120, complexity=130), stat("m/long", "m", score=0.1, revisions=10**9, loc=1, complexity=1), stat("m/none", "m", score=None, revisions=900, loc=None, complexity=None)]
    stats += [stat(f"few/{i}", "few") for i in range(19)] + [stat(f"tie/{i:02}", "tie") for i in range(20)] + [stat("nan", "m", score=math.nan), stat(None, "m"), stat("x", None)]
    fused = fusion.fused_scores(frame(spark, STATS, stats + stats[:5]), "module", "path", fusion.file_scores())
    assert rows(fusion.top_of_group(fused, "module", "path")) == [("m", "m/best"), ("tie", "tie/00")]
    values = {r["path"]: r["fused"] for r in fused.collect()}
    assert values["m/none"] < min(v for k, v in values.items() if k not in ("m/none", "nan")) and abs(values["tie/03"] - 0.5) < 1e-9
    assert fusion.fused_scores(frame(spark, STATS, []), "module", "path", fusion.file_scores()).count() == 0


# items that appear together


def brute_pairs(ci, ch, limit=50):
    valid = {c[2] for c in ch if c[5] is not None and c[5] <= limit}
    held = {(i, p) for i, p in ci if i is not None and p is not None}
    changes, counted = {}, {}
    for i, p in held:
        changes.setdefault(p, set()).add(i)
        if i in valid:
            counted.setdefault(p, set()).add(i)
    out = {}
    names = sorted(counted)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            s = len(counted[a] & counted[b])
            if s:
                out[a, b] = (s, len(changes[a]), len(changes[b]), len(counted[a]), len(counted[b]), len(valid))
    return out


def test_partners_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(stripes, "BUFFER", 50)
    monkeypatch.setattr(stripes, "HEAVY", 10)
    rng = random.Random(3)
    ci = [(rng.randrange(80), rng.choice(["hot", "hot", "warm"] + [f"p{i}" for i in range(15)])) for _ in range(600)] + [(None, "hot"), (3, None)]
    ch = [change(i, rng.choice([4, 50, 51, None])) for i in range(75)] + [change(500, 1)]
    got = stripes.partners(frame(spark, ITEMS, ci), frame(spark, CHANGES, ch * 2)).collect()
    want = brute_pairs(ci, ch)
    assert {(r["item_a"], r["item_b"]): (r["shared"], r["changes_a"], r["changes_b"], r["counted_a"], r["counted_b"], r["counted"]) for r in got} == want and len(got) == len(want)
    strong = {k for k, (s, a, b, ca, cb, n) in want.items() if s >= 3 and 20 * s >= 3 * (a + b) and s * n >= 2 * ca * cb}
    assert {tuple(r) for r in stripes.strong_partners(frame(spark, ITEMS, ci), frame(spark, CHANGES, ch)).collect()} == strong
    assert stripes.partners(frame(spark, ITEMS, []), frame(spark, CHANGES, [])).count() == 0
    sure = {(r["item_a"], r["item_b"]) for r in stripes.partners(frame(spark, ITEMS, ci), frame(spark, CHANGES, ch)).collect() if r["llr"] >= 2} & strong
    assert {tuple(r) for r in stripes.strong_partners(frame(spark, ITEMS, ci), frame(spark, CHANGES, ch), min_llr=2).collect()} == sure


def test_log_likelihood(spark):
    df = spark.createDataFrame([(10, 20, 25, 100), (5, 20, 25, 100), (0, 0, 3, 9), (9, 9, 9, 9)], "s long, a long, b long, n long")
    got = [r[0] for r in df.select(stripes.log_likelihood(*[F.col(c) for c in "sabn"])).collect()]

    def g2(s, a, b, n):
        cells = [(s, a * b), (a - s, a * (n - b)), (b - s, (n - a) * b), (n - a - b + s, (n - a) * (n - b))]
        return 2 * sum(k * math.log(k * n / e) for k, e in cells if k)

    assert got == pytest.approx([g2(10, 20, 25, 100), 0, 0, 0], abs=1e-9)


# public tokenizer


@pytest.fixture(scope="module")
def bpe(spark):
    return tokenizer.ByteBpe.read(tokenizer_file(spark))


def test_ids_equal_the_public_library(spark, bpe):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(tokenizer_file(spark))
    public.encode_special_tokens = True
    texts = [
        "", " ", "  a  b ", "Hello world, don't we'll I'VE", "<|endoftext|> x", "a\r\n\tb  c d　e\u0085f", "漢字かな交じり文。テスト", "naïve café ＦＵＬＬ", "🚀🧪👩‍👩‍👧", "x" * 3000, "ab" * 900,
        "١٢٣ ½ ² ⅷ", "a" * 511, "é" * 300, "\x00\x01\x1c\x1f", "Ünïcödé-" * 50, "٠" * 700, "​﻿", "!!!???" * 300,
    ]
    rng = random.Random(9)
    texts += ["".join(rng.choice("ab é漢\n\t'’s1²_-🚀 ") for _ in range(rng.randrange(60))) for _ in range(60)]
    data = [(i, t, None, None, None, None) for i, t in enumerate(texts)] + [(9000, None, None, None, None, None)]
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode(frame(spark, DOCS, data + data[:4]), bpe).collect()}
    assert got.pop(9000) == [] and got[0] == []
    assert got == {i: public.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = spark.createDataFrame(list(got.items()), "i long, ids array<int>").select("i", bpe.decode(F.col("ids")).alias("t"))
    assert {r["i"]: r["t"] for r in back.collect()} == dict(enumerate(texts))


def test_encoding_odd_keys_and_empty_tables(spark, bpe):
    assert tokenizer.encode(frame(spark, DOCS, []), bpe).count() == 0
    data = [(None, "a b", None, None, None, None), (7, "x", None, None, None, None), (7, "y", None, None, None, None), (7, "y", None, None, None, None)]
    assert tokenizer.encode(frame(spark, DOCS, data), bpe).count() == 3


# evaluation texts


ITEM = " ".join(f"{w} {w}{i} number {i * 7}" for i, w in enumerate(["carrier", "voucher", "ledger", "anchor", "yarn", "filter", "quota", "needle", "umbra", "orbit", "kernel", "matrix", "basket", "token", "socket"]))


def test_leaks(spark):
    words = ITEM.split()
    half = words[10:45]
    edited = [w if i % 6 else "changed" for i, w in enumerate(half)]
    gaps = half[:12] + ["and", "now", "for", "something", "else"] * 4 + half[12:]
    docs = {1: "# " + "\n# ".join(" ".join(half[i : i + 5]) for i in range(0, 35, 5)), 2: " ".join(edited).upper(), 3: " ".join(gaps), 4: " ".join(words[:12]), 5: "Answer the question. nothing else", 6: "", 7: None, 8: "w " * 50_000 + " ".join(half) + " v" * 50_000, 9: " ".join(reversed(words)), 10: ITEM.replace("number", "nùmber")}
    items = spark.createDataFrame([(100, ITEM), (101, "Answer the question. " + " ".join(f"other{i} thing{i}" for i in range(40))), (102, None), (103, ""), (104, "two words"), (100, ITEM)], "item_id long, text string")
    df = frame(spark, DOCS, [(k, v, None, None, None, None) for k, v in docs.items()] * 2)
    assert sorted(r[:2] for r in rows(leakage.leaks(df, items))) == [(1, 100), (2, 100), (3, 100), (8, 100), (10, 100)]
    assert leakage.leaks(frame(spark, DOCS, []), items).count() == 0
    assert leakage.leaks(df, items.where("false")).count() == 0


def planted(n):
    """n items of 30 words, and for a few of them documents with a verbatim, an edited, an inserted-into and a thinned passage, and a scrap."""
    items = {i: [f"i{i}w{j}" if j % 3 else f"common{j % 5}" for j in range(30)] for i in range(n)}
    docs, want = {}, set()
    for i in (0, 7, n - 1):
        w = items[i]
        for k, text in enumerate((w[5:25], [x if j % 5 else "changed" for j, x in enumerate(w)], [y for j, x in enumerate(w) for y in ([x, "foreign"] if j % 3 == 2 else [x])], [x for j, x in enumerate(w) if j % 4], w[:4])):
            docs[i * 10 + k] = "so " * 9 + " ".join(text) + " and" * 9
            if k < 4:
                want.add((i * 10 + k, i))
    return items, docs, want


@pytest.mark.parametrize("n", [20, 200, 5000])
def test_answers_do_not_depend_on_the_number_of_items(spark, n):
    items, docs, want = planted(n)
    test = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = leakage.leaks(frame(spark, DOCS, [(k, v, None, None, None, None) for k, v in docs.items()]), test)
    assert {r[:2] for r in rows(got)} == want


def test_short_items_near_copies_and_unspaced_texts(spark):
    near = [f"v{j}" for j in range(40)]
    items = {1: "vier kurze neue wörter", 2: "eins zwei drei vier fünf sechs sieben acht", 3: "古い移行は名前が変わるたびに写しを残します", **{100 + k: " ".join(near[:20] + [f"own{k}"] + near[20:]) for k in range(8)}}
    docs = {1: "here: VIER kurze neue Wörter!", 2: "x eins zwei drei vier y", 3: "窓の前。古い移行は名前が変わるたびに写しを残した。", 4: "zzz " * 30 + " ".join(near[:18]), 5: "eins und acht"}
    got = leakage.leaks(frame(spark, DOCS, [(k, v, None, None, None, None) for k, v in docs.items()]), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {r[:2] for r in rows(got)} == {(1, 1), (2, 2), (3, 3)} | {(4, 100 + k) for k in range(8)}


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leakage.common_length(leakage.places(a), len(a), b) == table[-1][-1]


# languages


TRAINING = {
    "en": "The old migration keeps a copy of the lock file whenever a file is renamed. Please check whether the window is too short. Every adapter waits for the hidden coupling without any warning.",
    "de": "Die alte Umstellung behält eine Kopie der Sperrdatei, sobald eine Datei umbenannt wird. Bitte prüfe, ob das Fenster zu kurz ist. Jeder Adapter wartet auf die verborgene Kopplung ohne jede Warnung.",
    "fr": "L'ancienne migration garde une copie du fichier de verrouillage dès qu'un fichier est renommé. Vérifie si la fenêtre est trop courte. Chaque adaptateur attend le couplage caché sans aucun avertissement.",
    "ru": "Старая миграция хранит копию файла блокировки, когда файл переименован. Проверь, не слишком ли короткое окно. Каждый адаптер ждёт скрытую связь без всякого предупреждения.",
    "ja": "古い移行は、ファイルの名前が変わるたびに写しを残します。窓が短すぎないか確認してください。それぞれのアダプターは警告もなく隠れた結合を待っています。",
}


def test_prose():
    assert sentences(None) == sentences("") == sentences(" \n\t") == sentences("12 34 | 56\n" * 5) == sentences("const a = f(b);\nreturn a.b;\n") == []
    assert sentences("src/a/b.ts:12\nimport { a } from './b.js';\n// The old file waits for the new one.\nlet x = 1; // and this is a note too\n") == ["the old file waits for the new one", "and this is a note too"]
    assert sentences("> quoted text goes on\n> over several short lines.\n") == ["quoted text goes on over several short lines"]
    assert len(sentences("word " * 100_000)) == 1
    assert sentences(unicodedata.normalize("NFD", "Ça marche très bien là.")) == ["ça marche très bien là"]


def test_languages_of_held_out_texts(spark):
    data = []
    for code, text in TRAINING.items():
        for i in range(6):
            data.append((len(data), text, [code, code.upper(), f" {code} ", {"en": "English", "de": "deu", "fr": "fra", "ru": "rus", "ja": "jpn"}[code], f"{code}-XX", f"{code}_YY"][i], None, None, None))
    data.append((900, TRAINING["de"], "en", None, None, None))
    profiles = language.fit(frame(spark, DOCS, data))
    assert profiles.codes == ("de", "en", "fr", "ja", "ru")
    asked = {
        1: ("Every file waits for the old copy whenever it is short.", "en"), 2: ("Jede Datei wartet auf die alte Kopie, sobald sie zu kurz ist.", "en"), 3: ("Chaque fichier attend la copie cachée sans avertissement.", None),
        4: ("Every file waits for the old copy. Please check the hidden lock file.\n\nJede Datei wartet auf die alte Kopie. Bitte prüfe das Fenster ohne Warnung.", "en"), 5: ("", None), 6: (None, "xx"), 7: ("12 99 | 4", None), 8: ("それぞれのファイルは古い写しを待っています。", "ja-JP"), 9: ("Каждый файл ждёт старую копию без предупреждения.", "unknown"),
    }
    docs = frame(spark, DOCS, [(k, t, l, None, None, None) for k, (t, l) in asked.items()] * 2)
    assert rows(language.mislabelled(docs, profiles)) == [(2, "de"), (3, "fr"), (4, "de"), (4, "en"), (9, "ru")]
    assert language.mislabelled(frame(spark, DOCS, []), profiles).count() == 0
    assert language.mislabelled(frame(spark, DOCS, [])).count() == 0


def test_segments_of_mixed_texts(spark):
    profiles = language.fit(frame(spark, DOCS, [(i, t, c, None, None, None) for i, (c, t) in enumerate(TRAINING.items())]))
    part = {c: t.split(". ")[0] for c, t in TRAINING.items() if c != "ja"}
    mixed = {1: ["de", "de", "en"], 2: ["fr", "ru", "fr"], 3: ["en"]}
    docs = frame(spark, DOCS, [(k, "\n\n".join(f"{part[c]}." for c in cs), None, None, None, None) for k, cs in mixed.items()] + [(4, "let a = 1;", None, None, None, None)])
    got = {r["doc_id"]: r["segments"] for r in language.identify(docs.select("doc_id", "text"), profiles).collect()}
    assert {k: [(s["lang"], s["sentences"]) for s in v] for k, v in got.items()} == {1: [("de", 2), ("en", 1)], 2: [("fr", 1), ("ru", 1), ("fr", 1)], 3: [("en", 1)], 4: []}
    assert all(0.5 < s["confidence"] <= 1 for v in got.values() for s in v)


def test_letters_beyond_sixteen_bits_are_their_own():
    one, other = (language.raw_grams([t]) for t in ("AAA", "\U00010041" * 3))
    assert not set(one.codes.tolist()) & set(other.codes.tolist())
    bundle = language.Letters().bind(np.array([[0x10041, 0x41, 0, 0], [0x41, 0x41, 0, 0]], np.uint32))
    assert abs(int(bundle[0].astype(int) @ bundle[1])) < 0.2 * language.DIMENSIONS


def test_one_group_of_copies_does_not_fill_the_training_sample(spark):
    data = [(i, TRAINING["de"], "de", None, None, None) for i in range(40)] + [(100 + i, t, c, None, None, None) for i, (c, t) in enumerate(TRAINING.items())]
    assert language.fit(frame(spark, DOCS, data), limit=5).codes == ("de", "en", "fr", "ja", "ru")


def test_labels(spark):
    data = {"en": "en", " EN ": "en", "en-GB": "en", "pt_BR": "pt", "deu": "de", "ger": "de", "Polish": "pl", "zh-Hans-CN": "zh", "": None, None: None, "und": None, "xx": None, "english please": None, "N/A": None}
    df = spark.createDataFrame([(k,) for k in data], "l string").select("l", language.label_of(F.col("l")).alias("c"))
    assert {r["l"]: r["c"] for r in df.collect()} == data


def test_decoding_parts_of_a_text(spark, bpe):
    ids = bpe.encode_word(" 漢字".encode())
    df = spark.createDataFrame([(ids[:1],), (ids[:2],), ([],), (None,), ([999_999],)], "ids array<int>").select(bpe.decode(F.col("ids")).alias("t"))
    got = [r["t"] for r in df.collect()]
    assert got[0].startswith(" ") and "�" in "".join(got[:2]) and got[2:] == ["", None, ""]
