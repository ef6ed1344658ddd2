"""Source files that nobody wrote by hand here: generated, packed, compiled, third-party, data.

A multi-pattern automaton runs once over the head of each file; the places of its matches
say which rules to ask. A notice counts in the leading comment only, and by its structure:
it must say of this file that a tool made it, or that something was made and that hands are
to be kept off. A licence counts together with the name and version of what was copied in.
Path rules cover vendored directories, build output, lock files and minified names; line
structure covers packed code, data kept as code and code stamped out by running number.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that the automaton looks for, in lower case, by the rule they ask for.
MADE = (
    "generated",
    "machine-written",
    "machine written",
    "produced by",
    "produced from",
    "produced with",
    "emitted by",
    "emitted from",
    "compiled by",
    "compiled from",
    "transpiled by",
    "transpiled from",
    "rendered from",
    "exported by",
    "exported from",
    "written by a tool",
    "automatically written",
    "automatically created",
    "created automatically",
    "output of",
    "erzeugt",
    "generiert",
    "généré",
    "generado",
    "generada",
    "gerado",
    "gerada",
    "generato",
    "gegenereerd",
    "wygenerowan",
    "сгенерирован",
    "создан автоматически",
    "自動生成",
    "自动生成",
)
LICENCE = ("license", "licence", "copyright", "(c)", "©", "@preserve", "redistribution", "permission is hereby granted", "all rights reserved")
COPIED = ("vendored from", "copied from", "copied verbatim", "imported from", "taken from", "downloaded from", "upstream:")
COMPILED = (
    "sourcemappingurl=",
    "exports.__esmodule",
    "exports.__esm",
    'exports, "__esmodule"',
    "exports, '__esmodule'",
    "= (this && this.__",
    "__webpack_require__",
    "webpackbootstrap",
    "_interoprequiredefault(",
    "_interoprequirewildcard(",
    "_classcallcheck(",
    "regeneratorruntime.",
    "parcelrequire",
    "system.register([",
)
_PHRASES = {"made": MADE, "licence": LICENCE, "copied": COPIED, "compiled": COMPILED}

# Directories, names and suffixes.
VENDORED = r"(^|/)(vendor|third_party|third-party|thirdparty|_vendor|deps|node_modules|bower_components|extern|jspm_packages|Pods|Godeps)/"
OUTPUT = r"(^|/)(dist|out|build|generated|__generated__|autogen|__pycache__)/"
MADE_NAME = r"\.(gen|generated|g)\.\w+$|_generated\.\w+$|\.pb\.\w+$|\.pb\.gw\.go$|_pb2(_grpc)?\.pyi?$|\.designer\.cs$|\.bundle\.\w+$|\.chunk\.\w+$|\.map$"
MINIFIED_NAME = r"[.-]min\.\w+$|-[0-9a-f]{8,}\.(js|mjs|css)$|\.[0-9a-f]{8,}\.(js|mjs|css)$"
VERSIONED_NAME = r"(^|/)[A-Za-z][A-Za-z0-9.]*[-_.]v?\d+\.\d+(\.\d+)+([-.]\w+)*\.(js|mjs|cjs|css|py|go|ts)$"
LOCK_FILE = r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|Pipfile\.lock|composer\.lock|Gemfile\.lock|go\.sum|uv\.lock|flake\.lock)$"

#: Mean characters a line, without comments, from which a head counts as packed; and bytes a line of the whole file.
PACKED_LINE = PACKED_BYTES = 250
#: Share of lines that are literals only, from which a file counts as data; and lines at least.
DATA_SHARE, DATA_LINES = 0.7, 5
#: Share of lines that repeat one shape with a running number, from which a file counts as generated; and lines of a shape at least.
STAMPED_SHARE, STAMPED_LINES = 0.6, 8

_LINE = re.compile(r"\r\n|\r|\n")
_COMMENT = re.compile(r"\s*(//+!?|#(?!\w)|/\*+!?|\*+/?|--|;+|<!--|\"\"\"|''')")
_BLANK = re.compile(r"\s*$|\s*['\"]use strict['\"];?\s*$|#!")
_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`")
_NOTE = re.compile(r"/\*.*?\*/|(?<!:)//.*$|^\s*#.*$")
_LITERAL = re.compile(r"""\s*(?:[\[{(]\s*)*(?:(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?)|true|false|null|None|nil)\s*[\]})]*\s*[:,]?\s*[\[{(]*\s*)+[\]})]*\s*[,;]?\s*$|\s*[\]})]+[,;]*\s*$""")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'|“[^”]*”|`[^`]*`")
_NUMBER = re.compile(r"\d+")

# A notice, by structure: what was made, of which thing it is said, and whether hands are to be kept off.
_VERB = r"(?:(?:auto|machine|tool|computer)?[- ]?generated|machine[- ]written|(?:produced|emitted|compiled|transpiled|rendered|exported) (?:by|from|with)|written by a tool|automatically (?:written|created)|created automatically|output of|erzeugt|generiert|généré|generad[oa]|gerad[oa]|generato|gegenereerd|wygenerowan\w*|сгенерирован\w*|создан автоматически|自動生成|自动生成)"
_THING = r"(?:file|module|code|source(?: code)?|document|script|class|package|unit|contents?)"
_SELF = rf"(?:(?:this|the (?:following|present|contained))\s+(?:[\w-]+\s+){{0,2}}?{_THING}|diese(?:r|s)?\s+(?:datei|quelltext|modul)|ce(?:t)?\s+(?:fichier|module)|est[ea]\s+(?:archivo|fichero|arquivo|ficheiro|código)|questo\s+(?:file|modulo)|dit\s+bestand|ten\s+plik|этот\s+файл|このファイル|(?:此|本)文件)"
_IS = r"(?:is|was|were|has\s+been|gets|wurde|wird|a\s+été|est|fue|ha\s+sido|foi|è\s+stato|is|werd|został|был|は|由)"
_SAYS = re.compile(
    rf"{_SELF}\s*{_IS}\s+(?:an?\s+|the\s+)?(?:[\w.,/-]+\s+){{0,3}}?{_VERB}|(?:diese|ce|este?a?|questo|dit|ten|этот)\s+\w+\s+{_IS}\s+(?:\S+\s+){{0,6}}?{_VERB}|(?:このファイル|此文件|本文件)\S*?(?:自動生成|自动生成)"
    rf"|this\s+is\s+(?:an?\s+|the\s+)?(?:[\w-]+\s+){{0,2}}?{_VERB}|{_VERB}\s+(?:[\w.-]+\s+){{0,2}}?this\s+{_THING}\b",
    re.IGNORECASE,
)
_STARTS = re.compile(
    rf"\W*(?:(?:warning|note|notice|attention|important|caution)\W+)?(?:(?:code|file|source|module|fully|automatically|programmatically|automatisch|automatiquement|automáticamente|automaticamente|автоматически)\s+){{0,2}}{_VERB}"
    rf"(?:\s+(?:{_THING}(?=\s*(?:$|[^\w\s]))|(?:by|from|with|using|via|on|at|automatically|aus|von|mit|par|de|à|por|desde|da|con|door|uit|przez|z|из|с)\b|\S+\s+v?\d)|\W*$|\s*[-–—.,;:!>(<]|(?<=output of)\s)",
    re.IGNORECASE,
)
_MARKED = re.compile(r"<auto-?generated|@(?:auto-?)?generated\b|@partially-generated\b", re.IGNORECASE)
_HANDS_OFF = re.compile(
    r"(?:do\s+not|don't|never|must\s+not(?:\s+be)?|not\s+be|should\s+not(?:\s+be)?)\s+(?:manually\s+)?(?:edit|modify|change|touch|alter)(?:ed|ied)?\s*(?:$|[^\w\s]|(?:it|this|by\s+hand|manually|directly|here|any)\b)"
    r"|(?:changes|edits|modifications|edited\s+lines)\b[^.;]{0,50}\b(?:overwritten|lost|discarded|undone|reverted|vanish)|edit\s+(?:\S+\s+){1,4}?instead|instead\s+of\s+(?:editing|changing)|\bregenerate\b|\bre-?run\b|any\s+(?:change|edit)s?\b[^.;]{0,40}\b(?:lost|overwritten)"
    r"|nicht\s+(?:bearbeiten|ändern|editieren)|ne\s+pas\s+(?:modifier|éditer)|no\s+(?:editar|modificar)|não\s+(?:editar|edite|modificar)|non\s+modificare|niet\s+(?:bewerken|aanpassen)|nie\s+(?:edytować|edytuj)|не\s+(?:редактировать|изменять)|編集しない|请勿(?:编辑|修改)|不要(?:编辑|修改)",
    re.IGNORECASE,
)
_SENTENCE = re.compile(r"[.;:!?。；！]+(?:\s+|$)|\s+[-–—|]\s+|\n")

# A third-party header, by structure: a licence or copyright, and the name and version of what was copied.
_LICENCE_NAME = re.compile(r"spdx-license-identifier:[^\n]*|licen[cs]es?/\S*|licen[cs]e,?\s+v(?:ersion)?\.?\s*[\d.]+|(?:under|by)\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?[\w.+-]+(?:\s+v?[\d.]+)?(?:\s+licen[cs]e)?(?:,?\s+v(?:ersion)?\.?\s*[\d.]+)?", re.IGNORECASE)
_VERSION = re.compile(r"[\w@/.-]*[A-Za-z][\w@/.-]*[ \t]*[-–:,|@]?[ \t]*(?:version|release|rev\.?|build)?[ \t]*\bv?\d+\.\d+\.\d+|\bv\d+\.\d+|(?:version|release)[ \t:]+\d+\.\d+|https?://\S+?[/@v-]\d+\.\d+", re.IGNORECASE)
_SOURCE = re.compile(r"https?://|\b\d+\.\d+|\b[0-9a-f]{7,40}\b|\b[\w-]+/[\w-]+\b|\b(?:npm|pypi|crates|github|gitlab)\b", re.IGNORECASE)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, phrases in _PHRASES.items():
        for phrase in phrases:
            automaton.add_word(phrase, (len(phrase), kind))
    automaton.make_automaton()
    return automaton


def _lowered(text: str) -> str:
    """Lower case, letter by letter, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def header_of(lines: list[str]) -> int:
    """Number of leading lines that are comments, blank or a strict-mode mark."""
    open_block: str | None = None
    for i, line in enumerate(lines):
        stripped = line.strip()
        if open_block:
            if open_block in stripped:
                open_block = None
            continue
        m = _COMMENT.match(line)
        if m is None and not _BLANK.match(line):
            return i
        if m and m[1].startswith("/*") and "*/" not in stripped[2:]:
            open_block = "*/"
        elif m and m[1] in ('"""', "'''") and m[1] not in stripped[3:]:
            open_block = m[1]
    return len(lines)


def generated_notice(lines: list[str]) -> bool:
    """Whether a leading comment, line by line and without its marks, says that a tool made this file."""
    plain = [_QUOTED.sub(" ", line) for line in lines]
    whole = " ".join(plain)
    if _MARKED.search(whole) or _SAYS.search(whole):
        return True
    sentences = [x for line in plain for x in _SENTENCE.split(line) if x.strip()]
    if any(map(_STARTS.match, sentences)):
        return True
    return bool(_HANDS_OFF.search("\n".join(plain))) and bool(re.search(_VERB, whole, re.IGNORECASE))


def copied_notice(lines: list[str], licence: bool) -> bool:
    """Whether a leading comment names what was copied in: a licence with a name and version, or a source it was taken from."""
    if licence and _VERSION.search(_LICENCE_NAME.sub(" ", "\n".join(lines))):
        return True
    return any(any(p in line.lower() for p in COPIED) and _SOURCE.search(line) for line in lines)


def stamped(lines: list[str]) -> bool:
    """Whether most lines repeat few shapes whose number runs on by one step, as templates in a loop do."""
    shapes: dict[str, list[int]] = {}
    words = 0
    for line in lines:
        if any(c.isalnum() for c in line):
            words += 1
            if m := _NUMBER.search(line):
                shapes.setdefault(_NUMBER.sub("#", line.strip()), []).append(int(m[0][:18]))
    running = 0
    for numbers in shapes.values():
        if len(numbers) >= STAMPED_LINES:
            steps = [b - a for a, b in zip(numbers, numbers[1:], strict=False)]
            step = max(set(steps), key=steps.count)
            if step and steps.count(step) >= 0.8 * len(steps):
                running += len(numbers)
    return running > 0 and running >= STAMPED_SHARE * words


def reason_of(text: str | None) -> str | None:
    """Why a file's head shows that it was not written by hand here: generated, compiled, third party, packed, data; else None."""
    if not text or text.isspace():
        return None
    ends = [m.span() for m in _LINE.finditer(text)]
    starts = [0, *(e for _, e in ends)]
    lines = [text[a:b] for a, b in zip(starts, [*(b for b, _ in ends), len(text)], strict=True)]
    head = header_of(lines)
    asked = set()
    for end, (n, kind) in _automaton().iter(_lowered(text)):
        k = bisect_right(starts, end - n + 1) - 1
        if kind != "compiled":
            if k < head:
                asked.add(kind)
        elif _helper(lines[k], text[end - n + 1 : end + 1], k < head):
            return "compiled"
    header = [_bare(x) for x in lines[:head]] if asked else []
    if "made" in asked and generated_notice(header):
        return "generated"
    if asked & {"licence", "copied"} and copied_notice(header, "licence" in asked):
        return "third party"
    code = [c for line in lines if (c := _NOTE.sub("", line).strip())]
    short = [_STRING.sub('""', c) for c in code]
    if _mean(short) >= PACKED_LINE:
        return "packed"
    body = [line for line in lines if line.strip() and not _COMMENT.match(line)]
    if len(body) >= DATA_LINES:
        # the head may end within a line
        literal = sum(bool(_LITERAL.match(line)) for line in body[:-1])
        if literal >= DATA_SHARE * (len(body) - 1):
            return "data"
        if stamped(body[:-1]):
            return "generated"
    # long strings on most lines: a bundle of texts, not one long string among code
    if len(code) >= 2 and sum(len(c) >= PACKED_LINE for c in code) * 2 > len(code):
        return "packed"
    return None


def _mean(lines: list[str]) -> float:
    total = sum(map(len, lines))
    return total / len(lines) if total >= PACKED_LINE else 0.0


def _helper(line: str, phrase: str, leading: bool) -> bool:
    """Whether a compiler's mark stands where a compiler writes it: a source map in a comment of its own, a helper in code."""
    if "sourcemapping" in phrase.lower():
        return bool(re.match(r"\s*(?://|/\*)\s*[#@]\s*sourceMappingURL=", line, re.IGNORECASE))
    return not leading and not _COMMENT.match(line) and phrase in _QUOTED.sub(lambda m: m[0] if len(m[0]) < 14 else " ", line)


def _bare(line: str) -> str:
    """A comment line without its marks."""
    return re.sub(r"^\s*(?://+!?|#+|/\*+!?|\*+/?|--|;+|<!--|\"\"\"|''')\s*|\s*(?:\*/|-->|\"\"\"|''')\s*$", "", line)


def origins(texts: DataFrame, file_stats: DataFrame, item: str = "item", text: str = "text") -> DataFrame:
    """``path, reason``: one row per distinct non-null path of ``texts``; reason null for hand-written files.

    Path rules come first, then the head of the file, then the bytes a line of the whole file
    (``n_bytes`` of ``texts`` over ``loc`` of ``file_stats``). A path with several
    texts counts if one of them does. Null and blank texts are judged by path and size alone.
    """
    rows = texts.select(F.col(item).alias("path"), F.col(text).alias("text"), "n_bytes").where(F.col("path").isNotNull()).distinct()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").to_pylist()
            why = pa.array([reason_of(t) for t in column], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("n_bytes"), why], ["path", "n_bytes", "content"])

    judged = rows.mapInArrow(judge, "path string, n_bytes long, content string")
    by_path = (
        F.when(F.col("path").rlike(VENDORED) | F.col("path").rlike(VERSIONED_NAME), "third party")
        .when(F.col("path").rlike(OUTPUT) | F.col("path").rlike(MADE_NAME), "generated")
        .when(F.col("path").rlike(MINIFIED_NAME), "packed")
        .when(F.col("path").rlike(LOCK_FILE), "data")
    )
    lengths = file_stats.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("loc").alias("loc"))
    dense = F.when((F.col("n_bytes") >= PACKED_BYTES * F.col("loc")) & (F.col("loc") > 0), "packed")
    reason = F.coalesce(by_path, F.col("content"), dense)
    return judged.join(lengths, "path", "left").groupBy("path").agg(F.min(reason).alias("reason"))


def foreign_files(texts: DataFrame, file_stats: DataFrame) -> DataFrame:
    """``path``: files that are tool output, packed, copied in or data; see :func:`origins`."""
    return origins(texts, file_stats).where(F.col("reason").isNotNull()).select("path")
