"""Facts about repository-relative paths, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source languages by extension.
SOURCE_EXTENSIONS = (
    "ts tsx mts cts js jsx mjs cjs vue svelte astro c h cc cpp cxx hpp hh rs go zig java kt kts scala groovy cs fs "
    "py rb php pl lua r jl sh bash zsh ps1 ex exs erl hs ml clj elm swift m mm dart sol sql html css scss less tf"
).split()
# Languages whose indentation is syntax, by extension and by file name.
INDENTED_EXTENSIONS = (
    "py pyi pyw pyx pxd bzl star fs fsi fsx hs lhs elm purs idr scala sc nim nims mojo gd coffee litcoffee yaml yml "
    "haml pug jade slim sass styl mk mak make"
).split()
INDENTED_NAMES = "Makefile makefile GNUmakefile Makefile.am Makefile.in BUILD BUILD.bazel WORKSPACE WORKSPACE.bazel Tiltfile Snakefile SConstruct SConscript".split()
# Interface and schema languages.
CONTRACT_EXTENSIONS = "tsp proto graphql gql avsc thrift smithy".split()
CONTRACT_NAME = r"(?i)(\.schema\.json|^(openapi|asyncapi|swagger)\.(.+\.)?(ya?ml|json))$"
# Test suffixes of a stem and names of test directories.
TEST_SUFFIX = r"(\.test|\.spec|_test|_spec)$"
MIRRORED_DIRECTORIES = "test tests __tests__ spec specs e2e".split()
FIXTURE_DIRECTORIES = "fixtures __fixtures__".split()
SUPPORT_DIRECTORIES = "testing test-utils test-helpers __mocks__ mocks __snapshots__".split()
TEST_DIRECTORIES = [*MIRRORED_DIRECTORIES, *FIXTURE_DIRECTORIES, *SUPPORT_DIRECTORIES]


def name_of(path: Column) -> Column:
    """File name: what follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem_of(path: Column) -> Column:
    """Path without its extension; a leading dot of the name begins no extension."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def extension_of(path: Column) -> Column:
    """Extension in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def directories_of(path: Column) -> Column:
    """Names of the directories above a path, outermost first; empty at the root."""
    parts = F.split(path, "/", -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def directory_of(path: Column) -> Column:
    """Parent directory, empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_source(path: Column) -> Column:
    return extension_of(path).isin(SOURCE_EXTENSIONS)


def is_indentation_significant(path: Column) -> Column:
    return extension_of(path).isin(INDENTED_EXTENSIONS) | name_of(path).isin(INDENTED_NAMES)


def is_contract(path: Column) -> Column:
    return extension_of(path).isin(CONTRACT_EXTENSIONS) | name_of(path).rlike(CONTRACT_NAME)


def is_config(path: Column) -> Column:
    """``*.config.js`` and its kin."""
    return path.rlike(r"\.config\.[cm]?[jt]s$")


def is_test_file(path: Column) -> Column:
    """The stem ends in a test suffix."""
    return stem_of(path).rlike(TEST_SUFFIX)


def is_test(path: Column) -> Column:
    """Test code: a test file, or anything below a test directory; never a contract."""
    below = F.arrays_overlap(directories_of(path), F.array(*[F.lit(d) for d in TEST_DIRECTORIES]))
    return ~is_contract(path) & (is_test_file(path) | below)


def directory_distance(a: Column, b: Column) -> Column:
    """Directory hops between the parents of two paths: 0 in one directory, 2 for siblings."""
    x, y = directories_of(a), directories_of(b)
    pairs = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first_off = F.array_position(pairs, False)
    shared = F.when(first_off > 0, first_off - 1).otherwise(F.size(pairs))
    return (F.size(x) + F.size(y) - 2 * shared).cast("long")


def tested_stems(path: Column) -> Column:
    """Stems of the files that a test may test: beside it, and where its test directory mirrors the sources."""
    stem = stem_of(path)
    name = F.regexp_replace(stem, TEST_SUFFIX, "")
    has = stem.rlike(TEST_SUFFIX) & ~name.rlike(r"(^|/)$")
    parts = F.split(name, "/", -1)
    fixture = F.arrays_overlap(directories_of(name), F.array(*[F.lit(d) for d in FIXTURE_DIRECTORIES]))

    def mirrored(part: Column, i: Column) -> Column:
        head, tail = F.slice(parts, 1, i), F.slice(parts, i + 2, F.size(parts))
        roots = [F.array().cast("array<string>"), F.array(F.lit("src")), F.array(F.lit("lib"))]
        moved = F.array(*[F.array_join(F.concat(head, root, tail), "/") for root in roots])
        return F.when((i < F.size(parts) - 1) & part.isin(MIRRORED_DIRECTORIES), moved).otherwise(F.array().cast("array<string>"))

    elsewhere = F.when(fixture, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(parts, mirrored)))
    return F.when(has, F.concat(F.array(name), elsewhere)).otherwise(F.array().cast("array<string>"))


def is_test_pair(a: Column, b: Column) -> Column:
    """One path is the other's test, side by side or mirrored."""
    return F.array_contains(tested_stems(a), stem_of(b)) | F.array_contains(tested_stems(b), stem_of(a))


def ancestors_of(path: Column) -> Column:
    """All directories above a path, outermost first, the root as ``.``."""
    parts = directories_of(path)
    return F.concat(F.array(F.lit(".")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/")))


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ``**`` crosses directories, ``*`` and ``?`` do not; dot files match."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_pattern(g) for g in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + ("\\" + glob[i] if not (glob[i].isalnum() or glob[i] in "/_-") else glob[i]), i + 1
    return out


def matches_any(path: Column, globs: list[str]) -> Column:
    """The path equals one of the globs, or one of them matches it."""
    hit = F.lit(False)
    for glob in globs:
        hit = hit | ((path == glob) if not any(c in glob for c in "*?{[") else path.rlike(f"^{glob_pattern(glob)}$"))
    return hit
