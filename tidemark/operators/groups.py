"""Groups of areas: parts that changes touched as a whole, and groups that are not variants of each other."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PARTS, MAX_CANDIDATES = 1000, 500
OVERLAP = 0.8


def supported(group: Sequence[str], parts: Counter[frozenset[str]], least: int = 3, changes: int = 3) -> tuple[list[tuple[str, ...]], bool]:
    """Maximal parts of a group that ``changes`` changes touched in full, and whether a bound cut the search short.

    ``parts``: what each change touched of the group, with the number of such changes. Candidates
    are the parts and all their intersections of ``least`` members.
    """
    counts = {p: n for p, n in parts.items() if len(p) >= least}
    partial = len(counts) > MAX_PARTS
    counts = dict(sorted(counts.items(), key=lambda x: (-x[1], sorted(x[0])))[:MAX_PARTS])
    closed: set[frozenset[str]] = set()
    for part in counts:
        fresh = {part} | {part & c for c in closed if len(part & c) >= least}
        closed |= fresh
        if len(closed) > MAX_CANDIDATES:
            partial = True
            break
    support = {c: sum(n for p, n in counts.items() if c <= p) for c in closed}
    kept = [c for c, n in support.items() if n >= changes]
    order = {m: i for i, m in enumerate(group)}
    return sorted(tuple(sorted(c, key=order.__getitem__)) for c in kept if not any(c < other for other in kept)), partial


def maximal_parts(group: Sequence[str], parts: Counter[frozenset[str]], least: int = 3, changes: int = 3) -> list[tuple[str, ...]]:
    """Maximal parts of a group that ``changes`` changes touched in full, without a bound (see ``supported``).

    A search in depth for maximal frequent sets: members are bits, the members of every change
    at hand join at once, and a branch ends where all it could add is frequent together or lies in a set found before.
    """
    bit = {m: 1 << i for i, m in enumerate(group)}
    start = [(sum(bit[m] for m in p), n) for p, n in parts.items() if len(p) >= least]
    found: list[int] = []
    todo = [(0, start, [1 << i for i in range(len(group))])]
    while todo:
        head, rows, tail = todo.pop()
        total = sum(n for _, n in rows)
        if total < changes:
            continue
        counts = {x: sum(n for p, n in rows if p & x) for x in tail}
        head |= sum(x for x in tail if counts[x] == total)
        tail = sorted((x for x in tail if changes <= counts[x] < total), key=lambda x: (counts[x], x))
        whole = head | sum(tail)
        if whole.bit_count() < least or any(whole & f == whole for f in found):
            continue
        if sum(n for p, n in rows if p & whole == whole) >= changes:
            found.append(whole)
            continue
        branches = [(head | x, [(p, n) for p, n in rows if p & x], tail[i + 1 :]) for i, x in enumerate(tail)]
        # what is left of a head without further members comes last, after all that could hold it
        todo.extend(reversed([*branches, (head, [(p & head, n) for p, n in rows], [])]))
    return sorted(tuple(m for m in group if bit[m] & f) for f in found)


def distinct(groups: Iterable[tuple[tuple[str, ...], int]], linked: Callable[[str, str], bool]) -> list[tuple[tuple[str, ...], int]]:
    """Groups (members, joint changes) without those inside another, and without weaker variants of one.

    Variants: all pairs of both are linked, and they share all but one, or four fifths, of the
    larger one's members, whichever is fewer. The one with more joint changes stays, then the larger.
    """
    rows = [(frozenset(m), n, m) for m, n in groups]
    rows = [r for r in rows if not any(r[0] < o[0] for o in rows)]
    kept: list[tuple[frozenset[str], int, tuple[str, ...]]] = []
    for members, n, names in sorted(rows, key=lambda r: (-r[1], -len(r[0]), "\n".join(sorted(r[0])))):

        def variant(other: frozenset[str], members: frozenset[str] = members) -> bool:
            larger = max(len(members), len(other))
            if len(members & other) < min(larger - 1, math.ceil(OVERLAP * larger)):
                return False
            union = sorted(members | other)
            return all(linked(a, b) for i, a in enumerate(union) for b in union[i + 1 :])

        if not any(variant(k[0]) for k in kept):
            kept.append((members, n, names))
    return [(names, n) for _, n, names in kept]


def clique_groups(touched: DataFrame, pairs: DataFrame, min_shared: int = 3, min_share: float = 0.3) -> DataFrame:
    """``members, shared, partial``: cliques of areas, or the parts of them that changes touched as a whole, without variants.

    Cliques are searched by connected component, parts by clique, variants by component, each in
    its own task and without a bound, so ``partial`` is always false.
    """
    from tidemark.operators.graph import cliques_of, linked_areas

    links = linked_areas(pairs, min_shared, min_share)
    cliques = cliques_of(links).withColumn("k", F.array_join("members", "\n"))
    inside = cliques.select("k", F.explode("members").alias("area"))
    parts = touched.select("change_id", "area").distinct().join(inside, "area").groupBy("k", "change_id").agg(F.sort_array(F.collect_list("area")).alias("part")).where(F.size("part") >= 3)
    counts = parts.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).join(cliques, "k")

    def search(rows):
        import pyarrow as pa

        by = Counter(dict(zip(map(frozenset, rows["part"].to_pylist()), rows["n"].to_pylist(), strict=True)))
        groups = maximal_parts(rows["members"][0].as_py(), by, changes=min_shared)
        shared = [sum(n for p, n in by.items() if p.issuperset(g)) for g in groups]
        return pa.table({"component": pa.array([rows["component"][0].as_py()] * len(groups), pa.string()), "members": pa.array(groups, pa.list_(pa.string())), "shared": pa.array(shared, pa.int64())})

    def choose(rows, links):
        import pyarrow as pa

        pairs = set(zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True))
        linked = lambda a, b: (a, b) in pairs or (b, a) in pairs
        kept = distinct(zip(map(tuple, rows["members"].to_pylist()), rows["shared"].to_pylist(), strict=True), linked)
        return pa.table({"members": pa.array([m for m, _ in kept], pa.list_(pa.string())), "shared": pa.array([n for _, n in kept], pa.int64())})

    schema = "component string, members array<string>, shared long"
    groups = counts.groupBy("k").applyInArrow(search, schema).dropDuplicates(["members"])
    rows = groups.groupBy("component").cogroup(links.groupBy("component")).applyInArrow(choose, "members array<string>, shared long")
    return rows.withColumn("partial", F.lit(False))
