"""Graphs as edge tables: components, bounded reach, and cliques of small graphs."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component``: nodes of the edges with the smallest node they are connected to.

    Alternates large-star and small-star steps, whose number grows with the logarithm of the
    longest path; every round is written to the checkpoint folder, which cuts the lineage and
    survives lost executors. A hot node's edges are grouped by map-side minima, never gathered.
    Null ends and loops are left out. Fails if ``rounds`` do not suffice.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    now = durable(now)
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u to the smallest of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: all smaller neighbours of u, and u, to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = durable(now)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def reach(edges: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """``start, node, hops``: nodes within ``depth`` directed hops, by their least number of hops; the start itself is left out."""
    one = edges.select(F.col(src).alias("start"), F.col(dst).alias("node")).where("start <> node").distinct()
    steps = one.select(F.col("start").alias("via"), F.col("node").alias("next"))
    seen = one.withColumn("hops", F.lit(1))
    frontier = seen
    for hop in range(2, depth + 1):
        new = frontier.join(steps, frontier["node"] == steps["via"]).select("start", F.col("next").alias("node")).where("start <> node").distinct()
        frontier = new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def maximal_cliques(links: Iterable[tuple[str, str]], least: int = 3, most: int | None = None) -> tuple[list[tuple[str, ...]], bool]:
    """Maximal cliques of a graph, sorted, and whether ``most`` steps cut the search short; without it the search is exact.

    Each node starts a search among the neighbours after it, nodes of few neighbours first
    (degeneracy order), so the work follows the cliques and not the size of a sparse graph.
    """
    near: dict[str, set[str]] = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found: list[tuple[str, ...]] = []
    steps = 0
    done: set[str] = set()
    for start in _degeneracy(near):
        todo: list[tuple[tuple[str, ...], set[str], set[str]]] = [((start,), near[start] - done, near[start] & done)]
        done.add(start)
        while todo:
            clique, open_, closed = todo.pop()
            steps += 1
            if most is not None and steps > most:
                return sorted(found), True
            if not open_:
                if not closed and len(clique) >= least:
                    found.append(tuple(sorted(clique)))
                continue
            if len(clique) + len(open_) < least:
                continue
            pivot = max(sorted(open_ | closed), key=lambda n: len(near[n] & open_))
            for n in sorted(open_ - near[pivot]):
                todo.append(((*clique, n), open_ & near[n], closed & near[n]))
                open_ = open_ - {n}
                closed = closed | {n}
    return sorted(found), False


def _degeneracy(near: dict[str, set[str]]) -> list[str]:
    """Nodes in the order of always taking one with the fewest neighbours left."""
    left = {n: len(near[n]) for n in near}
    heap = [(k, n) for n, k in left.items()]
    heapq.heapify(heap)
    order = []
    while heap:
        k, n = heapq.heappop(heap)
        if left.get(n) != k:
            continue
        del left[n]
        order.append(n)
        for m in near[n]:
            if m in left:
                left[m] -= 1
                heapq.heappush(heap, (left[m], m))
    return order


def linked_areas(pairs: DataFrame, min_shared: int = 3, min_share: float = 0.3) -> DataFrame:
    """``a, b, component``: links of areas (shared changes, share of the smaller) with their connected component."""
    linked = durable(pairs.where((F.col("shared") >= min_shared) & (F.col("shared") >= min_share * F.least("changes_a", "changes_b"))).where("a <> b").select("a", "b"))
    parts = components(linked).select(F.col("node").alias("a"), "component")
    return durable(linked.join(parts, "a").select("a", "b", "component"))


def cliques_of(links: DataFrame, least: int = 3) -> DataFrame:
    """``component, members``: all maximal cliques of links with their component, each component searched in its own task."""

    def search(rows):
        import pyarrow as pa

        cliques, _ = maximal_cliques(zip(rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True), least)
        return pa.table({"component": pa.array([rows["component"][0].as_py()] * len(cliques), pa.string()), "members": pa.array(cliques, pa.list_(pa.string()))})

    return durable(links.groupBy("component").applyInArrow(search, "component string, members array<string>"))


def area_cliques(pairs: DataFrame, min_shared: int = 3, min_share: float = 0.3, least: int = 3) -> DataFrame:
    """``members, size, partial``: groups of areas of which all pairs are linked (shared changes, share of the smaller).

    ``pairs``: a, b, shared, changes_a, changes_b of areas. The search has no bound, so ``partial`` is always false.
    """
    found = cliques_of(linked_areas(pairs, min_shared, min_share), least)
    return found.select("members", F.size("members").cast("long").alias("size"), F.lit(False).alias("partial"))
