"""Module graphs: resolving imports, coupling, change impact, cycles and health."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import save


def with_module(rows: DataFrame, files: DataFrame, name: str = "module") -> DataFrame:
    """``rows`` with the module of their ``path``; ``src`` is part of it only in projects with ``src/__init__.py``."""
    packages = files.where("path = 'src/__init__.py'").select("project").distinct().withColumn("src_is_package", F.lit(True))
    kept = F.coalesce("src_is_package", F.lit(False))
    return rows.join(packages, "project", "left").withColumn(name, C.module_of(F.col("path"), kept)).drop("src_is_package")


def modules(files: DataFrame) -> DataFrame:
    return with_module(files.select("project", "path"), files).select("project", "path", "module").distinct()


def resolve(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports with the ``target`` module of the project: the module itself, a named submodule, or the longest known package.

    Relative imports are made absolute first. An import of something else has a
    null target. Every prefix is a key of an equi-join, so no import is compared
    with all modules.
    """
    known = modules(files)
    # ids come before the join, so that a second evaluation gives the same ones
    imports, own = with_module(imports.withColumn("id", F.monotonically_increasing_id()), files, "own_module"), F.col("own_module")
    parts = F.split(own, r"\.")
    is_package = F.col("path").endswith("__init__.py")
    depth = F.size(parts) - F.col("level") + is_package.cast("int")
    base = F.when(depth > 0, F.array_join(F.slice(parts, F.lit(1), depth), "."))
    full = F.when(~F.col("is_relative"), F.col("module")).otherwise(F.concat_ws(".", base, F.when(F.col("module") != "", F.col("module"))))
    rows = imports.select("project", "path", "line", "names", own.alias("source"), full.alias("wanted"), "id")
    named = F.transform("names", lambda n: F.struct(F.concat_ws(".", "wanted", n).alias("key"), (F.size(F.split("wanted", r"\.")) + 1).alias("depth")))
    above = F.transform(C.prefixes(F.col("wanted")), lambda p: F.struct(p.alias("key"), F.size(F.split(p, r"\.")).alias("depth")))
    keys = rows.where("wanted <> ''").select("project", "id", F.explode(F.concat(named, above)).alias("k"))
    hit = keys.select("project", "id", "k.*").join(known.select("project", F.col("module").alias("key"), F.col("path").alias("target_path")), ["project", "key"])
    best = hit.groupBy("id").agg(F.max(F.struct("depth", "key", "target_path")).alias("b")).select("id", F.col("b.key").alias("target"), F.col("b.target_path").alias("target_path"))
    return rows.join(best, "id", "left").select("project", "path", "line", F.col("source").alias("module"), "names", F.col("wanted").alias("imported"), "target", "target_path")


def edges_of(resolved: DataFrame) -> DataFrame:
    """Distinct ``src`` -> ``dst`` between modules of a project, without self loops."""
    return resolved.where("target is not null and target <> module").select("project", F.col("module").alias("src"), F.col("target").alias("dst")).distinct()


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fan-in ``ca``, fan-out ``ce``, ``instability``, ``hub`` and its grade for every node (``project, node``)."""
    into = edges.groupBy("project", F.col("dst").alias("node")).agg(F.countDistinct("src").alias("ca"))
    out = edges.groupBy("project", F.col("src").alias("node")).agg(F.countDistinct("dst").alias("ce"))
    both = nodes.join(into, ["project", "node"], "left").join(out, ["project", "node"], "left").na.fill(0, ["ca", "ce"])
    ca, ce = F.col("ca"), F.col("ce")
    instability = F.when(ca + ce > 0, ce / (ca + ce)).otherwise(0.0)
    return both.withColumn("instability", instability).withColumn("hub", ca * ce).withColumn("orphan", ca + ce == 0).withColumn("hub_grade", C.steps(-F.col("hub"), [(0, "A"), (-10, "B"), (-30, "C"), (-60, "D")], "F"))


def coupling_summary(metrics: DataFrame) -> DataFrame:
    """Modules and orphans over all; where the nodes have ``is_test``, the rest leaves test modules out (0 if there are no others)."""
    own = F.when(~F.col("is_test"), F.col("instability")) if "is_test" in metrics.columns else F.col("instability")
    metrics = metrics.withColumn("own", own)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return metrics.groupBy("project").agg(
        F.count(F.lit(1)).alias("modules"), count(F.col("orphan")).alias("orphans"), F.coalesce(F.avg("own"), F.lit(0.0)).alias("avg_instability"), F.coalesce(F.expr("percentile(own, 0.5)"), F.lit(0.0)).alias("median_instability"),
        count((F.col("own") == 0) & (F.col("ca") > 0)).alias("stable"), count((F.col("own") == 1) & (F.col("ce") > 0)).alias("unstable"),
    )


def import_health(metrics: DataFrame, cycles: DataFrame) -> DataFrame:
    """Score from cycles (``project, cycles``), orphans, instability and the share of the largest hub."""
    live = F.when(~F.col("orphan"), F.col("instability"))
    agg = metrics.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("orphan").cast("int")).alias("orphan_ratio"), F.coalesce(F.avg(live), F.lit(0.0)).alias("avg"), F.max("ca").alias("top"))
    hub = F.when(F.col("n") > 1, F.col("top") / (F.col("n") - 1)).otherwise(0.0)
    joined = agg.join(cycles, "project", "left").na.fill(0, ["cycles"])
    raw = 100 - F.least(15 * F.col("cycles"), F.lit(40)) - 20 * F.col("orphan_ratio") - 15 * F.col("avg") - 15 * hub
    return joined.select("project", F.col("n").alias("modules"), "cycles", C.clamped(C.half_even(raw)).cast("int").alias("score")).withColumn("grade", C.grade(F.col("score"), "imports"))


def impact(edges: DataFrame, changed: DataFrame, max_depth: int = 10) -> DataFrame:
    """Nodes that depend on the ``changed`` ones (``project, node``) with their least ``depth`` and ``parent`` (the least on ties).

    Breadth first over the reversed edges; each level is a saved table, so plans
    don't grow with the depth.
    """
    back = edges.select("project", F.col("dst").alias("node"), F.col("src").alias("next"))
    seen = frontier = save(changed.select("project", "node").distinct().select("project", "node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent")), "impact")
    for depth in range(1, max_depth + 1):
        reached = frontier.join(back, ["project", "node"]).groupBy("project", F.col("next").alias("node")).agg(F.lit(depth).alias("depth"), F.min("node").alias("parent"))
        frontier = save(reached.join(seen.select("project", "node"), ["project", "node"], "left_anti"), "impact")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def least_linked(links: DataFrame) -> DataFrame:
    """``project``, ``node`` and ``root``, the least node that links ``a`` -> ``b`` lead to, or itself; labels halve their distance each round.

    Nodes without a link of their own are left out.
    """
    labels = save(links.groupBy("project", F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = links.join(labels.select("project", F.col("node").alias("b"), "root"), ["project", "b"], "left").groupBy("project", F.col("a").alias("node")).agg(F.min(F.coalesce("root", "b")).alias("near"))
        least = labels.join(near, ["project", "node"]).select("project", "node", "root", F.least("root", "near").alias("low"))
        # a label's own label is as good: this is the shortcut
        jump = labels.select("project", F.col("node").alias("low"), F.col("root").alias("far"))
        after = save(least.join(jump, ["project", "low"], "left").select("project", "node", F.least("low", F.coalesce("far", "low")).alias("root"), F.col("root").alias("old")), "labels")
        labels = after.select("project", "node", "root")
        if after.where("root <> old").isEmpty():
            break
    return labels


def components(edges: DataFrame) -> DataFrame:
    """``project``, ``node`` and ``root``, the least node it is connected with."""
    return least_linked(save(edges.select("project", F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select("project", F.col("dst"), F.col("src"))).distinct(), "links"))


#: Edges that a task searches for cycles at once; this bounds its memory.
AT_ONCE = 200_000


def strong(src: np.ndarray, dst: np.ndarray, n: int) -> list[int]:
    """The least node of the strongly connected component of each of the nodes 0 to ``n - 1``."""
    order = np.argsort(src, kind="stable")
    after, ends = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    turn, number, low, on, root, stack, seen = ends[:], [0] * n, [0] * n, bytearray(n), [0] * n, [], 0
    for start in range(n):
        work = [] if number[start] else [start]
        while work:
            node = work[-1]
            if not number[node]:
                seen += 1
                number[node] = low[node] = seen
                on[node] = 1
                stack.append(node)
            while turn[node] < ends[node + 1]:
                nxt = after[turn[node]]
                turn[node] += 1
                if not number[nxt]:
                    work.append(nxt)
                    break
                if on[nxt]:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1]] = min(low[work[-1]], low[node])
                if low[node] == number[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on[group[-1]] = 0
                    least = min(group)
                    for member in group:
                        root[member] = least
    return root


def contracting(at_once: int):
    """A function of edges that searches ``at_once`` at a time, or less than twice as many.

    It gives ``project, a, b, merged``: nodes on a cycle with its least node, and edges that are on no cycle of these.
    """

    def search(held: list[pd.DataFrame]) -> pd.DataFrame:
        edges = pd.concat(held, ignore_index=True)
        owner, projects = pd.factorize(edges["project"])
        code, names = pd.factorize(pd.concat([edges["src"], edges["dst"]], ignore_index=True), sort=True)
        # sorted, so that the least number is the least node
        number, keys = pd.factorize(np.tile(owner, 2) * len(names) + code, sort=True)
        src, dst = np.split(number, 2)
        root = np.array(strong(src, dst, len(keys)))
        node = np.flatnonzero(np.bincount(root, minlength=len(keys))[root] > 1)
        name = lambda n: np.asarray(names)[keys[n] % len(names)]
        merged = pd.DataFrame({"project": np.asarray(projects)[keys[node] // len(names)], "a": name(node), "b": name(root[node]), "merged": True})
        apart = edges[root[src] != root[dst]]
        return pd.concat([merged, pd.DataFrame({"project": apart["project"], "a": apart["src"], "b": apart["dst"], "merged": False})])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), at_once):
                held.append(batch.iloc[at : at + at_once])
                n += len(held[-1])
                if n >= at_once:
                    yield search(held)
                    held, n = [], 0
        if held:
            yield search(held)

    return each


def with_root(edges: DataFrame, roots: DataFrame, end: str, name: str) -> DataFrame:
    """``edges`` with the root of one end; a node without any is its own."""
    return edges.join(roots.select("project", F.col("node").alias(end), F.col("root").alias(name)), ["project", end], "left").withColumn(name, F.coalesce(name, end))


def merge(members: DataFrame | None, pairs: DataFrame, edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """``members`` (``project, node, root``) with the ``pairs`` found of the same columns, and the ``edges`` between roots."""
    roots = save(pairs.groupBy("project", "node").agg(F.min("root").alias("root"), F.max("root").alias("last")), "roots")
    if roots.isEmpty():
        return members, edges
    # a node searched by two tasks can have two roots, which are on one cycle then
    torn = pairs.join(roots.where("root <> last").select("project", "node", F.col("root").alias("least")), ["project", "node"]).where("root <> least")
    linked = with_root(with_root(edges, roots, "src", "s"), roots, "dst", "d").where("s <> d").select("project", F.col("s").alias("src"), F.col("d").alias("dst"))
    edges = linked.unionAll(torn.select("project", "root", "least")).unionAll(torn.select("project", "least", "root")).distinct()
    roots = roots.select("project", "node", "root")
    if members is not None:
        further = roots.select("project", F.col("node").alias("root"), F.col("root").alias("to"))
        roots = members.join(further, ["project", "root"], "left").select("project", "node", F.coalesce("to", "root").alias("root")).unionAll(roots.join(members, ["project", "node"], "left_anti"))
        roots = save(roots, "members")
    return roots, edges


def split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole components as ``project, node, root``, and the edges whose ends may share another one.

    Nodes of one component lead to the same least node and, within those that
    do, are led to from the same one; where both are one node, it is on a cycle
    with them.
    """
    ahead = least_linked(save(edges.select("project", F.col("src").alias("a"), F.col("dst").alias("b")), "links"))
    alike = save(with_root(with_root(edges, ahead, "src", "ahead"), ahead, "dst", "other").where("ahead = other").drop("other"), "links")
    behind = least_linked(alike.select("project", F.col("dst").alias("a"), F.col("src").alias("b")))
    both = save(with_root(with_root(alike, behind, "src", "s"), behind, "dst", "d"), "links")
    ends = both.select("project", F.col("src").alias("node"), F.col("s").alias("root"), "ahead").unionAll(both.select("project", "dst", "d", "ahead")).where("root = ahead").distinct()
    found = ends.where("node <> root").select("project", "node", "root")
    return found.unionAll(found.select("project", "root", "root").distinct()), both.where("s = d and s <> ahead").select("project", "src", "dst")


def cycle_members(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Nodes on a cycle, with the least node of their strongly connected component.

    Each task searches ``at_once`` edges at a time and contracts the cycles
    among them, until what is left fits into one search. Where this doesn't
    halve the edges, as with long ways without cycles, nodes with no way in or
    out go, and the rest is split by reachability.
    """
    now = save(edges.where("src <> dst and project is not null").select("project", "src", "dst").distinct(), "edges")
    kind, size, members = edges.schema["src"].dataType.simpleString(), now.count(), None
    while size:
        near = now.coalesce(1) if size <= at_once else now.repartitionByRange(math.ceil(size / at_once), "project", "src", "dst").sortWithinPartitions("project", "src", "dst")
        found = save(near.mapInPandas(contracting(at_once), f"project string, a {kind}, b {kind}, merged boolean"), "found")
        members, now = merge(members, found.where("merged").select("project", F.col("a").alias("node"), F.col("b").alias("root")), found.where("not merged").select("project", F.col("a").alias("src"), F.col("b").alias("dst")))
        if size <= at_once:
            break
        now = save(now, "edges")
        left = now.count()
        if left > max(at_once, size // 2):
            now = now.join(now.select("project", F.col("dst").alias("src")).distinct(), ["project", "src"], "left_semi")
            now = save(now.join(now.select("project", F.col("src").alias("dst")).distinct(), ["project", "dst"], "left_semi").select("project", "src", "dst"), "edges")
            left = now.count()
        if left > max(at_once, size // 2):
            pairs, now = split(now)
            members, now = merge(members, pairs, now)
            now = save(now, "edges")
            left = now.count()
        size = left
    if members is None:
        return now.select("project", F.col("src").alias("node"), F.col("src").alias("component"), F.lit(1).alias("size")).where(F.lit(False))
    sizes = members.groupBy("project", "root").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return members.join(sizes, ["project", "root"]).select("project", "node", F.col("root").alias("component"), "size")


def external_packages(resolved: DataFrame) -> DataFrame:
    """Packages from outside with the number of modules that import them."""
    outside = resolved.where("target is null and imported is not null and imported not in ('', '__future__')")
    return outside.groupBy("project", F.substring_index("imported", ".", 1).alias("package")).agg(F.countDistinct("module").alias("modules"), F.sort_array(F.collect_set("module")).alias("imported_by"))


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows of each project."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where(F.col("place") <= n)
