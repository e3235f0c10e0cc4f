"""Parent-child links to full hierarchies.

Links are cut into ranges of at most TASK_ROWS rows. Each range builds a weighted disjoint-set forest: every node points
at its local root and holds its distance (offset) to it. Local roots whose parent lies in another range form a smaller
graph of the same kind, which is merged level by level until one task holds it, or until its chains, halved at each
level, have ended. Paths follow from an index of each range's parents and the prefixes of the local roots.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TASK_ROWS, cut, gather, parallelism

TREE, ON_CYCLE, BELOW_CYCLE, DANGLING = "tree", "in_cycle", "below_cycle", "dangling"


def forest(ids: np.ndarray, parents: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted disjoint-set forest of one range: index of the parent (-1: not here), of the local root, offset to it, state.

    State 0: under a local root; 1: on a cycle; 2: its parents lead into one. Paths are compressed for all nodes at once.
    """
    n = len(ids)
    at = pd.Index(ids).get_indexer(parents) if n else np.empty(0, np.int64)
    up = np.where(at >= 0, at, np.arange(n))
    off = np.where(at >= 0, 1 if weights is None else weights, 0).astype(np.int64)
    for _ in range(max(1, n).bit_length() + 1):
        beyond = up[up]
        if (beyond == up).all():
            break
        off, up = off + off[up], beyond
    looped = at[up] >= 0 if n else np.empty(0, bool)
    state = np.where(looped, 2, 0)
    state[np.unique(up[looped])] = 1
    return at, up, off, state


def _nodes(links: DataFrame, node: str, parent: str, extra: list[str]) -> DataFrame:
    keep = [F.max(c).alias(f"x_{c}") for c in extra]
    return links.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("string").alias("id")).agg(F.max(F.col(parent).cast("string")).alias("parent"), *keep)


def _ranges(df: DataFrame, rows: int, key: str, task_rows: int) -> DataFrame:
    parts = max(1, math.ceil(rows / task_rows))
    if parts == 1 and rows < task_rows // 8:
        return df.coalesce(1)
    return df.repartitionByRange(max(parts, min(parallelism(df.sparkSession), rows * 8 // task_rows)), F.length(key), key)


def _label(nodes: DataFrame, rows: int, task_rows: int, paths: bool) -> DataFrame:
    """Adds lroot, off, lstate, top_parent (parent of the local root where that isn't here) and, if asked, lpath."""

    def local(batches):
        pdf = gather(batches)
        if pdf is None:
            return
        ids, parents = pdf["id"].to_numpy(object), pdf["parent"].to_numpy(object)
        at, up, off, state = forest(ids, parents)
        pdf["lroot"], pdf["off"], pdf["lstate"] = ids[up], off, state.astype(np.int32)
        top = parents[up]
        pdf["top_parent"] = pd.Series(np.where(state == 0, top, None), dtype=object).where(lambda s: s.notna(), None)
        if paths:
            found: list = [None] * len(ids)
            for i in np.argsort(off, kind="stable"):
                if state[i] == 0:
                    found[i] = [ids[i]] if at[i] < 0 else [*found[at[i]], ids[i]]
            pdf["lpath"] = found
        for k in range(0, len(pdf), 20_000):
            yield pdf.iloc[k : k + 20_000]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    schema += ", lroot string, off bigint, lstate int, top_parent string" + (", lpath array<string>" if paths else "")
    return _ranges(nodes, rows, "id", task_rows).mapInPandas(local, schema)


def _resolve(edges: DataFrame, task_rows: int, level: int = 0) -> DataFrame:
    """edges (r, t, w) -> (r, top, dist, looped): where the chain of r ends, among the t that are no r."""
    edges = cut(edges)
    rows = edges.count()
    single = rows <= task_rows

    def local(batches):
        pdf = gather(batches)
        if pdf is None:
            return
        r, t, w = pdf["r"].to_numpy(object), pdf["t"].to_numpy(object), pdf["w"].to_numpy(np.int64)
        _, up, off, state = forest(r, t, w)
        yield pd.DataFrame({"r": r, "lr": r[up], "top": t[up], "off": off, "dist": off + w[up], "looped": state > 0})

    schema = "r string, lr string, top string, off bigint, dist bigint, looped boolean"
    labelled = (edges.coalesce(1) if single else _ranges(edges, rows, "r", task_rows)).mapInPandas(local, schema)
    if single:
        return labelled.select("r", "top", "dist", "looped")
    labelled = cut(labelled)
    if level >= 2 * math.ceil(math.log2(rows + 2)):  # every chain without a cycle has ended by now
        return labelled.select("r", "top", "dist", F.lit(True).alias("looped"))
    target = labelled.select(F.col("r").alias("top"), F.col("lr").alias("t"), F.col("off").alias("more"), F.col("looped").alias("caught"))
    roots = labelled.where((F.col("r") == F.col("lr")) & ~F.col("looped")).select(F.col("lr").alias("r"), "top", "dist")
    links = cut(roots.join(target, "top").select("r", "t", (F.col("dist") + F.col("more")).alias("w"), "caught"))
    free = links.where(~F.col("caught")).select("r", "t", "w")
    twice = free.join(free.select(F.col("r").alias("t"), F.col("t").alias("t2"), F.col("w").alias("w2")), "t", "left")
    upper = _resolve(twice.select("r", F.coalesce("t2", "t").alias("t"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")), task_rows, level + 1)
    upper = upper.unionByName(links.where("caught").select("r", F.col("t").alias("top"), F.col("w").alias("dist"), F.lit(True).alias("looped")))
    # a chain merged above ends at a local root: its own end follows from that root's row, looped where that one is
    last = labelled.where("r = lr").select(F.col("r").alias("top"), F.col("top").alias("end"), F.col("dist").alias("rest"), F.col("looped").alias("bent"))
    into = links.where("caught").select(F.col("r").alias("top"), F.lit(True).alias("bends"))
    last = last.join(into, "top", "left").withColumn("bent", F.col("bent") | F.coalesce("bends", F.lit(False)))
    upper = upper.join(last, "top", "left").select(F.col("r").alias("lr"), F.coalesce("end", "top").alias("utop"), (F.col("dist") + F.coalesce("rest", F.lit(0))).alias("udist"), (F.col("looped") | F.coalesce("bent", F.lit(False))).alias("ulooped"))
    done = labelled.join(upper, "lr", "left")
    return done.select("r", F.coalesce("utop", "top").alias("top"), F.coalesce(F.col("off") + F.col("udist"), F.col("dist")).alias("dist"), F.coalesce("ulooped", "looped").alias("looped"))


def _on_cycles(looped: DataFrame, task_rows: int) -> DataFrame:
    """Of nodes (id, parent) that all lead into cycles: those that are on one, as the image of parent applied often enough."""
    looped = cut(looped)
    rows = looped.count()

    def local(batches):
        pdf = gather(batches)
        if pdf is not None:
            _, _, _, state = forest(pdf["id"].to_numpy(object), pdf["parent"].to_numpy(object))
            yield pd.DataFrame({"id": pdf["id"][state == 1]})

    if rows <= task_rows:
        return looped.coalesce(1).mapInPandas(local, "id string")
    for _ in range(math.ceil(math.log2(rows + 1))):
        looped = cut(looped.join(looped.select(F.col("id").alias("parent"), F.col("parent").alias("beyond")), "parent").select("id", F.col("beyond").alias("parent")))
    return looped.select(F.col("parent").alias("id")).distinct()


def hierarchy(links: DataFrame, node: str = "id", parent: str = "parent", extra: tuple[str, ...] = (), *, paths: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per distinct non-null node: id, parent, root, depth, state and, with paths, path (root first, node last).

    state: tree (the topmost node has no parent), dangling (the topmost node names a parent that is no node), in_cycle or
    below_cycle. For the first two root is the topmost node and depth the distance to it; in the others root, depth and
    path are null. A node given several times keeps its greatest parent and greatest value of each extra column; rows with
    a null node are left out as they name none; an empty table gives an empty one. Nothing grows with a hot parent: no task
    holds more than task_rows rows, and joins by parent have one row a child.
    """
    nodes = cut(_nodes(links, node, parent, list(extra)))
    rows = nodes.count()
    labelled = cut(_label(nodes, rows, task_rows, paths))
    roots = labelled.where("id = lroot and lstate = 0 and parent is not null").select(F.col("id").alias("r"), F.col("parent").alias("p"))
    of = labelled.select(F.col("id").alias("p"), F.col("lroot").alias("t"), (F.col("off") + 1).alias("w"), F.col("lstate").alias("tstate"), *(["lpath"] if paths else []))
    edges = cut(roots.join(of, "p", "left"))
    inner = edges.where("tstate = 0")
    resolved = _resolve(inner.select("r", "t", "w"), task_rows).select(F.col("r").alias("lroot"), "top", "dist", "looped")
    ends = edges.where("t is null").select(F.col("r").alias("lost"))
    into = edges.where("tstate > 0").select(F.col("r").alias("caught"))
    resolved = cut(resolved)
    full = (
        labelled.join(resolved, "lroot", "left")
        .withColumn("end", F.coalesce("top", "lroot"))
        .join(ends, F.col("end") == F.col("lost"), "left")
        .join(into, F.col("end") == F.col("caught"), "left")
        .withColumn("looped", F.coalesce("looped", F.lit(False)))
    )
    state = F.when(F.col("lstate") == 1, ON_CYCLE).when((F.col("lstate") == 2) | F.col("caught").isNotNull(), BELOW_CYCLE).when(F.col("looped"), "open").when(F.col("lost").isNotNull(), DANGLING).otherwise(TREE)
    out = full.select("id", "parent", *[f"x_{c}" for c in extra], "lroot", F.col("end").alias("root"), (F.col("off") + F.coalesce("dist", F.lit(0))).alias("depth"), state.alias("state"), *(["lpath"] if paths else []))
    out = cut(out)
    opened = out.where("state = 'open'").select("id", "parent")
    if not opened.isEmpty():
        out = out.join(_on_cycles(opened, task_rows).select("id", F.lit(True).alias("on")), "id", "left")
        out = out.withColumn("state", F.when(F.col("state") == "open", F.when(F.col("on"), ON_CYCLE).otherwise(BELOW_CYCLE)).otherwise(F.col("state"))).drop("on")
    whole = F.col("state").isin(TREE, DANGLING)
    kept = ["id", "parent", *[F.col(f"x_{c}").alias(c) for c in extra], F.when(whole, F.col("root")).alias("root"), F.when(whole, F.col("depth")).alias("depth"), "state"]
    if not paths:
        return out.select(*kept)
    sound = out.where(whole).select(F.col("id").alias("r"))
    prefix = cut(inner.select("r", "t", "lpath").join(sound, "r", "left_semi"))
    while True:  # chains of prefixes are doubled until each begins at a topmost node
        above = prefix.select(F.col("r").alias("t"), F.col("t").alias("t2"), F.col("lpath").alias("lpath2"))
        tops = out.where("id = root and state in ('tree', 'dangling')").select(F.col("id").alias("t"), F.lit(True).alias("ended"))
        open_ = prefix.join(tops, "t", "left_anti")
        more = open_.join(above, "t")
        if more.isEmpty():
            break
        ended = prefix.join(tops, "t", "left_semi")
        prefix = cut(ended.select("r", "t", "lpath").unionByName(more.select("r", F.col("t2").alias("t"), F.concat("lpath2", "lpath").alias("lpath"))))
        if prefix.join(tops, "t", "left_anti").isEmpty():
            break
    prefix = prefix.select(F.col("r").alias("lroot"), F.col("lpath").alias("before"))
    path = F.when(whole, F.concat(F.coalesce("before", F.array().cast("array<string>")), "lpath"))
    return out.join(prefix, "lroot", "left").select(*kept, path.alias("path"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for each node under each of its ancestors, from a hierarchy with paths.

    Nodes on or below cycles have no path and so no rows; a childless root has none either.
    """
    each = tree.where(F.col("path").isNotNull()).select("id", "depth", F.posexplode("path").alias("level", "ancestor"))
    return each.where(F.col("ancestor") != F.col("id")).select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("level")).cast("bigint").alias("distance"))
