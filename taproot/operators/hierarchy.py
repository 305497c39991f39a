"""Parent-child links to full hierarchies by leaf peeling.

Upwards, nodes without unpeeled children leave in layers and send the size of what hangs below them to their parents.
What never becomes a leaf lies on a cycle.  Downwards, the layers are visited in reverse and every node takes root,
depth, path and cycle from its parent.

Groups (documents) of at most ``local_limit`` nodes are peeled in memory, many groups to a task.  Larger groups are
peeled by Spark, one layer a round, until what remains of them fits the same limit; a remainder that resists (a very
long chain or cycle, which would take a round for each of its nodes) is resolved by pointer doubling, whose rounds grow with
the logarithm of the depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.plans.lineage import cut, stored

#: White space as stripped from parent ids: everything Unicode calls white space.
PARENT_SPACE = r"(?U)^\s+|\s+$"
_RESULT = "group string, node string, parent string, root string, depth int, subtree int, cycle string, path array<string>"
#: Path entries that one output batch may hold.
_BATCH_PATH = 1_000_000


def peel(parent: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Layers of a forest, leaves first; subtree sizes; the nodes that remain (they lie on cycles).

    ``parent`` holds each node's parent position, -1 for a root.
    """
    n = len(parent)
    size = np.ones(n, np.int64)
    waiting = np.bincount(parent[parent >= 0], minlength=n)
    gone = np.zeros(n, bool)
    layer = np.flatnonzero(waiting == 0)
    layers = []
    while len(layer):
        layers.append(layer)
        gone[layer] = True
        child = layer[parent[layer] >= 0]
        up = parent[child]
        np.add.at(size, up, size[child])
        np.subtract.at(waiting, up, 1)
        up = np.unique(up)
        layer = up[waiting[up] == 0]
    return layers, size, np.flatnonzero(~gone)


def _resolve(rows: pd.DataFrame, paths: bool, only_cycles: bool) -> Iterator[pd.DataFrame]:
    """All groups of one task: ``group``, ``node``, ``parent`` (already stripped) and ``below`` (nodes peeled before)."""
    n = len(rows)
    if not n:
        return
    ids = rows["node"].to_numpy(object)
    at = rows[["group", "node"]].assign(at=np.arange(n))
    found = rows[["group", "parent"]].merge(at, how="left", left_on=["group", "parent"], right_on=["group", "node"])["at"]
    known = rows["parent"].notna().to_numpy() & found.notna().to_numpy()
    parent = np.where(known, found.fillna(-1).to_numpy(), -1).astype(np.int64)
    layers, size, residual = peel(parent)
    below = rows["below"].to_numpy(np.int64)
    if below.any():
        size = size.copy()
        extra = below.copy()
        for layer in layers:
            child = layer[parent[layer] >= 0]
            np.add.at(extra, parent[child], extra[child])
        size += extra
    cycle = np.full(n, None, object)
    seen = np.zeros(n, bool)
    for start in residual:
        if not seen[start]:
            ring, x = [], start
            while not seen[x]:
                seen[x] = True
                ring.append(x)
                x = parent[x]
            cycle[ring] = min(ids[ring])
    depth = np.full(n, -1, np.int64)
    root = np.full(n, -1, np.int64)
    for layer in reversed(layers):
        up = parent[layer]
        top, rest = layer[up < 0], layer[up >= 0]
        depth[top], root[top] = 0, top
        up = up[up >= 0]
        cycle[rest] = cycle[up]
        root[rest] = root[up]
        depth[rest] = np.where(root[up] >= 0, depth[up] + 1, -1)
    looped = root < 0
    pick = np.flatnonzero(looped) if only_cycles else np.arange(n)
    length = np.where(looped, 0, depth + 1)[pick] if paths else np.zeros(len(pick), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(length) // _BATCH_PATH)) + 1
    for part in np.split(pick, cuts):
        lines = None
        if paths:
            lines = []
            for x in part:
                if looped[x]:
                    lines.append(None)
                    continue
                line = []
                while x >= 0:
                    line.append(ids[x])
                    x = parent[x]
                lines.append(line[::-1])
        out = rows.iloc[part][["group", "node"]]
        ring = np.isin(part, residual)
        yield pd.DataFrame(
            {
                "group": out["group"].to_numpy(),
                "node": out["node"].to_numpy(),
                "parent": np.where(parent[part] >= 0, ids[parent[part]], None),
                "root": np.where(looped[part], None, ids[root[part]]),
                "depth": pd.array(np.where(looped[part], 0, depth[part]), dtype="Int32").copy(),
                "subtree": pd.array(size[part], dtype="Int32").copy(),
                "cycle": cycle[part],
                "path": lines if paths else None,
            }
        ).assign(depth=lambda d: d["depth"].mask(looped[part]), subtree=lambda d: d["subtree"].mask(ring))


def _local(df: DataFrame, paths: bool, only_cycles: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            yield from _resolve(pd.concat(rows, ignore_index=True), paths, only_cycles)

    return df.select("group", "node", "parent", "below").mapInPandas(run, _RESULT)


def _doubled(left: DataFrame, n: int, paths: bool) -> DataFrame:
    """Root, depth, size, cycle and, if asked for, path of a remainder by pointer doubling; every parent is null or a node of it.

    Without paths a row holds two pointers and two numbers, however deep its node lies.
    """
    rounds = max(1, math.ceil(math.log2(n + 1)))
    base = left.select("group", "node", "parent")
    step = cut(base.select("group", "node", F.col("parent").alias("to")))
    for _ in range(rounds):
        far = step.select(F.col("group").alias("g"), F.col("node").alias("to"), F.col("to").alias("next"))
        step = cut(step.join(far, (step["group"] == far["g"]) & (step["to"] == far["to"]), "left").select("group", "node", F.col("next").alias("to")))
        if not step.where("to is not null").limit(1).count():
            break
    looped = step.where("to is not null")
    ring = looped.select("group", F.col("to").alias("node")).distinct()
    walk = cut(base.join(ring, ["group", "node"], "left_semi").select("group", "node", F.col("parent").alias("to"), F.col("node").alias("least")))
    n_ring = walk.count()
    for _ in range(math.ceil(math.log2(n_ring + 1)) if n_ring else 0):
        far = walk.select(F.col("group").alias("g"), F.col("node").alias("t"), F.col("to").alias("next"), F.col("least").alias("other"))
        walk = cut(walk.join(far, (walk["group"] == far["g"]) & (walk["to"] == far["t"])).select("group", "node", F.col("next").alias("to"), F.least("least", "other").alias("least")))
    cycles = looped.join(walk.select("group", F.col("node").alias("to"), F.col("least").alias("cycle")), ["group", "to"]).select("group", "node", "cycle")
    rings = walk.select("group", "node", F.lit(True).alias("on_cycle"))
    # Ring nodes count as tops here, so what hangs from a cycle gets its size too.
    open_ = left.join(rings, ["group", "node"], "left").select("group", "node", F.when(F.col("on_cycle").isNull(), F.col("parent")).alias("to"), F.col("below"))
    line = cut(
        open_.select(
            "group", "node", F.col("to").alias("exact"), "to", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("hops"), (F.col("below") + 1).alias("size"),
            (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("path"),
        )
    )
    # ``exact`` is the ancestor a power of two above, null beyond the top; ``to`` stays on the top once it is there.
    for _ in range(rounds):
        sent = line.where("exact is not null").groupBy(F.col("group").alias("g"), F.col("exact").alias("t")).agg(F.sum("size").alias("sent"))
        grown = line.join(sent, (line["group"] == sent["g"]) & (line["node"] == sent["t"]), "left").drop("g", "t")
        far = line.select(F.col("group").alias("g"), F.col("node").alias("t"), F.col("exact").alias("e"), F.col("to").alias("next"), F.col("hops").alias("more"), F.col("path").alias("upper"))
        on = F.col("next").isNotNull()
        line = cut(
            grown.join(far, (grown["group"] == far["g"]) & (grown["to"] == far["t"]), "left").select(
                "group", "node", F.when(F.col("exact") == F.col("to"), F.col("e")).alias("exact"), F.when(on, F.col("next")).otherwise(F.col("to")).alias("to"),
                (F.col("hops") + F.when(on, F.col("more")).otherwise(0)).alias("hops"), (F.col("size") + F.coalesce("sent", F.lit(0))).alias("size"),
                F.when(on, F.concat("upper", "path")).otherwise(F.col("path")).alias("path"),
            )
        )
        if not line.where("exact is not null").limit(1).count():
            break
    top = F.coalesce("to", "node")
    whole = F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat(F.array("to"), "path"))
    free = F.col("cycle").isNull()
    return (
        base.join(line.select("group", "node", top.alias("top"), "hops", "size", whole.alias("whole")), ["group", "node"]).join(cycles, ["group", "node"], "left").join(rings, ["group", "node"], "left")
        .select(
            "group", "node", "parent", F.when(free, F.col("top")).alias("root"), F.when(free, F.col("hops")).cast("int").alias("depth"),
            F.when(F.col("on_cycle").isNull(), F.col("size")).cast("int").alias("subtree"), "cycle", F.when(free, F.col("whole")).alias("path"),
        )
    )


def _distributed(df: DataFrame, paths: bool, local_limit: int, max_rounds: int) -> DataFrame:
    """Groups that are too large for one task."""
    there = df.select(F.col("group").alias("g"), F.col("node").alias("n"))
    active = cut(
        df.join(there, (df["group"] == there["g"]) & (df["parent"] == there["n"]), "left").select("group", "node", F.col("n").alias("parent"), F.lit(0).cast("long").alias("below"))
    )
    layers: list[DataFrame] = []
    n = active.count()
    while n > local_limit and len(layers) < max_rounds:
        named = active.where("parent is not null").select("group", F.col("parent").alias("node")).distinct()
        leaves = cut(active.join(named, ["group", "node"], "left_anti"))
        sent = leaves.where("parent is not null").groupBy("group", F.col("parent").alias("node")).agg(F.sum(F.col("below") + 1).alias("sent"))
        rest = cut(
            active.join(named, ["group", "node"], "left_semi").join(sent, ["group", "node"], "left").select("group", "node", "parent", (F.col("below") + F.coalesce("sent", F.lit(0))).alias("below"))
        )
        left = rest.count()
        if left == n:
            break
        layers.append(leaves)
        active, n = rest, left
    # Every layer is written once; what lies above it is the union of those written before.
    solved = stored(_local(active.repartition(1), paths, False) if n <= local_limit else _doubled(active, n, paths))
    for leaves in reversed(layers):
        up = solved.select("group", F.col("node").alias("parent"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("cycle").alias("c"), F.col("path").alias("p"))
        top = F.col("parent").isNull()
        got = leaves.join(up, ["group", "parent"], "left").select(
            "group", "node", "parent", F.when(top, F.col("node")).otherwise(F.col("r")).alias("root"), F.when(top, F.lit(0)).otherwise(F.col("d") + 1).cast("int").alias("depth"),
            (F.col("below") + 1).cast("int").alias("subtree"), F.col("c").alias("cycle"),
            (F.when(top, F.array("node")).when(F.col("p").isNotNull(), F.concat("p", F.array("node"))) if paths else F.lit(None).cast("array<string>")).alias("path"),
        )
        solved = solved.unionByName(stored(got))
    return solved


def hierarchy(
    df: DataFrame, group: str, node: str, parent: str, *, paths: bool = True, only_cycles: bool = False, local_limit: int = 50_000, max_rounds: int = 40
) -> DataFrame:
    """Full hierarchy of parent-child rows, one row for each node.

    Columns: ``group, node, parent`` (null for a root), ``root, depth`` (a root has 0), ``subtree`` (nodes of the
    subtree, itself included), ``cycle`` (least node id, in plain string order, of the cycle in which the way up ends)
    and ``path`` (array from the root to the node).

    A node is a root if its parent is null or blank or names no node of its group; white space around a parent is
    ignored.  A node that reaches no root has null root, depth and path and a cycle; only nodes on the cycle itself
    have a null subtree.  Its own parent is a cycle of one.  Rows with a null node are left out, a null group is a
    group of its own.  Repeated rows count once; of rows that name different parents the greatest parent counts.  Other
    columns are ignored.  An empty table gives an empty table.
    """
    rows = (
        df.select(F.col(group).cast("string").alias("group"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"))
        .where("node is not null")
        .withColumn("parent", F.nullif(F.regexp_replace("parent", PARENT_SPACE, ""), F.lit("")))
        .groupBy("group", "node")
        .agg(F.max("parent").alias("parent"))
        .withColumn("no_group", F.col("group").isNull())
        .withColumn("group", F.coalesce("group", F.lit("")))
    )
    # A null group may not meet an empty one, so it gets a prefix while it is worked on.
    rows = rows.select(F.concat(F.when(F.col("no_group"), "n").otherwise("g"), "group").alias("group"), "node", "parent")
    rows = cut(rows)
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > local_limit).select("group"))
    total, n_large = rows.count(), large.count()
    small = rows if not n_large else rows.join(large, "group", "left_anti")
    out = _local(small.select("*", F.lit(0).cast("long").alias("below")).repartition(max(1, math.ceil(total / local_limit)), "group"), paths, only_cycles)
    if n_large:
        hot = _distributed(rows.join(large, "group", "left_semi"), paths, local_limit, max_rounds)
        out = out.unionByName(hot.where("cycle is not null") if only_cycles else hot)
    return out.withColumn("group", F.when(F.substring("group", 1, 1) == "g", F.expr("substring(group, 2)")))


def descendants(tree: DataFrame) -> DataFrame:
    """The pairs ``group, ancestor, node, distance`` of a :func:`hierarchy` with paths, an ancestor's descendants.

    They come from each node's own path, so no ancestor's list is ever gathered in one place.  Nodes that reach no root
    have none; their pairs are those of :func:`looped_descendants`.
    """
    far = tree.where(F.size("path") > 1).select("group", "node", "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor"))
    return far.select("group", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def looped_descendants(tree: DataFrame) -> DataFrame:
    """The pairs of :func:`descendants` for nodes that reach no root: all other nodes that their way up passes.

    The way leads up to the cycle and once around it, so every node of the cycle is an ancestor of what hangs from it and
    of the others on it; ``distance`` is that of the first visit.  Each cycle is opened above its least node, which makes
    a forest of these nodes: what lies on the way after that node is the part of the cycle deeper than the entry.
    """
    key = F.coalesce(F.concat(F.lit("g"), "group"), F.lit("n")).alias("group")
    looped = cut(tree.where("cycle is not null").select(key, "node", "parent", "cycle", F.col("subtree").isNull().alias("ring")))
    opened = looped.select("group", "node", F.when(F.col("node") != F.col("cycle"), F.col("parent")).alias("parent"))
    forest = cut(hierarchy(opened, "group", "node", "parent").select("group", "node", "root", "depth", "path"))
    ring = cut(forest.join(looped.where("ring").select("group", "node"), ["group", "node"]).select("group", "root", F.col("node").alias("ancestor"), F.col("depth").alias("at")))
    length = ring.groupBy("group", "root").agg((F.max("at") + 1).alias("length"))
    steps = forest.select("group", "node", "root", "depth", F.explode("path").alias("ancestor"))
    entry = steps.join(ring, ["group", "root", "ancestor"]).groupBy("group", "node", "root", "depth").agg(F.max("at").alias("entry"))
    after = entry.join(ring, ["group", "root"]).where(F.col("at") > F.col("entry")).join(length, ["group", "root"])
    pairs = descendants(forest).unionByName(after.select("group", "ancestor", "node", (F.col("depth") + F.col("length") - F.col("at")).alias("distance")))
    return pairs.withColumn("group", F.when(F.substring("group", 1, 1) == "g", F.expr("substring(group, 2)")))
