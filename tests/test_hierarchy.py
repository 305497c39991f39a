import random

import pytest

from taproot.operators.current import current_rows
from taproot.operators.hierarchy import descendants, hierarchy, looped_descendants


def brute(rows):
    nodes = {}
    for g, n, p in rows:
        if n is not None:
            p = (p or "").strip()
            nodes[g, n] = max(nodes.get((g, n), ""), p)
    out = {}
    for (g, n), p in nodes.items():
        path, x = [n], (g, n)
        while True:
            up = (g, nodes[x])
            if not nodes[x] or up not in nodes:
                out[g, n] = (path[-1], len(path) - 1, None, path[::-1])
                break
            if up[1] in path:
                ring = path[path.index(up[1]) :]
                out[g, n] = (None, None, min(ring), None)
                break
            path.append(up[1])
            x = up
    return out


def random_rows(seed, n=60):
    r = random.Random(seed)
    rows = []
    for g in ("a", "b", None):
        for i in range(n):
            p = r.choice([None, "", "  ", "nowhere", *[f" n{r.randrange(n)} "] * 8])
            rows.append((g, f"n{i}", p))
    return rows + rows[:5] + [("a", None, "n1")]


@pytest.mark.parametrize("limit,rounds", [(1000, 40), (20, 40), (5, 2), (5, 0)])
def test_hierarchy_agrees_with_walking(spark, limit, rounds):
    rows = random_rows(limit + rounds)
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc string, id string, up string, root int, path string")
    got = {(r.group, r.node): (r.root, r.depth, r.cycle, r.path) for r in hierarchy(df, "doc", "id", "up", local_limit=limit, max_rounds=rounds).collect()}
    assert got == brute(rows)


def test_subtrees_and_descendants(spark):
    df = spark.createDataFrame([("d", "r", None), ("d", "a", "r"), ("d", "b", "a"), ("d", "c", "a"), ("d", "x", "y"), ("d", "y", "x"), ("d", "z", "x")], "g string, n string, p string")
    for limit in (100, 1):
        tree = hierarchy(df, "g", "n", "p", local_limit=limit, max_rounds=1)
        assert {r.node: r.subtree for r in tree.collect()} == {"r": 4, "a": 3, "b": 1, "c": 1, "x": None, "y": None, "z": 1}
        pairs = {(r.ancestor, r.node, r.distance) for r in descendants(tree).collect()}
        assert pairs == {("r", "a", 1), ("r", "b", 2), ("r", "c", 2), ("a", "b", 1), ("a", "c", 1)}


@pytest.mark.parametrize("limit,rounds", [(1000, 40), (5, 2)])
def test_descendants_on_and_below_cycles(spark, limit, rounds):
    rows = random_rows(7, 30) + [("c", f"n{i}", f"n{(i + 1) % 6}") for i in range(6)] + [("c", "x", "n3"), ("c", "y", "x"), ("c", "own", "own"), ("c", "z", "own")]
    up, looped = {}, brute(rows)
    for g, n, p in rows:
        up[g, n] = max(up.get((g, n), ""), (p or "").strip())
    want = set()
    for (g, n), found in looped.items():
        met, x = [n], up[g, n]
        while found[2] and x not in met:
            met.append(x)
            want.add((g, x, n, len(met) - 1))
            x = up[g, x]
    tree = hierarchy(spark.createDataFrame(rows, "g string, n string, p string"), "g", "n", "p", local_limit=limit, max_rounds=rounds)
    got = [tuple(r) for r in looped_descendants(tree).select("group", "ancestor", "node", "distance").collect()]
    assert len(got) == len(want) and set(got) == want and ("c", "n2", "y", 7) in want


def test_deep_chain(spark):
    df = spark.createDataFrame([("d", f"{i:04}", f"{i - 1:04}") for i in range(300)], "g string, n string, p string")
    deepest = hierarchy(df, "g", "n", "p", local_limit=50, max_rounds=3).orderBy("depth", ascending=False).first()
    assert (deepest.depth, deepest.root, len(deepest.path)) == (299, "0000", 300)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, n string, p string")
    assert hierarchy(df, "g", "n", "p").count() == 0


def test_current_rows(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "only"), (None, 1, "x"), (None, 3, "y")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    assert sorted((str(r.k), r.v) for r in current_rows(df, ["k"], ["at"], ["v"]).collect()) == [("None", "y"), ("a", "new"), ("b", "only")]
    assert current_rows(df.limit(0), ["k"], ["at"]).count() == 0


@pytest.mark.parametrize("limit, rounds", [(5, 1), (5, 40), (1000, 40)])
def test_without_paths(spark, limit, rounds):
    rows = [("g", f"n{i:03}", f"n{i - 1:03}" if i % 50 else None) for i in range(150)] + [("g", f"r{i}", f"r{(i + 1) % 3}") for i in range(3)] + [("g", "x", "r0"), ("g", "y", "x")]
    df = spark.createDataFrame(rows, "g string, n string, p string")
    full = {tuple(r)[:7] for r in hierarchy(df, "g", "n", "p").collect()}
    bare = hierarchy(df, "g", "n", "p", paths=False, local_limit=limit, max_rounds=rounds).collect()
    assert {tuple(r)[:7] for r in bare} == full and all(r.path is None for r in bare)


def test_plans_of_current_rows_do_not_hold_the_filter(spark):
    """F8: the filter of repeated keys stood in the plan's text, twice its size in each place, which the driver keeps."""
    rows = spark.range(6000).selectExpr("cast(id % 4000 as string) AS k", "id AS at", "id % 7 AS v")
    got = current_rows(rows, ["k"], ["at"], ["v"])
    assert len(got._jdf.queryExecution().toString()) < 20_000
    assert {r.k: r.v for r in got.collect()} == {str(k): (k + 4000 if k < 2000 else k) % 7 for k in range(4000)}
