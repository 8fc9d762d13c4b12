import random

import pytest

from lexstrata.operators.hierarchy import closure, cycle_nodes, hierarchy

EDGES = "child string, parent string, parent_name string"


def brute(edges):
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    nodes = {x for c, p in edges if c is not None and p is not None for x in (c, p)}

    def above(n):
        seen, todo = set(), list(up.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        return seen

    reach = {n: above(n) for n in nodes}
    cyc = {n for n in nodes if n in reach[n]}
    path = {}

    def make(n):
        if n not in path:
            known = [make(p) for p in up.get(n, ()) if p not in cyc]
            path[n] = min(known, key=lambda x: (len(x), x[-1])) + [n] if known else [n]
        return path[n]

    for n in nodes - cyc:
        make(n)
    return nodes, cyc, path, reach


def check(spark, edges, local_edges):
    df = spark.createDataFrame([(c, p, "x") for c, p in edges], EDGES)
    nodes, cyc, path, _ = brute(edges)
    rows = hierarchy(df, local_edges=local_edges).collect()
    assert len(rows) == len(nodes)
    for r in rows:
        assert r["on_cycle"] == (r["node"] in cyc)
        want = None if r["on_cycle"] else path[r["node"]]
        assert r["path"] == want
        assert r["depth"] == (None if want is None else len(want) - 1) and r["root"] == (want and want[0])
    assert {r["node"] for r in cycle_nodes(df, local_edges=local_edges).collect()} == cyc


@pytest.mark.parametrize("local_edges", [0, 10_000])
def test_random_graphs(spark, local_edges):
    rng = random.Random(local_edges)
    edges = [(f"n{rng.randrange(24)}", f"n{rng.randrange(24)}") for _ in range(18)]
    edges += [("t1", "root"), ("t2", "root"), ("t3", "t1"), ("t4", "t3"), ("t4", "t2"), (None, "root"), ("t1", None), ("t1", "root"), ("s", "s")]
    check(spark, edges, local_edges)


def test_nested_cycles_large_residual(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("x", "a"), ("e", "f")]
    check(spark, edges, 1)


def test_long_chain_and_hot_root(spark):
    edges = [(f"k{i}", f"k{i + 1}") for i in range(300)] + [(f"leaf{i}", "k300") for i in range(600)]
    check(spark, edges, 1000)


def test_chain_of_ten_thousand_in_distributed_rounds(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("concat('k', lpad(id, 5, '0')) child", "concat('k', lpad(id + 1, 5, '0')) parent")
    more = spark.createDataFrame([("k10000", "top"), ("x", "k05000"), ("y", "x"), ("y", "z"), ("z", "y"), ("z", "k00007")], "child string, parent string")
    got = {r["node"] for r in cycle_nodes(edges.union(more), local_edges=0).collect()}
    assert got == {"y", "z"}
    assert cycle_nodes(edges.union(more.limit(0)).union(spark.createDataFrame([("k10000", "k00000")], "child string, parent string")), local_edges=0).count() == n + 1


def test_lists_paths_and_sizes_along_a_contracted_chain(spark):
    n = 150
    edges = [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(n)] + [(f"b{i}", f"k{i * 10:03d}") for i in range(1, 12)] + [("k150", "r1"), ("k150", "r0")]
    df = spark.createDataFrame([(c, p, "x") for c, p in edges], EDGES)
    nodes, _, path, reach = brute(edges)
    rows = {r["node"]: r for r in hierarchy(df, sizes=True, local_edges=0).collect()}
    assert {k: r["path"] for k, r in rows.items()} == path
    assert {k: r["n_descendants"] for k, r in rows.items()} == {k: sum(k in reach[x] for x in nodes) for k in nodes}


def test_closure_of_a_graph_with_two_parents(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("z", "z")]
    df = spark.createDataFrame([(c, p, "x") for c, p in edges], EDGES)
    got = {tuple(r) for r in closure(df).select("node", "descendant", "distance").collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("b", "d", 1), ("b", "e", 2), ("c", "d", 1), ("c", "e", 2), ("d", "e", 1)}


def test_closure_of_an_ancestor_above_a_cycle(spark):
    edges = [("C", "D"), ("D", "C"), ("C", "X"), ("E", "D"), ("X", "Y"), ("E", "W"), ("F", "F"), ("F", "E"), ("G", "F")]
    df = spark.createDataFrame([(c, p, "x") for c, p in edges], EDGES)
    got = {tuple(r) for r in closure(df).select("node", "descendant", "distance").collect()}
    below = {("X", "C", 1), ("X", "D", 2), ("X", "E", 3), ("X", "F", 4), ("X", "G", 5), ("E", "F", 1), ("E", "G", 2), ("W", "E", 1), ("W", "F", 2), ("W", "G", 3)}
    assert got == below | {("Y", n, k + 1) for x, n, k in below if x == "X"} | {("Y", "X", 1)}


@pytest.mark.parametrize("local_edges", [0, 10_000])
def test_closure_of_random_graphs(spark, local_edges):
    rng = random.Random(local_edges + 1)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(32)] + [("s", "s"), ("s", "n1")]
    nodes, cyc, _, reach = brute(edges)
    assert any(reach[n] - cyc for n in cyc)
    got = {(r["node"], r["descendant"]) for r in closure(spark.createDataFrame([(c, p, "x") for c, p in edges], EDGES), local_edges=local_edges).collect()}
    assert got == {(a, n) for n in nodes for a in reach[n] if a not in cyc}


def test_empty(spark):
    df = spark.createDataFrame([], EDGES)
    assert hierarchy(df).count() == 0 and closure(df).count() == 0
