"""Components and cycles against plain reachability on small graphs, and large ones by their shape."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import components as C


def plain_components(edges):
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    reach = {}
    for a in to:
        seen, todo = set(), [a]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in to if a in reach[a]}


def graph_of(spark, edges, kind="int"):
    return spark.createDataFrame(edges, f"`from` {kind}, `to` {kind}")


def some_edges(seed):
    r = random.Random(seed)
    n, m = r.choice([(6, 9), (12, 15), (30, 34), (30, 60), (60, 70), (40, 45)])
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    if seed % 3 == 0:  # rings and tails
        edges += [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(200 + k, 201 + k) for k in range(7)] + [(3, 200), (207, 100)]
    return edges


def check_cycles(edges, got, want):
    """Listed cycles are simple ones of the graph, in every component, and hold every edge beyond a tree."""
    known = {(a, b) for a, b in edges}
    assert len(set(map(tuple, got))) == len(got)
    for c in got:
        assert c[0] == c[-1] == min(c) and len(set(c[:-1])) == len(c) - 1 and all(e in known for e in zip(c, c[1:]))
    on = {e for c in got for e in zip(c, c[1:])}
    for comp in set(want.values()):
        nodes = {v for v, c in want.items() if c == comp}
        own = {(a, b) for a, b in known if a in nodes and b in nodes and a != b}
        mine = [c for c in got if set(c) <= nodes]
        assert mine and len(own - on) <= len(nodes) - 1
        assert len([c for c in mine if len(c) > 2]) <= len(own) - len(nodes) + 1


@pytest.mark.parametrize("seed", range(7))
def test_same_as_reachability(spark, seed):
    edges = some_edges(seed)
    graph = graph_of(spark, [*edges, edges[0], (None, 1), (1, None)])
    want = plain_components(edges)
    members = C.components(graph)
    assert {r["node"]: r["component"] for r in members.collect()} == want
    got = [r["cycle"] for r in C.fundamental_cycles(graph, members).collect()]
    check_cycles(edges, got, want)


def test_nothing_and_loops(spark):
    assert C.components(graph_of(spark, [])).count() == 0 and C.fundamental_cycles(graph_of(spark, [])).count() == 0
    graph = graph_of(spark, [("a", "a"), ("a", "b"), ("b", "c")], "string")
    assert [tuple(r) for r in C.components(graph).collect()] == [("a", "a")]
    assert [r["cycle"] for r in C.fundamental_cycles(graph).collect()] == [["a", "a"]]


def test_a_ring_whose_nodes_are_on_short_cycles_is_listed(spark):
    ring = [(k, (k + 1) % 9) for k in range(9)]
    edges = [*ring, *((b, a) for a, b in ring[::2])]
    got = [r["cycle"] for r in C.fundamental_cycles(graph_of(spark, edges)).collect()]
    assert [0, 1, 2, 3, 4, 5, 6, 7, 8, 0] in got
    check_cycles(edges, got, plain_components(edges))


def test_a_ring_of_ten_thousand(spark):
    n = 10_000
    ring = spark.range(n).select(F.col("id").alias("from"), ((F.col("id") * 1 + 1) % n).alias("to"))
    tail = spark.range(500).select((F.col("id") + n).alias("from"), F.when(F.col("id") < 499, F.col("id") + n + 1).otherwise(0).alias("to"))
    members = C.components(ring.union(tail))
    assert members.groupBy("component").count().collect() == [(0, n)]
    (cycle,) = C.fundamental_cycles(ring.union(tail), members).collect()
    assert cycle["cycle"] == [*range(n), 0]


def test_a_dense_core(spark):
    """Of 500 nodes and 50,000 edges no table is larger than a few times the edges."""
    r = random.Random(1)
    edges = [(r.randrange(500), r.randrange(500)) for _ in range(50_000)] + [(600 + k, k) for k in range(50)] + [(k, 700 + k) for k in range(50)]
    got = {x["node"]: x["component"] for x in C.components(graph_of(spark, edges)).collect()}
    assert got == dict.fromkeys(range(500), 0)
