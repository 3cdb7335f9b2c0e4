import random

from riskspark.llm.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def check(spark, edges, kind="long"):
    found = connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == brute(edges)


def test_random_graph_with_nulls_loops_and_repeats(spark):
    rng = random.Random(3)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1, 1), (None, 2), (5, None), (7, 8), (7, 8), (8, 7)])


def test_chain_and_hub(spark):
    check(spark, [(i, i + 1) for i in range(150)] + [(1000, i) for i in range(1001, 1400)])


def test_text_nodes_and_no_edges(spark):
    check(spark, [("b/x", "a/"), ("c", "b/x")], "string")
    check(spark, [])
