import random

from fluxmill.llm.components import connected


def test_chains_stars_and_random_graphs(spark):
    dice = random.Random(5)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(dice.randrange(2000, 2100), dice.randrange(2000, 2100)) for _ in range(70)] + [(-5, 7), (9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    dice.shuffle(edges)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
