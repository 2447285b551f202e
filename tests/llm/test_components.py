import random

from confab.llm.components import components, rough_components


def roots(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(70)]
    edges = [(a, b) for a, b in edges if a != b] + [(141, 142), (142, 141), (141, 142)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = roots(edges)
    assert {r.node: r.component for r in components(df.toDF("src", "dst")).collect()} == want
    rough = {r.node: r.component for r in rough_components(df).collect()}
    assert set(rough) == set(want) and all(want[n] == want[c] for n, c in rough.items())


def test_no_edges(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert components(df.toDF("src", "dst")).count() == 0 and rough_components(df).count() == 0
