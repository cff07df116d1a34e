import random

from commitloom.operators.graph import components


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


def test_components_equal_union_find(spark):
    r = random.Random(3)
    for edges in (
        [(i, i + 1) for i in range(70)],
        [(0, i) for i in range(1, 60)] + [(i, 500) for i in range(200, 240)],
        [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3), (4, None), (-7, 9), (9, -7)],
        [(1, 1)],
    ):
        df = spark.createDataFrame(edges, "u long, v long")
        assert sorted(map(tuple, components(df).collect())) == plain(edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
