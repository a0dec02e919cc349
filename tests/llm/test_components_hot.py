"""Groups with hot vertices, long chains and settled components."""

import random

from claimloom.llm.components import hash_to_min


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_hot_vertices_take_the_broadcast_way(spark):
    rng = random.Random(5)
    star = [("hub", f"s{i:04d}") for i in range(400)]
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(130)]
    loose = [(f"x{rng.randrange(300)}", f"x{rng.randrange(300)}") for _ in range(200)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in star + chain + [e for e in loose if e[0] != e[1]]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string")
    want = brute(edges)
    for hot_rows in (50, 100_000):
        got = {r["id"]: r["group_id"] for r in hash_to_min(df, "a", "b", hot_rows=hot_rows).collect()}
        assert got == want


def test_chain_longer_than_any_round_limit(spark):
    n = 1500
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(f"v{order[i]:05d}", f"v{order[i + 1]:05d}") for i in range(n - 1)]
    got = hash_to_min(spark.createDataFrame(edges, "a string, b string"), "a", "b")
    assert got.count() == n and got.select("group_id").distinct().collect()[0][0] == "v00000"
