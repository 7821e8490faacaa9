"""Decisions in order against the loops that they stand for."""

import random

import pytest

from pipeweave.operators import order
from pipeweave.storage import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "order")


@pytest.mark.parametrize("seed, n, links", [(1, 60, 40), (2, 60, 120), (3, 30, 300), (4, 40, 39)])
def test_greedy_is_the_loop(spark, scratch, seed, n, links):
    r = random.Random(seed)
    pairs = [(i, i + 1) for i in range(links)] if seed == 4 else [(r.randrange(n), r.randrange(n)) for _ in range(links)]
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    taken, want = [], {}
    for i in range(n):
        first = [a for a in taken if a in near[i]]
        if first:
            want[i] = first[0]
        else:
            taken.append(i)
    df = spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long")
    assert {x.b: x.a for x in order.greedy(df, scratch).collect()} == want
    assert order.greedy(df.limit(0), scratch).count() == 0


@pytest.mark.parametrize("seed, people, chambers", [(1, 40, 12), (2, 80, 9), (3, 20, 30)])
def test_places_are_those_of_the_loop(spark, scratch, seed, people, chambers):
    r = random.Random(seed)
    free = {c: r.choice([0, 1, 1, 2, 4]) for c in range(chambers)}
    wishes = {w: r.sample(range(chambers + 2), r.randint(0, 6)) for w in range(people)}
    left, want = dict(free), {}
    for w in range(people):
        for rank, c in enumerate(wishes[w]):
            if left.get(c, 0):
                left[c] -= 1
                want[w] = (c, rank)
                break
    rows = [(w, c, k) for w, cs in wishes.items() for k, c in enumerate(cs)]
    got = order.places(
        spark.createDataFrame([*rows, *rows[:3], (None, 1, 0), (1, None, 9)], "who long, place long, rank long"), spark.createDataFrame(list(free.items()), "place long, free long"), 4, scratch
    )
    assert {x.who: (x.place, x.rank) for x in got.collect()} == want


@pytest.mark.parametrize("seed, nodes, n", [(1, 30, 25), (2, 30, 60), (3, 8, 60), (4, 50, 50)])
def test_closing_edges_are_those_of_the_loop(spark, scratch, seed, nodes, n):
    r = random.Random(seed)
    edges = [(e, r.randrange(nodes), r.randrange(nodes)) for e in r.sample(range(1000), n)]
    up = list(range(nodes))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    closing = set()
    for e, u, v in sorted(edges):
        if find(u) == find(v):
            closing.add(e)
        else:
            up[find(u)] = find(v)
    least = {}
    for e, u, _ in sorted(edges):
        least.setdefault(find(u), e)
    want = {(e, least[find(u)]) for e, u, v in edges if e in closing}
    df = spark.createDataFrame([*edges, (5000, None, 1)], "edge long, u long, v long")
    assert {(x.edge, x.component) for x in order.closing_edges(df, scratch).collect()} == want
    assert order.closing_edges(df.limit(0), scratch).count() == 0
