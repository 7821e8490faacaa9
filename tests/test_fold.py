"""Folds over trees by taking off runs, against a loop."""

import random

import pytest

from pipeweave.operators.network import fold_up


def slow(rows):
    parent, total, most = {n: p for n, p, *_ in rows}, {}, {}
    for n, _, v, w in rows:
        at = n
        while at in parent:
            total[at] = total.get(at, 0) + (v or 0)
            most[at] = max([x for x in (most.get(at), w) if x is not None], default=None)
            at = parent[at]
    return {n: (total[n], most[n]) for n in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_equals_a_loop(spark, shape):
    r = random.Random(shape)
    up = {"random": lambda i: i - 1 if r.random() < 0.7 else r.randint(0, i - 1), "chain": lambda i: i - 1, "star": lambda i: 0 if i < 4 else r.randint(1, 3)}[shape]
    rows = [(i, up(i), r.randint(0, 9), r.choice([None, 50, 80, 100])) for i in range(1, 700 if shape == "chain" else 200)]
    got = fold_up(spark.createDataFrame(rows, "node long, parent long, flow long, dn long"), {"flow": "sum", "dn": "max"})
    assert {x.node: (x.flow, x.dn) for x in got.collect()} == slow(rows)


def test_nothing_and_a_cycle(spark):
    schema = "node long, parent long, flow long"
    assert fold_up(spark.createDataFrame([], schema), {"flow": "sum"}).count() == 0
    for rows in ([(1, 2, 1), (2, 1, 1)], [(1, 2, 1), (2, 1, 1), (3, 1, 1)]):
        with pytest.raises(ValueError):
            fold_up(spark.createDataFrame(rows, schema), {"flow": "sum"})


def test_points_without_coordinates_have_no_neighbours(spark):
    from pipeweave.operators.ties import knn

    rows = [(1, 0.0, 0.0), (2, 3.0, 4.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 100.0, 0.0)]
    got = knn(spark.createDataFrame(rows, "ordinal long, x double, y double"), 1, 16.0)
    assert sorted((r.ordinal, r.neighbour, r.distance_m) for r in got.collect()) == [(1, 2, 5.0), (2, 1, 5.0), (5, 2, pytest.approx(97.082439))]
