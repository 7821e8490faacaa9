"""Staged searches: one row a target, no way through a box, nothing impossible without proof."""

import random

import numpy as np

from pipeweave.functions.rules import rule_table
from pipeweave.operators.escalation import outcomes

LINE = "ordinal long, seq int, ax double, ay double, ex double, ey double, dn long"
BOX = "ordinal long, type string, x0 double, y0 double, x1 double, y1 double"


def run(spark, targets, boxes, lines, **more):
    t = spark.createDataFrame(targets, "target long, x double, y double")
    found = outcomes(t, spark.createDataFrame(boxes, BOX), spark.createDataFrame(lines, LINE), rule_table(spark), 50, 0.4, **more)
    return {r.target: r for r in found.collect()}


def walled(i, x, y, gap=0.0):
    """Railway boxes around (x, y), with a gap on the right."""
    far, thick = 20.0, 2.0
    sides = [(x - far, y - far, x + far, y - far + thick), (x - far, y + far - thick, x + far, y + far), (x - far, y - far, x - far + thick, y + far)]
    sides += [(x + far - thick, y - far, x + far, y - gap / 2), (x + far - thick, y + gap / 2, x + far, y + far)]
    return [(i + k, "railway", *s) for k, s in enumerate(sides)]


def test_stages(spark):
    line = [(1, 0, 0.0, -100.0, 3000.0, -100.0, 100)]
    targets = [(1, 50.0, -20.0), (2, 300.0, 0.0), (3, 600.0, 0.0), (4, 900.0, 0.0), (5, 1500.0, 900.0), (6, None, 0.0), (7, 1800.0, 0.0), (7, 1800.0, 0.0)]
    boxes = [(100, "railway", 280.0, -60.0, 330.0, -40.0), *walled(200, 600.0, 0.0, gap=3.0), *walled(300, 900.0, 0.0), (400, "road", 1790.0, -60.0, 1810.0, -40.0)]
    got = run(spark, targets, boxes, line)
    assert {k: (r.status, r.stage) for k, r in got.items()} == {
        1: ("STRAIGHT", 1), 2: ("ROUTED", 2), 3: ("ROUTED", 2), 4: ("ENCLOSED", 4), 5: ("SEARCH_INCOMPLETE", 4), 6: ("SEARCH_INCOMPLETE", 4), 7: ("STRAIGHT", 1),
    }
    assert got[1].length_m == 80 and got[2].length_m > 100 and got[4].points is None


def test_ways_are_checked_against_boxes_outside_of_their_search(spark):
    # The way around a long wall runs, out of the sight of a short search, into a box beside its end.
    wall, beyond = (1, "railway", 0.0, -12.0, 400.0, -10.0), (2, "railway", -30.0, -60.0, -1.5, -9.0)
    got = run(spark, [(1, 100.0, 0.0)], [wall, beyond], [(1, 0, 0.0, -100.0, 400.0, -100.0, 100)], searches=((4, 300.0, 20.0), (4, 300.0, 400.0)))
    assert got[1].status in ("ROUTED", "SEARCH_INCOMPLETE")
    if got[1].status == "ROUTED":
        assert got[1].stage == 3


def test_random_scenes(spark):
    r = random.Random(11)
    boxes = [(i, r.choice(["park", "railway", "water", "road", "oks"]), x, y, x + r.uniform(5, 40), y + r.uniform(5, 40)) for i in range(150) for x, y in [(r.uniform(0, 600), r.uniform(0, 600))]]
    targets = [(i, r.uniform(0, 600), r.uniform(0, 600)) for i in range(40)]
    got = run(spark, targets, boxes, [(1, 0, 0.0, 300.0, 600.0, 310.0, 100)], searches=((4, 120.0, 120.0),))
    assert sorted(got) == list(range(40)) and len({x.status for x in got.values()}) >= 3
    keep = {"park": 1.2, "railway": 1.2, "water": 1.2, "oks": 5.2}
    for row in got.values():
        if row.points:
            path = np.array([[p.x, p.y] for p in row.points])
            along = np.concatenate([a + np.linspace(0, 1, 200)[:, None] * (b - a) for a, b in zip(path, path[1:])])
            for _, kind, x0, y0, x1, y1 in boxes:
                if kind in keep:
                    k = keep[kind] - 1e-6
                    assert not ((along[:, 0] > x0 - k) & (along[:, 0] < x1 + k) & (along[:, 1] > y0 - k) & (along[:, 1] < y1 + k)).any()
            assert np.isclose(np.hypot(*np.diff(path, axis=0).T).sum(), row.length_m)
