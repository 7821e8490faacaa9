"""Exact enclosure against a fine raster and planted gaps."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from pipeweave.functions.rules import rule_table
from pipeweave.operators.enclosure import ENCLOSED, NETWORK, OPEN, UNCLEAR, Zones, blockers, enclosure, enclosures

EDGE = ["cx", "cy", "dx", "dy"]


def rows(walls, radius=1.0, part=None, polygonal=False, building=False):
    out = pd.DataFrame(walls, columns=EDGE, dtype=float)
    return out.assign(radius=radius, part=range(len(out)) if part is None else part, polygonal=polygonal, building=building)


def ring(x0, y0, x1, y1, gap=0.0):
    """A wall around a box, with a gap in its upper side."""
    m = (x0 + x1) / 2
    walls = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x0, y0, x0, y1), (x0, y1, m - gap / 2, y1), (m + gap / 2, y1, x1, y1)]
    return walls


NONE = np.zeros((0, 4))


def test_a_gap_of_a_centimetre_decides():
    for gap, want in ((0.0, ENCLOSED), (1.99, ENCLOSED), (2.01, OPEN), (5.0, OPEN)):
        assert enclosure(5, 5, rows(ring(-10, -10, 20, 20, gap)), NONE) == want  # radius 1 on both sides
    assert enclosure(500, 5, rows(ring(-10, -10, 20, 20)), NONE) == OPEN
    assert enclosure(-10.5, 5, rows(ring(-10, -10, 20, 20, 9)), NONE) == ENCLOSED  # within a zone
    assert enclosure(float("nan"), 5, rows(ring(-10, -10, 20, 20)), NONE) == UNCLEAR
    assert enclosure(0, 0, rows([]), NONE) == OPEN


def test_the_network_inside_and_outside():
    yard = rows(ring(-10, -10, 20, 20))
    through, outside, hidden = np.array([[-50.0, 5, 50, 5]]), np.array([[30.0, 0, 50, 5]]), np.array([[-10.3, 0, -10.3, 5]])
    assert enclosure(5, 0, yard, through) == NETWORK
    assert enclosure(5, 0, yard, outside) == ENCLOSED
    assert enclosure(5, 0, yard, hidden) == ENCLOSED  # all of it lies in the wall's zone
    nested = rows(ring(-10, -10, 20, 20) + ring(0, 0, 10, 10))
    assert enclosure(5, 5, nested, np.array([[-6.0, -6, -5, -5]])) == ENCLOSED  # in the outer yard only
    assert enclosure(-6, -6, nested, np.array([[4.0, 4, 5, 5]])) == ENCLOSED
    assert enclosure(-6, -6, nested, np.array([[15.0, 15, 16, 16]])) == NETWORK  # the yard is a ring


def polygon(x0, y0, x1, y1):
    return [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]


def test_own_building_and_other_areas():
    house = rows(polygon(0, 0, 10, 10), 5.2, part=0, polygonal=True, building=True)
    assert enclosure(5, 9, house, NONE) == OPEN
    assert enclosure(5, 9, house.assign(radius=9.0), NONE) == ENCLOSED  # the approach is shorter than the clearance
    walls = rows(ring(-20, -20, 30, 30), 1.0, part=range(1, 6))
    assert enclosure(5, 9, pd.concat([house, walls]), NONE) == ENCLOSED
    assert enclosure(5, 9, pd.concat([house, rows(ring(-20, -20, 30, 30, 4), 1.0, part=range(1, 6))]), NONE) == OPEN
    across = rows([(-5, 13, 15, 13)], 1.0, part=1)
    assert enclosure(5, 9, pd.concat([house, across]), NONE) == UNCLEAR
    park = rows(polygon(0, 0, 100, 100), 1.0, part=0, polygonal=True)
    assert enclosure(50, 50, park, np.array([[40.0, 40, 60, 60]])) == ENCLOSED  # nothing may be laid in it


def raster(walls, radius, at, size, cell):
    n = int(size / cell)
    x, y = np.meshgrid((np.arange(n) + 0.5) * cell, (np.arange(n) + 0.5) * cell, indexing="ij")
    free = np.ones((n, n), dtype=bool)
    for ax, ay, bx, by in walls:
        d2 = max((bx - ax) ** 2 + (by - ay) ** 2, 1e-12)
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2, 0, 1)
        free &= np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) > radius
    seen = np.zeros_like(free)
    i, j = (int(v / cell) for v in at)
    if not free[i, j]:
        return None
    todo = [(i, j)]
    seen[i, j] = True
    while todo:
        i, j = todo.pop()
        if i in (0, n - 1) or j in (0, n - 1):
            return OPEN
        for k, m in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
            if free[k, m] and not seen[k, m]:
                seen[k, m] = True
                todo.append((k, m))
    return ENCLOSED


@pytest.mark.parametrize("seed", range(6))
def test_random_scenes_equal_a_raster(seed):
    r, found = random.Random(seed), []
    for _ in range(12):
        walls = []
        for _ in range(r.randint(14, 30)):
            x, y, a, long = r.uniform(4, 26), r.uniform(4, 26), r.uniform(0, math.tau), r.uniform(3, 12)
            walls.append((x, y, min(28, max(2, x + long * math.cos(a))), min(28, max(2, y + long * math.sin(a)))))
        at = (r.uniform(10, 20), r.uniform(10, 20))
        # Scenes that a radius of a raster cell more or less would change are too close for the raster to tell.
        want = {raster(walls, q, at, 30, 0.1) for q in (0.35, 0.5, 0.65)}
        if len(want) == 1 and want != {None}:
            got = enclosure(*at, rows(walls, 0.5), NONE)
            assert got == want.pop()
            found.append(got)
    assert len(found) >= 3


def test_turns_about_many_points():
    zones = Zones(np.array(ring(0, 0, 10, 10) + ring(20, 0, 30, 10), dtype=float), np.full(10, 0.5))
    turns = np.abs(zones.turns(np.array([[5.0, 5], [25, 5], [15, 5], [5, 50]])))
    assert turns.sum(axis=0).tolist() == [1, 1, 0, 0] and (turns[:, 0] * turns[:, 1] == 0).all()


def test_jobs(spark):
    targets = spark.createDataFrame([(1, 5.0, 5.0), (2, 500.0, 500.0), (3, None, 1.0), (4, 5000.0, 5000.0)], "target long, x double, y double")
    walls = [(i, 0, 0, k, "railway", False, *map(float, e)) for i, (k, e) in enumerate(enumerate(ring(-10, -10, 20, 20, 2.0)))]
    passed = [(50 + i, 0, 0, 0, "road", False, *map(float, e)) for i, e in enumerate(ring(480, 480, 520, 520))]
    edges = spark.createDataFrame(walls + passed + [(99, 0, 0, 0, "swamp", False, *[0.0] * 4)], "ordinal long, component long, ring long, seq long, type string, polygonal boolean, cx double, cy double, dx double, dy double")
    blocked = blockers(edges, rule_table(spark), 50, 0.4)
    assert blocked.select("ordinal").distinct().count() == 5 and blocked.first().radius == pytest.approx(1.2 - 0.05)
    no_lines = spark.createDataFrame([], "ax double, ay double, ex double, ey double")
    got = {r.target: r.status for r in enclosures(targets, blocked, no_lines).collect()}
    assert got == {1: ENCLOSED, 2: OPEN, 3: UNCLEAR, 4: OPEN}
    line = spark.createDataFrame([(-100.0, 0.0, 100.0, 1.0)], "ax double, ay double, ex double, ey double")
    assert enclosures(targets, blocked, line).where("target = 1").first().status == NETWORK
