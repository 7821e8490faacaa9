"""Decisions against polygons, lines and parts: small scenes worked out by hand."""

import pytest

from pipeweave.functions import rules
from pipeweave.operators import polygons


def ring(ordinal, component, type_, points, ring_=0, polygonal=True):
    ends = [*points[1:], points[0]] if polygonal else points[1:]
    return [(ordinal, component, ring_, i, type_, polygonal, float(a), float(b), float(c), float(d)) for i, ((a, b), (c, d)) in enumerate(zip(points, ends, strict=False))]


def square(ordinal, type_, x, y, size, component=0, ring_=0):
    return ring(ordinal, component, type_, [(x, y), (x + size, y), (x + size, y + size), (x, y + size)], ring_)


def decided(spark, ways, edges):
    kinds = "ordinal long, component long, ring long, seq long, type string, polygonal boolean, cx double, cy double, dx double, dy double"
    rows = [(i, *map(float, w[:4]), 50, 0.4, w[4] if len(w) > 4 else None, w[5] if len(w) > 5 else None) for i, w in enumerate(ways)]
    segments = spark.createDataFrame(rows, "seg_id long, ax double, ay double, ex double, ey double, dn int, width double, target long, tie long")
    found = polygons.decide(segments, polygons.parts(spark.createDataFrame(edges, kinds)), rules.rule_table(spark)).orderBy("seg_id").collect()
    return [(r.status, r.reasons) for r in found]


def test_holes_lines_and_own_objects(spark):
    yard = square(1, "oks", 0, 0, 60) + square(1, "oks", 20, 20, 20, ring_=1)  # a building around a yard
    house = square(2, "oks", 200, 0, 20) + square(2, "oks", 223, 0, 5, component=1)  # a second part beside it
    pipe = ring(3, 0, "gas_pipeline", [(300, -50), (300, 50)], polygonal=False)
    ways = [
        (28, 30, 32, 30),  # within the yard, too near its walls only from 5.2 m on: it has 8 m
        (22, 30, 30, 30),  # 2 m from the wall
        (-20, 30, 30, 30),  # through the wall
        (190, 10, 202, 10, 2),  # the shortest way into its own house
        (190, 10, 202, 10),  # the same into another's
        (190, 10, 215, 10, 2),  # further in than needed
        (222, 30, 222, 20, 2),  # to the corner side of its house, along the other part
        (290, 0, 310, 0),  # across the pipe
        (299, 0, 310, 0),  # across, with no room for the passage
        (300, -10, 300, 10),  # along it
        (290, 20, 300, 20),  # up to it
    ]
    got = decided(spark, ways, yard + house + pipe)
    assert [s for s, _ in got] == ["ALLOWED", "BLOCKED", "BLOCKED", "ALLOWED", "BLOCKED", "BLOCKED", "BLOCKED", "ALLOWED", "BLOCKED", "BLOCKED", "BLOCKED"]
    assert got[1][1] == ["CLEARANCE"] and got[2][1] == ["FORBIDDEN_INTERSECTION"] and got[8][1] == ["SPECIAL_PASSAGE_OUTSIDE_SEGMENT"]
    assert got[9][1] == got[10][1] == ["TOUCH_OVERLAP_OR_INCOMPLETE_CROSSING"]


def test_road_angles_and_what_is_left_beside_a_passage(spark):
    road = square(1, "road", 0, 0, 10)
    bent = ring(2, 0, "gas_pipeline", [(100, -50), (100, 10), (103, 10), (103, 50)], polygonal=False)  # turns and runs along behind the passage
    got = decided(spark, [(-20, 5, 30, 5), (-3, -20, 25, 22), (80, 0, 120, 0), (80, 8.5, 120, 8.5)], road + bent)
    assert got[0] == ("ALLOWED", []) and got[2] == ("ALLOWED", [])
    assert got[3][0] == "ALLOWED" or got[3][1] == ["SPECIAL_CLEARANCE_CONFLICT"]


@pytest.mark.parametrize("far", [30, 100_000])
def test_an_unknown_type_leaves_all_open_at_any_distance(spark, far):
    got = decided(spark, [(0, 0, 10, 0), (0, 0, 0, 5)], square(7, "swamp", far, far, 5) + square(8, "oks", 2, 4, 3))
    assert got == [("BLOCKED", ["CLEARANCE"]), ("BLOCKED", ["CLEARANCE"])]
    assert decided(spark, [(0, 0, 10, 0)], square(7, "swamp", far, far, 5)) == [("INDETERMINATE", [])]


def test_a_passage_excuses_only_the_part_that_it_leads_through(spark):
    """what is left was measured at its end alone, the road's passage hid the bend of the gas pipe, and wrong crossings, touches and parts nearby were left out."""
    road = square(1, "road", 0, -20, 40)
    gas = ring(2, 0, "gas_pipeline", [(10, -50), (10, 2), (16, 2), (16, 50)], polygonal=False)  # runs beside a way before or after it is crossed
    end = ring(3, 0, "power_cable", [(200, 0), (200, 50)], polygonal=False)
    ways = [(-20, 1, 60, 1), (80, 0, 200, 0), (80, -1, 220, -1), (-20, 60, 60, 60), (-40, -30, -3, -30), (-20, 4, 60, 4), (150, 25, 201, 25)]
    kinds = "ordinal long, component long, ring long, seq long, type string, polygonal boolean, cx double, cy double, dx double, dy double"
    segments = spark.createDataFrame([(i, *map(float, w), 50, 0.4, None, None) for i, w in enumerate(ways)], "seg_id long, ax double, ay double, ex double, ey double, dn int, width double, target long, tie long")
    pairs, _ = polygons.candidates(segments, polygons.parts(spark.createDataFrame(road + gas + end, kinds)), rules.rule_table(spark))
    pairs = polygons.exempted(pairs)
    got = sorted(tuple(r) for r in polygons.residual(pairs, polygons.events(pairs)).collect())
    conflict, touch, near, outside = "SPECIAL_CLEARANCE_CONFLICT", "TOUCH_OVERLAP_OR_INCOMPLETE_CROSSING", "CLEARANCE", "SPECIAL_PASSAGE_OUTSIDE_SEGMENT"
    assert got == [(0, 2, 0, conflict), (1, 3, 0, touch), (2, 3, 0, near), (5, 2, 0, conflict), (6, 3, 0, outside)]
    assert [r.reasons for r in polygons.decide(segments, polygons.parts(spark.createDataFrame(road + gas + end, kinds)), rules.rule_table(spark)).orderBy("seg_id").collect()] == [[conflict], [touch], [near], [], [], [conflict], [outside]]
