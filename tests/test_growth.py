"""What must not grow with the tables: broadcasts, copies of one place, rows of one task."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_near_join_broadcasts_neither_side(spark):
    from pipeweave.operators.cells import near_join

    rnd = random.Random(5)
    a, b = ([(i, rnd.uniform(0, 900), rnd.uniform(0, 900)) for i in range(n)] for n in (60, 80))
    left, right = spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "j long, u double, v double")
    out = near_join(left, right, ("x", "y", "x", "y"), ("u", "v", "u", "v"), 150.0, 64.0)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, j) for i, x, y in a for j, u, v in b if abs(x - u) <= 150 and abs(y - v) <= 150)
    assert sorted((r.i, r.j) for r in out.collect()) == want


def test_errors_of_large_plans_are_found(spark):
    from pipeweave.functions import rules
    from pipeweave.operators import validate

    rows = spark.createDataFrame([(1, 3e11, 0.0), (2, 3e11, 5.0), (3, 2e12, 5.0)], "variant_id long, network double, more double")
    sums = rows.selectExpr("variant_id", "network", "1e6D AS chambers", "2e5D AS ties", "3e4D AS penalty", "1e6D AS length_m", "more").withColumn("calculated", F.expr("network + chambers + ties + penalty"))
    given = sums.withColumn("score", F.expr(rules.score("calculated", "length_m"))).withColumn("calculated", F.expr("calculated + more"))
    assert [tuple(r) for r in validate.summaries(given).orderBy("variant_id").collect()] == [(2, "calculated"), (3, "calculated")]


def test_sections_need_one_shuffle_and_no_join(spark):
    from pipeweave.operators import restrict

    rows = spark.createDataFrame([(1, 1, 2.0, 8.0, 1.2, 10.0), (1, 2, 5.0, 20.0, 1.6, 10.0), (2, 7, -3.0, 0.0, 1.2, 4.0)], "edge_id long, passage int, from_m double, to_m double, k double, length_m double")
    found = restrict.sections(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    want = [(1, 0.0, 2.0, 1.0, 0, -1), (1, 2.0, 5.0, 1.2, 1, 1), (1, 5.0, 8.0, 1.6, 2, 1), (1, 8.0, 10.0, 1.6, 1, 2), (2, 0.0, 4.0, 1.0, 0, -1)]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_targets_of_one_place_are_searched_once(spark):
    from pipeweave.operators.cells import per_place

    rows = [(7, 1.0, 2.0), (3, 1.0, 2.0), (5, 4.0, 4.0), (6, None, 4.0), (2, None, 4.0)]
    seen = []

    def search(at):
        seen.append(sorted(r.target for r in at.collect()))
        return at.withColumn("found", F.col("target") * 10).select("target", "found")

    got = per_place(spark.createDataFrame(rows, "target long, x double, y double"), search)
    assert sorted(map(tuple, got.collect())) == [(2, 20), (3, 30), (5, 50), (6, 20), (7, 30)] and seen == [[2, 3, 5]]


def test_guided_walks_are_as_short_and_look_at_few_states():
    from pipeweave.operators import search

    rnd = np.random.default_rng(4)
    for share in (0.0, 0.2, 0.35):
        free = rnd.random((41, 41)) >= share
        free[20, 20] = True
        goals = np.zeros_like(free)
        goals[1:4, 3:6] = True
        goals &= search.flood(free)
        ways = [search.walk(free, goals, guided=g) for g in (False, True)]
        size = [w and (len(w), round(sum(math.dist(a, b) for a, b in zip(w, w[1:], strict=False)), 6)) for w in ways]
        assert size[0] == size[1]
        if share == 0.0:
            assert search.walk(free, goals, most=60, guided=True)


def test_flood_over_corners_and_edges():
    from pipeweave.operators import search

    free = np.zeros((5, 7), dtype=bool)
    free[[2, 1, 0], [3, 4, 5]] = True  # on by corners
    free[0, 6] = free[1, 0] = True  # the end of one row does not touch the start of the next
    assert search.flood(free).sum() == 4 and not search.flood(free)[1, 0]


def test_profiles_side_by_side_equal_single_ones():
    from pipeweave.operators.depth import profile, profile_all

    rnd = np.random.default_rng(6)
    at = np.sort(rnd.uniform(0, 40, (12, 50)), axis=1)
    weight = rnd.choice([1.0, 1.25, 1.6], at.shape)
    weight[:, 0] = 1.25
    weight[:, 1] = 1.0
    lo, hi = np.full(at.shape, 0.7), np.where(weight == 1.25, 2.42, np.inf)
    lo[4, 9] = 0.7 if hi[4, 9] > 3 else 0.8
    rows = [i for i in range(12) if i != 4 or lo[4].max() == 0.7]
    found = profile_all(at[rows], weight[rows], lo[rows], hi[rows])
    for i, h in zip(rows, found, strict=True):
        alone = profile(at[i], weight[i], lo[i], hi[i])
        assert np.array_equal(h, np.full(50, np.nan) if alone is None else alone, equal_nan=True)


@pytest.mark.parametrize("name", ["flood_enclosure", "grid_walk"])
def test_searches_group_by_place(spark, name):
    from pipeweave.plans.queries import QUERIES

    assert "_place" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()


def test_boxes_within_boxes_are_no_nodes():
    """a stack of boxes costs a search as much as its outermost one; equal ones count once."""
    from pipeweave.operators import graph

    outer = np.array([[10.0, -50.0, 20.0, 50.0], [40.0, -30.0, 50.0, 60.0]])
    stack = np.concatenate([outer, outer] + [outer + [k, k, -k, -k] for k in (1.0, 2.0, 3.0)])
    target, tie = np.array([70.0, 0.0]), np.array([[0.0, 0.0]])
    (few, places), (many, nodes) = graph.astar(target, tie, outer), graph.astar(target, tie, stack)
    assert len(nodes) == len(places) == 10 and places[few].tolist() == nodes[many].tolist()


def test_equal_steps_are_costed_once():
    """what a step costs depends on its length, price and passage, not on the pipe."""
    from pipeweave.operators import tree_depth

    section = {"from_m": 40.0, "to_m": 50.0, "coefficient": 1.6, "special": True, "types": ["road"], "heights": [None]}
    pipe = {"length_m": 400.0, "rate": 2.0, "height": 0.3, "sections": [section]}
    levels = tree_depth.Levels(tree_depth.make_levels({1.0}, 0.05))
    for _ in range(3):
        cost, _ = tree_depth.backward(tree_depth.Edge(pipe, 1.0, 0.5), np.zeros(len(levels.h)), levels)
    assert np.isfinite(cost).any() and len(levels._steps) <= 4


def test_parts_are_measured_in_one_pass(spark):
    """Pairs of segments and parts are not written between the steps of their measuring."""
    from pipeweave.functions import rules
    from pipeweave.operators import polygons

    square = [(7, 0, 0, i, "road", True, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate([(2, 0, 4, 0), (4, 0, 4, 4), (4, 4, 2, 4), (2, 4, 2, 0)])]
    edges = spark.createDataFrame(square, "ordinal long, component long, ring long, seq long, type string, polygonal boolean, cx double, cy double, dx double, dy double")
    ways = [(1, 0.0, 1.0, 9.0, 1.0), (2, 0.0, 4.0, 9.0, 4.0), (3, 0.0, 6.0, 9.0, 6.0), (4, 3.0, 1.0, 3.0, 1.0)]
    ways = spark.createDataFrame(ways, "seg_id long, ax double, ay double, ex double, ey double").selectExpr("*", "50L AS dn", "0.4D AS width", "7L AS target", "CAST(NULL AS BIGINT) AS tie")
    pairs, _ = polygons.candidates(ways, polygons.parts(edges), rules.rule_table(spark))
    got = {r.seg_id: (r.distance_m, [tuple(p) for p in r.pieces]) for r in pairs.collect()}
    assert got == {1: (0.0, [(2.0, 4.0)]), 2: (0.0, [(2.0, 2.0), (4.0, 4.0)]), 3: (2.0, []), 4: (0.0, [])}
    assert "FileScan" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_chases_measure_places_and_obstacles_once(spark, monkeypatch):
    """obstacles meet as parts, not edge by edge, and targets of one place look for the network once."""
    from pipeweave.operators import corridor
    from pipeweave.storage import Scratch

    square = lambda o, x: [(o, 0, 0, i, "park", *map(float, e)) for i, e in enumerate([(x, 0, x + 4, 0), (x + 4, 0, x + 4, 4), (x + 4, 4, x, 4), (x, 4, x, 0)])]
    edges = spark.createDataFrame(square(1, 0) + square(2, 9), "ordinal long, component long, ring long, seq long, type string, cx double, cy double, dx double, dy double")
    found = corridor.touching(edges, 8.0)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 5.0), (2, 1, 5.0)]

    seen, near = [], corridor.near_lines
    monkeypatch.setattr(corridor, "near_lines", lambda todo, *a, **k: seen.append(todo.count()) or near(todo, *a, **k))
    targets = spark.createDataFrame([(i, 0.0, 0.0, 100 + i) for i in range(5)], "target long, x double, y double, dn long")
    lines = spark.createDataFrame([(1, 0, 3.0, -5.0, 3.0, 5.0, 100)], "ordinal long, seq long, ax double, ay double, ex double, ey double, dn long")
    got = corridor.to_network(targets, lines, Scratch(spark, "places")).collect()
    assert seen == [1] and sorted((r.target, r.dn, r.qx, r.qy) for r in got) == [(i, 100 + i, 3.0, 0.0) for i in range(5)]


def test_stacked_boxes_make_few_links(spark):
    """boxes of one corner are linked with one of them, and hang together with others as by all pairs."""
    from pipeweave.operators.graph import box_links, groups

    rnd = random.Random(3)
    rows = [(i, float(rnd.randrange(5) * 10), float(rnd.randrange(4) * 12)) for i in range(150)]
    rows = [(i, x, y, x + rnd.randrange(7), y + rnd.randrange(8)) for i, x, y in rows] + [(200, None, 0.0, 1.0, 1.0), (201, None, 0.0, 1.0, 1.0), (202, 30.0, 0.0, 27.0, 2.0)]
    boxes = spark.createDataFrame(rows, "node long, x0 double, y0 double, x1 double, y1 double")
    links, root = box_links(boxes, 3.0, 16.0), {r[0]: r[0] for r in rows}
    assert links.count() < 300
    meet = lambda a, b: None not in (*a, *b) and max(b[1] - a[3], a[1] - b[3]) <= 3 and max(b[2] - a[4], a[2] - b[4]) <= 3
    near = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b)]
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert len(near) > 450 and len(set(root.values())) > 5
    assert {r.node: r.root for r in groups(boxes.select("node"), links).collect()} == root


def test_sections_are_cut_from_plain_rows(spark):
    """passages are shuffled as rows, not gathered into arrays; edges may go over batches of Arrow, keys be null."""
    import pyarrow as pa

    from pipeweave.operators import restrict

    schema = "edge_id long, passage int, from_m double, to_m double, k double, length_m double"
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(6)]), i, rnd.uniform(-3, 30), rnd.uniform(0, 45), rnd.choice([None, 1.05, 1.6]), rnd.choice([40.0, 40.0, 30.0])) for i in range(60)]
    given = spark.createDataFrame(rows, schema)
    assert "Aggregate" not in restrict.section_arrays(given)._jdf.queryExecution().executedPlan().toString()
    want, sums = {}, {}
    for key in {r[0] for r in rows}:
        mine = [(max(f, 0.0), min(t, n), k or 1.0, p, n) for e, p, f, t, k, n in rows if e == key]
        cuts = sorted({c for f, t, _, _, n in mine for c in (0.0, f, t, n) if 0 <= c <= n})
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            on = [m for m in mine if m[0] < (lo + hi) / 2 < m[1]]
            want.setdefault(key, []).append((lo, hi, max([1.0, *(m[2] for m in on)]), len(on), min((m[3] for m in on), default=-1)))
        sums[key] = (sum(s[1] - s[0] for s in want[key]), sum((s[1] - s[0]) * s[2] for s in want[key]))
    assert {r.edge_id: [tuple(s) for s in r.sections] for r in restrict.section_arrays(given).collect()} == want
    assert {r.edge_id: (pytest.approx(r.length_m), pytest.approx(r.weighted_m)) for r in restrict.section_lengths(given).collect()} == sums
    keys = [None, None, 1, 1, 1, 1, 2, 3, 3]
    for size in (1, 2, 3, 9):
        parts = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64())], ["edge_id"]) for i in range(0, 9, size)]
        dealt = [b.column(0).to_pylist() for b in restrict._edges(iter(parts))]
        assert sum(dealt, []) == keys and all(one[-1] != two[0] for one, two in zip(dealt, dealt[1:], strict=False))


def test_cells_of_a_join_are_one_number(spark):
    """rows of a cell join are sorted by one number and carry little besides; boxes that go backwards count by their first cell."""
    from pipeweave.operators.cells import near_join

    rnd = random.Random(9)
    box = lambda: (lambda x, y: (x, y, x + rnd.uniform(-30, 90), y + rnd.uniform(-30, 90)))(rnd.uniform(-400, 400), rnd.uniform(-400, 400))
    a, b = [(i, *box()) for i in range(80)], [(i, *box()) for i in range(80)]
    left, right = spark.createDataFrame(a, "i long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(b, "j long, u0 double, v0 double, u1 double, v1 double")
    out = near_join(left, right, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), 5.0, 32.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_cell" in plan and "struct" not in plan and "transform" not in plan
    forward = lambda r: r[1] <= r[3] and r[2] <= r[4]
    meet = lambda p, q: max(p[1] - 5 - q[3], q[1] - p[3] - 5, p[2] - 5 - q[4], q[2] - p[4] - 5) <= 0
    want = sorted((p[0], q[0]) for p in a for q in b if forward(p) and forward(q) and meet(p, q))
    got = sorted((r.i, r.j) for r in out.collect())
    assert [t for t in got if forward(a[t[0]]) and forward(b[t[1]])] == want and len(set(got)) == len(got) and len(want) > 25


def test_parts_are_met_without_what_is_not_asked(spark):
    """Python gets the pairs that may count, without rules and rows' other columns, and sends no edges back."""
    from pipeweave.functions import rules
    from pipeweave.operators import polygons

    square = [(7, 0, 0, i, "road", True, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate([(2, 0, 4, 0), (4, 0, 4, 4), (4, 4, 2, 4), (2, 4, 2, 0)])]
    edges = spark.createDataFrame(square, "ordinal long, component long, ring long, seq long, type string, polygonal boolean, cx double, cy double, dx double, dy double")
    ways = [(1, 0.0, 1.0, 9.0, 1.0), (2, 0.0, 4.0, 9.0, 4.0), (3, 0.0, 6.0, 9.0, 6.0), (4, 3.0, 1.0, 3.0, 1.0), (5, -40.0, 0.0, 0.0, 60.0)]
    ways = spark.createDataFrame(ways, "seg_id long, ax double, ay double, ex double, ey double").selectExpr("*", "50L AS dn", "0.4D AS width", "7L AS target", "CAST(NULL AS BIGINT) AS tie")
    parts, table = polygons.parts(edges), rules.rule_table(spark)
    wide, close = polygons.met(ways, parts, table, "distance_m"), polygons.met(ways, parts, table, "pieces", polygons.EPS)
    assert {tuple(r) for r in wide.collect()} == {(1, 7, 0, 0.0), (2, 7, 0, 0.0), (3, 7, 0, 2.0), (4, 7, 0, 0.0)}
    assert {r.seg_id: [tuple(p) for p in r.pieces] for r in close.collect()} == {1: [(2.0, 4.0)], 2: [(2.0, 2.0), (4.0, 4.0)], 4: []}
    assert wide.columns == ["seg_id", "ordinal", "component", "distance_m"] and dict(parts.dtypes)["edges"] == "array<struct<cx:double,cy:double,dx:double,dy:double>>"
    sent = polygons._near(ways, parts, polygons.REACH)  # the box of the fifth comes near, its line does not
    assert sorted(r.seg_id for r in sent.collect()) == [1, 2, 3, 4]


def test_depth_profiles_are_shuffled_as_passages_alone(spark):
    """stations were shuffled three times; now passages are, once, and stations and depths are the same as by grouping rows."""
    import random

    from pyspark.sql import functions as F

    from pipeweave.operators import depth, restrict

    r, rows = random.Random(2), []
    for e in range(60):
        for p in range(r.randint(1, 5)):
            start = p * 9.0 + r.choice([0, 1, 2.5, r.random() * 4])
            rows.append((e, p, start, start + r.choice([0.0, 0.4, 3, 7.25, 14]), r.choice([1.05, 1.25, 1.6]), float(r.choice([30, 47, 60]))))
    passages = spark.createDataFrame(rows, "edge_id long, passage int, from_m double, to_m double, k double, length_m double")
    whole = F.expr("CASE WHEN ceil(from_m) <= floor(to_m) THEN sequence(ceil(from_m), floor(to_m)) ELSE array() END").cast("array<double>")
    stations = restrict.sections(passages).select("edge_id", "coefficient", F.explode(F.concat(F.array("from_m", "to_m"), whole)).alias("at_m")).groupBy("edge_id", "at_m").agg(F.max("coefficient").alias("weight"))
    want = depth.profiles(stations.withColumns({"lo": F.lit(0.7), "hi": F.when(F.col("weight") == 1.25, 2.42).otherwise(F.lit(float("inf")))}))
    got = depth.section_profiles(passages, bounded=1.25, most=2.42)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(got.collect()) == sorted(want.collect())
    assert depth.section_profiles(passages.limit(0), bounded=1.25, most=2.42).count() == 0
