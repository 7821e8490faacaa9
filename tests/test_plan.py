"""Planned trees: the fixpoint of diameters and its invariants."""

from pyspark.sql import functions as F

from pipeweave.functions import rules
from pipeweave.operators import plan


def test_sizes_carry_flow_do_not_grow_and_are_not_too_long(spark):
    # A chain of four pipes of 150 m, DN 50 by flow: 600 m of DN 50 and of DN 100 in a row are too long; two branches at its end.
    rows = [(0, -1, 0.0, 150.0), (1, 0, 0.0, 150.0), (2, 1, 0.0, 150.0), (3, 2, 1.0, 150.0), (4, 3, 1.0, 20.0), (5, 3, 1.0, 30.0), (6, -1, 30000.0, 10.0), (7, -1, 20.0, 10.0)]
    pipes = spark.createDataFrame(rows, "node long, parent long, flow double, length_m double")
    got = {r.node: r.dn for r in plan.sized(pipes, plan.tree_paths(pipes), rules.dn_table(spark)).collect()}
    table = {r.dn: r for r in rules.dn_table(spark).collect()}
    parent = {n: p for n, p, _, _ in rows}
    assert got[6] is None and got[7] == 100
    for n in (0, 1, 2, 3, 4, 5):
        assert table[got[n]].capacity >= 1.0
        if parent[n] >= 0:
            assert got[n] <= got[parent[n]]
        run, at = 0.0, n
        while at >= 0 and got[at] == got[n]:
            run, at = run + rows[at][3], parent[at]
        assert run <= table[got[n]].max_length
    assert got[0] > 50


def test_depth_profiles(spark):
    knots = [("a", 0.0, 0.6), ("a", 10.0, 1.6), ("a", 11.0, 2.0), ("b", 0.0, 2.9), ("b", 5.0, 3.1), ("b", 6.0, 3.0), ("b", 8.0, 2.8)]
    found = plan.depth_violations(spark.createDataFrame(knots, "e string, s double, h double"), "e", "s", "h").collect()
    assert sorted((r.e, r.s, r.code) for r in found) == [("a", 0.0, "TOO_SHALLOW"), ("a", 11.0, "TOO_STEEP"), ("b", 5.0, "PAST_NORMAL_DEPTH")]


def test_likeness_and_choice(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4]), (3, [])], "v int, x array<int>")
    assert sorted((r.a, r.b, r.common, r.all_) for r in plan.jaccard(sets, "v", "x").collect()) == [(1, 2, 2, 4), (1, 3, 0, 3), (2, 3, 0, 3)]
    plans = spark.createDataFrame([(1, "x", 5, 0, 10.0), (2, "x", 9, 1, 1.0), (3, "x", 5, 0, 9.0), (4, "y", 1, 3, 1.0)], "plan int, area string, connected int, problems int, length_m double")
    assert {r.area: r.plan for r in plan.best_plan(plans, "area").collect()} == {"x": 3, "y": 4}
    cut = plan.cut_at_knots(spark.createDataFrame([("e", 0.0, 10.0, 1.5)], "e string, from_m double, to_m double, coefficient double"), spark.createDataFrame([("e", 0.0, 2.0), ("e", 4.0, 3.0), ("e", 10.0, 3.0)], "e string, at_m double, depth_m double"), "e")
    assert sorted((r.from_m, r.to_m, r.depth_m) for r in cut.collect()) == [(0.0, 4.0, 2.5), (4.0, 10.0, 3.0)] and cut.agg(F.sum("coefficient")).first()[0] == 3.0


def test_fewer_points_than_neighbours(spark):
    from pipeweave.operators import ties

    rows = spark.createDataFrame([(i, float(10**i), 0.0) for i in range(5)], "ordinal long, x double, y double")
    got = ties.knn(rows, 6, 20.0).collect()
    assert len(got) == 20 and {r.ordinal: r.neighbour for r in got if r["rank"] == 1} == {0: 1, 1: 0, 2: 1, 3: 2, 4: 3}
    assert ties.knn(rows.limit(1), 3, 20.0).count() == 0


def test_limits_of_documents():
    import pytest

    from pipeweave.sources import geojson

    assert geojson._decode("[" * 64 + "]" * 64)
    for bad in ("[" * 65 + "]" * 65, '"' + "x" * ((1 << 20) + 1) + '"', "[" * 100_000):
        with pytest.raises(ValueError):
            geojson._decode(bad)


def test_exhausted_searches_are_not_no_way():
    import numpy as np
    import pytest

    from pipeweave.operators import graph, search

    free = np.ones((41, 41), dtype=bool)
    goals = np.zeros_like(free)
    goals[0, 0] = True
    assert search.walk(free, goals)
    with pytest.raises(graph.Inconclusive):
        search.walk(free, goals, most=50)
    assert search.walk(free, np.zeros_like(free), most=10**6) is None
    with pytest.raises(graph.Inconclusive):
        graph.astar(np.array([100.0, 0.0]), np.array([[0.0, 0.0]]), np.array([[10.0, -50.0, 20.0, 50.0]]), most=1)


def test_sizes_send_no_table_through_the_driver(spark, monkeypatch):
    """trees of any number of pipes are sized without broadcasting them, and runs of risen DNs are as long as by the way in order."""
    import random

    from pipeweave.storage import Scratch

    rnd = random.Random(7)
    rows = [(i, -1 if i % 40 == 0 else rnd.randrange(max(i - 4, i - i % 40), i), rnd.choice([0.0, 1.0, 40.0, 9000.0]), float(rnd.randrange(20, 260))) for i in range(160)]
    pipes = spark.createDataFrame(rows, "node long, parent long, flow double, length_m double")
    plans, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df, name))
    up = plan.tree_paths(pipes)
    got = {r.node: r.dn for r in plan.sized(pipes, up, rules.dn_table(spark)).collect()}
    # Nothing but the table of DNs is broadcast: joins with it are on dn or capacity.
    lines = [line for text in plans for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert lines and all("[dn#" in line for line in lines) and len(got) == 160
    assert any(d is None for d in got.values()) and len(set(got.values())) > 4
    mono = pipes.join(spark.createDataFrame([(n, d) for n, d in got.items()], "node long, dn long"), "node")
    want = {r.node: r.length_m for r in plan.same_dn_length(mono, up).collect()}
    assert {r.node: r.length_m for r in plan._same_monotone(mono, up).collect()} == want
