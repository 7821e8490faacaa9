"""Depths of forests against exhaustive search and the known small cases."""

import itertools
import random

import numpy as np
import pytest

from pipeweave.functions.rules import DN_ROWS, SLOPE, allowed_depths
from pipeweave.operators import tree_depth
from pipeweave.operators.depth import factor, ramp
from pipeweave.operators.network import chains
from pipeweave.operators.tree_depth import PULL, Edge, Levels, backward, make_levels, oriented, tree_depths

SIZE = {r[0]: r for r in DN_ROWS}
SCHEMA = f"node long, parent long, length_m double, rate double, height double, sections array<{tree_depth.SECTION}>"


def pipe(node, parent, length, dn, *passages):
    """passages: type, from, to, coefficient, DN of an existing network."""
    return (node, parent, float(length), float(SIZE[dn][5]), SIZE[dn][2], [(float(f), float(t), k, True, [kind], [SIZE[e][2] if e else None]) for kind, f, t, k, e in passages])


def solve(spark, rows, **more):
    return {r.node: r for r in tree_depths(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def depth_at(knots, x):
    return float(np.interp(x, [k.at_m for k in knots], [k.depth_m for k in knots]))


def legal(row, knots):
    for a, b in itertools.pairwise(knots):
        assert abs(a.depth_m - b.depth_m) <= SLOPE * (b.at_m - a.at_m) + 1e-6
    assert all(k.depth_m >= 0.7 - 1e-9 for k in knots)
    for f, t, _, _, (kind,), (existing,) in row[5]:
        depths = [depth_at(knots, x) for x in np.linspace(f, t, 21)]
        assert any(all(lo - 1e-6 <= h <= hi + 1e-6 for h in depths) for lo, hi in allowed_depths(kind, row[4], existing))
        assert not any(f + 1e-6 < k.at_m < t - 1e-6 and abs(k.depth_m - 3) > 1e-9 for k in knots)


def test_known_cases(spark):
    rows = [
        pipe(1, -1, 100, 100),
        pipe(2, -2, 100, 100, ("road", 40, 60, 1.6, None)),
        pipe(3, -3, 200, 100, ("gas_pipeline", 98, 102, 1.25, None)),
        pipe(4, -4, 60, 100, ("gas_pipeline", 1, 5, 1.25, None)),
        pipe(5, -5, 400, 1400, ("power_cable", 200, 204, 1.15, None)),
        pipe(6, -6, 200, 200, ("heat_network", 98, 102, 1.05, 200)),
        pipe(7, -7, 300, 100, ("heat_network", 148, 152, 1.05, 1400)),
        pipe(8, -8, 200, 200, ("heat_network", 50, 110, 1.05, 200)),
        pipe(9, -9, 12, 1400, ("power_cable", 0, 4, 1.15, None), ("heat_network", 5, 12, 1.05, 1400)),
        pipe(10, 11, 5, 50), pipe(11, 10, 5, 50),  # a cycle
        pipe(12, 14, 5, 50), pipe(13, 12, 5, 50), pipe(14, 12, 5, 50), pipe(15, 12, 5, 50),  # one with branches
    ]
    got = solve(spark, rows)
    assert len(got) == len(rows)
    for r in rows[:9]:
        assert got[r[0]].feasible
        legal(r, got[r[0]].knots)
    assert [tuple(k) for k in got[1].knots] == [(0.0, 3.0), (100.0, 3.0)]
    assert depth_at(got[2].knots, 50) == pytest.approx(3)
    assert depth_at(got[3].knots, 100) <= 2.42 + 1e-9 and len(got[3].knots) <= 6
    assert got[3].from_depth == got[3].to_depth == 3 and max(k.depth_m for k in got[3].knots) == 3
    assert depth_at(got[5].knots, 202) >= 3.4 - 1e-9
    assert depth_at(got[6].knots, 100) <= 2.185 + 1e-9
    assert depth_at(got[9].knots, 6) >= 5.1 - 1e-9  # the cable lets nothing above it, and a metre is too short to come up
    assert not any(got[i].feasible for i in range(10, 16)) and got[10].knots is None


def exhaustive(rows, values, step, fine):
    """The least cost of a tree over all levels of all stations; rows from the root on."""
    edges = {r[0]: (Edge(dict(zip(("node", "parent", "length_m", "rate", "height"), r[:5])) | {"sections": [dict(zip(("from_m", "to_m", "coefficient", "special", "types", "heights"), s)) for s in r[5]]}, step, fine), r) for r in rows}
    stations = [("top", None)] + [(n, k) for n, (e, _) in edges.items() for k in range(1, len(e.at))]
    place = {s: i for i, s in enumerate(stations)}
    best = np.inf
    for levels in itertools.product(values, repeat=len(stations)):
        cost = 0.0
        for n, (e, r) in edges.items():
            start = place[("top", None)] if r[1] < 0 else place[(r[1], len(edges[r[1]][0].at) - 1)]
            h = np.array([levels[start], *[levels[place[(n, k)]] for k in range(1, len(e.at))]])
            d = np.diff(e.at)
            if (np.abs(np.diff(h)) > SLOPE * d + 1e-9).any():
                break
            for f, t, _, _, (kind,), (existing,) in r[5]:
                here = h[(e.at >= f - 1e-9) & (e.at <= t + 1e-9)]
                if not any(all(lo - 1e-9 <= x <= hi + 1e-9 for x in here) for lo, hi in allowed_depths(kind, r[4], existing)):
                    break
            else:
                cost += float((d * (e.weight * ramp(h[:-1], h[1:]) + e.rate * PULL * (abs(h[:-1] - 3) + abs(h[1:] - 3)) / 2)).sum())
                continue
            break
        else:
            best = min(best, cost)
    return best


def test_cost_of_random_trees_equals_exhaustive_search(spark):
    r = random.Random(3)
    feasible = 0
    for trial in range(5):
        rows = []
        for i in range(1, 9 if trial == 0 else 5):
            some = [(r.choice(["road", "gas_pipeline", "heat_network"]), 0, 12, 1.25, 65)] if trial and r.random() < 0.5 else []
            rows.append(pipe(i, -1 if i == 1 else r.randint(1, i - 1), 12, r.choice([50, 400]), *some))
        grid = 2.5
        while True:
            edges = [Edge(dict(zip(("node", "parent", "length_m", "rate", "height"), x[:5])) | {"sections": [dict(zip(("from_m", "to_m", "coefficient", "special", "types", "heights"), s)) for s in x[5]]}, 12.0, 12.0) for x in rows]
            values = make_levels({v for e in edges for v in e.critical()}, grid)
            if len(values) ** (1 + sum(len(e.at) - 1 for e in edges)) <= 40_000:
                break
            if len(rows) == 1:
                rows = [(*rows[0][:5], [])]
            else:
                rows = rows[:-1]
        got = solve(spark, rows, step=12.0, grid=grid, run=2)
        want = exhaustive(rows, values, 12.0, 12.0)
        if np.isfinite(want):
            feasible += 1
            assert sum(x.cost for x in got.values()) == pytest.approx(want, rel=1e-9)
        else:
            assert not any(x.feasible for x in got.values())
    assert feasible >= 2


def test_nodes_have_one_depth(spark):
    r = random.Random(7)
    rows = []
    for i in range(1, 60):
        some = [(r.choice(["road", "gas_pipeline", "power_cable", "heat_network"]), 20, 24, 1.25, 100)] if r.random() < 0.4 else []
        rows.append(pipe(i, -1 if i == 1 else (i - 1 if r.random() < 0.6 else r.randint(1, i - 1)), r.randint(40, 60), r.choice([50, 100, 300]), *some))
    whole, cut = solve(spark, rows, grid=0.05), solve(spark, rows, grid=0.05, run=3)
    for row in rows[:59]:
        got = whole[row[0]]
        assert got.feasible
        legal(row, got.knots)
        assert got.from_depth == (whole[row[1]].to_depth if row[1] > 0 else whole[1].from_depth)
        assert cut[row[0]].cost == pytest.approx(got.cost, rel=1e-9)


def test_what_no_depth_fits_is_infeasible_and_all_below():
    import pyarrow as pa

    e = {"node": 5, "parent": 1, "length_m": 4.0, "rate": 1.0, "height": 0.1, "sections": []}
    values = [1.0, 2.0, 3.0]
    up = tree_depth._upward(values, 1.0, 0.1)(iter([pa.RecordBatch.from_pylist([{"top": 1, "below": [float("inf")] * 3, "pipes": [e]}])]))
    assert next(up).to_pylist() == [{"top": 1, "cost": [float("inf")] * 3}]
    rows = [{"bottom": 6, "below": None, "pipes": [e, e | {"node": 6, "parent": 5}], "level": level} for level in (-1, None)]
    down = tree_depth._downward(values, 1.0, 0.1)(pa.RecordBatch.from_pylist([r]) for r in rows)
    got = [r for b in down for r in b.to_pylist()]
    assert [r["node"] for r in got] == [5, 6, 5, 6] and not any(r["feasible"] for r in got) and all(r["level"] == -1 for r in got)


def test_nothing_and_odd_rows(spark):
    assert tree_depths(spark.createDataFrame([], SCHEMA)).count() == 0
    got = solve(spark, [(1, -1, 10.0, 1.0, 0.1, None), (2, 1, 10.0, 1.0, 0.1, []), (3, 1, 10.0, 1.0, 0.1, [(-5.0, 3.0, 1.25, True, ["gas_pipeline"], None), (9.0, 99.0, 1.0, False, None, None), (5.0, 5.0, 2.0, True, ["road"], [None])])])
    assert all(x.feasible for x in got.values()) and got[3].from_depth <= 2.5 + 1e-9


def test_chains(spark):
    r = random.Random(9)
    parent = {i: (i - 1 if r.random() < 0.8 else r.randint(0, i - 1)) for i in range(1, 300)}
    parent |= {1000: 1001, 1001: 1000}
    edges = spark.createDataFrame([(n, p) for n, p in parent.items()], "node long, parent long")
    got = {x.node: (x.head, x.rank) for x in chains(edges).collect()}
    n_children = {p: list(parent.values()).count(p) for p in parent.values()}
    for n in range(1, 300):
        head, rank = n, 0
        while parent[head] in parent and n_children[parent[head]] == 1:
            head, rank = parent[head], rank + 1
        assert got[n] == (head, rank)
    assert 1000 not in got


def test_oriented(spark):
    rows = [(1, 10, 11), (2, 12, 11), (3, 12, 13), (4, 13, 10), (5, 20, 21), (6, 11, 11), (7, 30, None)]
    pipes = spark.createDataFrame(rows, "pipe long, a long, b long")
    got = sorted(map(tuple, oriented(pipes, spark.createDataFrame([(10,), (None,)], "node long")).collect()))
    assert got == [(1, 10, 11, True), (2, 11, 12, False), (4, 10, 13, False)]
    assert oriented(pipes, spark.createDataFrame([], "node long")).count() == 0


def test_costs_fall_with_finer_levels():
    e = Edge({"length_m": 80.0, "rate": 1.0, "height": 0.4, "sections": [{"from_m": 40.0, "to_m": 44.0, "coefficient": 1.25, "special": True, "types": ["gas_pipeline"], "heights": None}]}, 1.0, 0.1)
    coarse, fine = (backward(e, np.zeros(len(v)), Levels(v))[0].min() for v in (make_levels(e.critical(), g) for g in (0.1, 0.01)))
    assert fine <= coarse + 1e-9 and fine == pytest.approx(80 + 4 * 0.25, abs=1e-3)
    assert factor(np.array([4.0])) == pytest.approx(1.1)


@pytest.mark.parametrize(("grid", "step"), [(0.05, 1.0), (0.3, 5.0)])
def test_pipes_side_by_side_are_costed_as_each_alone(grid, step):
    """one pass over whole arrays for many pipes gives each the costs and the levels that it has alone."""
    r, edges, fine = random.Random(11), [], min(step, grid / SLOPE)
    kinds = {"heat_network": 1.05, "power_cable": 1.15, "gas_pipeline": 1.25, "road": 1.6, "tram_tracks": 1.75, "none": 1.3}
    for i in range(30):
        dn, some = r.choice([50, 125, 200, 700]), []
        for at in range(r.randint(0, 5)):
            kind, start = r.choice([*kinds]), at * 14 + r.random() * 9
            some.append({"from_m": start, "to_m": start + r.random() * 12, "coefficient": kinds[kind], "special": r.random() < 0.7, "types": None if kind == "none" else [kind], "heights": None if kind == "none" else [r.choice([None, 0.005, 0.3])]})
        edges.append(Edge({"length_m": float(r.randint(5, 190)), "rate": float(SIZE[dn][5]), "height": SIZE[dn][2], "sections": some}, step, fine))
    levels = Levels(make_levels({v for e in edges for v in e.critical()}, grid))
    below = np.array([[r.random() * 1e5 if i % 3 else 0.0 for _ in levels.h] for i in range(len(edges))])
    way = []
    got = tree_depth.climb(edges, below, levels, fine, way)
    tops = [int(np.argmin(x)) for x in got]
    for e, low, cost, top, path in zip(edges, below, got, tops, tree_depth.descend(edges, tops, levels, way), strict=True):
        want, choice = backward(e, low, levels)
        assert (np.isfinite(cost) == np.isfinite(want)).all() and np.allclose(cost[np.isfinite(want)], want[np.isfinite(want)], rtol=1e-11)
        if np.isfinite(cost[top]):
            levels_of = [top]
            for c in choice:
                levels_of.append(int(c[levels_of[-1]]))
            assert path.tolist() == levels_of


def test_sums_of_branches_over_batches():
    """costs of one node may come in several batches."""
    import pyarrow as pa

    given = [([1, 1, 2], [[1.0, 2.0]] * 3), ([2], [[5.0, float("inf")]]), ([], []), ([2, 7], [[1.0, 1.0]] * 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(c, pa.list_(pa.float64()))], ["top", "cost"]) for t, c in given]
    got = [r for b in tree_depth._summed(iter(batches)) for r in b.to_pylist()]
    assert got == [{"top": 1, "cost": [2.0, 4.0]}, {"top": 2, "cost": [7.0, float("inf")]}, {"top": 7, "cost": [1.0, 1.0]}]


def test_depths_do_not_depend_on_how_large_the_plan_is(spark):
    """beyond 40 000 stations levels were 2.5 cm apart, beyond 200 000 five."""
    one = pipe(1, -1, 120, 125, ("gas_pipeline", 60, 64, 1.25, None))
    alone, among = solve(spark, [one])[1], solve(spark, [one, *[pipe(i, -i, 1000, 100) for i in range(2, 43)]])[1]
    assert alone == among
