"""Golden values and edge cases of the engine's operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeweave.functions import geo, rules
from pipeweave.operators import depth, graph, network, restrict, search, ties
from pipeweave.sources import features, geojson


def one(spark, sql):
    return float(spark.sql(f"SELECT {sql} AS v").first().v)


@pytest.mark.parametrize("dn, want", [(50, 5.2), (400, 5.685), (500, 7.835), (800, 8.125), (900, 10.225), (1400, 10.725)])
def test_building_clearance(spark, dn, want):
    width = {r[0]: r[1] for r in rules.DN_ROWS}[dn]
    assert abs(one(spark, rules.axis_clearance("'oks'", str(dn), "5.0", str(width), "0.0")) - want) < 1e-9


@pytest.mark.parametrize("flow, length, want", [(3.5, 181, 50), (3.6, 181, 65), (3.5, 182, 65), (100, 1000, 200), (23000, 1, None), (1, 12000, None)])
def test_minimum_dn(spark, flow, length, want):
    rows = spark.createDataFrame([(float(flow), float(length))], "flow double, length_m double")
    assert network.minimum_dn(rows, rules.dn_table(spark)).first().dn == want


def test_scalar_rules(spark):
    assert one(spark, rules.penalty("20")) == 110_000_000
    assert abs(one(spark, rules.kgl("3.4D")) - 1.04) < 1e-12
    for a, b, want in (("2.0D", "3.0D", 1.0), ("3.0D", "4.0D", 1.05), ("2.0D", "4.0D", 1.025)):
        assert abs(one(spark, rules.ramp(a, b)) - want) < 1e-12


def test_projection(spark):
    e, n = geo.utm("37.6D", "55.75D")
    assert abs(one(spark, e) - 412125.4591875144) < 1e-3 and abs(one(spark, n) - 6179143.32361831) < 1e-3
    lon, lat = geo.wgs84("412125.4591875144D", "6179143.32361831D")
    assert abs(one(spark, lon) - 37.6) < 1e-9 and abs(one(spark, lat) - 55.75) < 1e-9


def decide(spark, boxes, segment=(0.0, 0.0, 40.0, 0.0), dn=50):
    segments = spark.createDataFrame([(1, *segment, dn, 0.4)], "seg_id long, ax double, ay double, ex double, ey double, dn int, width double")
    obstacles = spark.createDataFrame([(i, t, *map(float, b)) for i, (t, b) in enumerate(boxes)], "ordinal long, type string, x0 double, y0 double, x1 double, y1 double")
    judged = restrict.reasons(restrict.candidates(segments, obstacles, rules.rule_table(spark)))
    return restrict.decide(segments, judged).first(), [r.reason for r in judged.orderBy("ordinal").collect()], judged


def test_segment_decisions(spark):
    assert decide(spark, [])[0].status == "ALLOWED"
    assert decide(spark, [("park", (10, -1, 20, 1))])[1] == ["FORBIDDEN_INTERSECTION"]
    assert decide(spark, [("park", (10, 1.2, 20, 5))])[0].status == "ALLOWED"
    assert decide(spark, [("park", (10, 1.199, 20, 5))])[1] == ["CLEARANCE"]
    row, reasons, judged = decide(spark, [("road", (10, -5, 20, 5))])
    at = judged.first()
    assert row.status == "ALLOWED" and reasons == [None] and (at.from_m, at.to_m, at.angle) == (7.0, 23.0, 90.0)
    assert decide(spark, [("road", (-5, -5, 20, 5))])[1] == ["TOUCH_OVERLAP_OR_INCOMPLETE_CROSSING"]
    assert decide(spark, [("road", (1, -5, 20, 5))])[1] == ["SPECIAL_PASSAGE_OUTSIDE_SEGMENT"]
    row, _, _ = decide(spark, [("swamp", (10, -5, 20, 5))])
    assert row.status == "INDETERMINATE" and row.allowed is None
    assert decide(spark, [("swamp", (10, -5, 20, 5)), ("water", (17, -5, 18, 5))])[0].status == "BLOCKED"


def test_sections(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, 15.0, 1.6, 30.0), (1, 1, 10.0, 20.0, 1.75, 30.0)], "edge_id long, passage int, from_m double, to_m double, k double, length_m double")
    got = restrict.sections(rows).orderBy("from_m").collect()
    assert [(r.from_m, r.to_m, r.coefficient, r.active) for r in got] == [(0, 5, 1, 0), (5, 10, 1.6, 1), (10, 15, 1.75, 2), (15, 20, 1.75, 1), (20, 30, 1, 0)]
    assert [(r.from_m, r.to_m) for r in restrict.base_intervals(rows).orderBy("from_m").collect()] == [(0, 5), (20, 30)]


def test_knn_against_brute_force(spark):
    r = np.random.default_rng(7)
    xy = np.concatenate((r.integers(0, 50, (60, 2)), r.integers(900, 1000, (40, 2)))).astype(float)  # clusters and ties
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "ordinal long, x double, y double")
    got = {}
    for row in ties.knn(rows, 5, 20.0).collect():
        got.setdefault(row.ordinal, []).append((row["rank"], row.neighbour))
    for i, p in enumerate(xy):
        want = sorted((float(np.hypot(*(q - p))), j) for j, q in enumerate(xy) if j != i)[:5]
        assert [n for _, n in sorted(got[i])] == [j for _, j in want]


def test_attachments(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0, 100), (2, 0, 5.0, -5.0, 5.0, 5.0, 200), (3, 0, 10.0, 0.0, 10.0, 9.0, 50)], "ordinal long, seq int, ax double, ay double, ex double, ey double, dn int")
    points = spark.createDataFrame([(1, 5.0, 0.0), (2, 10.0, 0.0), (3, 50.0, 50.0), (4, 0.0, 0.0)], "chamber long, x double, y double")
    got = {r.chamber: (r.attachments, r.dn) for r in ties.attachments(points, lines, 0.01).collect()}
    assert got == {1: (4, 200), 2: (2, 100), 3: (0, None), 4: (1, 100)}


def test_noding_of_a_cross(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 20.0, 0.0), (2, 0, 10.0, -10.0, 10.0, 10.0)], "ordinal long, seq int, ax double, ay double, ex double, ey double")
    edges = network.noded(lines)
    assert edges.count() == 4 and network.degrees_of(edges).agg(F.max("degree")).first()[0] == 4


def test_subtree_flow_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i < 9 else "root", 1.0) for i in range(10)], "node string, parent string, flow double")
    assert {r.node: r.flow for r in network.subtree_flow(edges).collect()} == {f"n{i}": i + 1.0 for i in range(10)}


def test_deep_chains_and_cycles(spark):
    r = np.random.default_rng(3)
    order = [f"n{i}" for i in r.permutation(300)]
    rows = [(a, b, 1.0) for a, b in zip(order, [*order[1:], "root"], strict=True)]
    edges = spark.createDataFrame([rows[i] for i in r.permutation(300)], "node string, parent string, flow double")
    assert {x.node: (x.flow, x.nodes) for x in network.subtree_flow(edges).collect()} == {n: (i + 1.0, i + 1) for i, n in enumerate(order)}
    sized = spark.createDataFrame([(n, 100 if i else 500) for i, n in enumerate(order)], "node string, dn int")
    assert {x.dn for x in network.monotone_dn(edges, sized).collect()} == {500}
    with pytest.raises(ValueError, match="cycle"):
        network.paths_up(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "node string, parent string, flow double"), "root")


def feature(**p):
    g = p.pop("geometry", {"type": "Point", "coordinates": [37.6, 55.75]})
    return json.dumps({"type": "Feature", "properties": {"id": 1, "object_type": "source", **p}, "geometry": g})


def test_validation(spark):
    cases = [
        (feature(), None), ("{}", "$.type"), ("not json", "$"), ('{"a":1,"a":2}', "$"), (feature(id=None), "$.properties.id"), (feature(id=True), "$.properties.id"),
        (feature(object_type="heat_network"), "$.geometry.type"), (feature(object_type="oks_connection_point", flow_tph=0), None),
        (feature(object_type="oks_connection_point", flow_tph=-1), "$.properties.flow_tph"), (feature(object_type="oks_connection_point", flow_tph="10"), "$.properties.flow_tph"),
        (feature(geometry={"type": "Point", "coordinates": [181, 55]}), "$.geometry.coordinates"), (feature(geometry={"type": "Point", "coordinates": [37]}), "$.geometry.coordinates"),
        (feature(geometry={"type": "Point", "coordinates": [37, 55, 0, 1]}), "$.geometry.coordinates"),
        (feature(object_type="restriction", restriction_type=" ", geometry={"type": "Polygon", "coordinates": []}), "$.properties.restriction_type"),
        (feature(object_type="restriction", restriction_type="park", geometry={"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}), None),
        (feature(object_type="restriction", restriction_type="park", geometry={"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]}), "$.geometry.coordinates"),
    ]
    lines = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "ordinal long, line string")
    got = {r.ordinal: r.error_path for r in geojson.validate(geojson.decode(lines)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_ids(spark):
    rows = spark.createDataFrame([('"001"',), ("1.00",), ("123456789012345678901234567890",), ('""',), ("null",), (None,), ("[]",)], "raw string")
    got = [(r.id_json, r.id_key) for r in geojson.canonical_ids(rows, "raw").collect()]
    assert got == [('"001"', "s:001"), ("1", "n:1"), ("123456789012345678901234567890", "n:123456789012345678901234567890"), ('""', "s:"), (None, None), (None, None), (None, None)]


def test_lines_are_numbered_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.ndjson").write_text("".join(f"{k}-{i}\n" for i in range(50)))
    got = [(r.ordinal, r.line) for r in geojson.read_lines(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [(50 * k + i, f"{k}-{i}") for k in range(3) for i in range(50)]


def test_flood_and_walk():
    free = np.ones((31, 31), dtype=bool)
    free[5:26, 5] = free[5:26, 25] = free[5, 5:26] = free[25, 5:26] = False
    goals = np.zeros_like(free)
    goals[30, 15] = True
    assert not search.flood(free)[0].any() and search.walk(free, goals) is None
    free[25, 15] = True
    assert search.flood(free)[0].any()
    way = search.walk(free, goals)
    assert way[0] == (15, 15) and way[-1] == (30, 15) and all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(way, way[1:], strict=False))


def test_depth_profile():
    at = np.arange(0.0, 201.0)
    hi = np.where((at >= 98) & (at <= 102), 2.42, np.inf)
    h = depth.profile(at, np.ones_like(at), np.full_like(at, 0.7), hi)
    assert h[at <= 90].tolist() == [3.0] * 91 and (h[98:103] <= 2.42).all() and (np.abs(np.diff(h)) <= 0.1 + 1e-9).all()
    assert depth.profile(at, np.ones_like(at), np.full_like(at, 3.0), np.full_like(at, 2.0)) is None


def test_streams(spark, tmp_path):
    from pipeweave.streaming import requests

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text(feature() + "\n" + feature(id=None) + "\n")
    got = requests.drained(requests.validated_files(spark, str(tmp_path / "in")), "pw_files")
    assert sorted((r.error_path or "") for r in got.collect()) == ["", "$.properties.id"]


def test_routes():
    target, tie, none = np.array([40.0, 50.0]), np.array([[0.0, 50.0]]), np.zeros((0, 4))
    assert graph.astar(target, tie, none)[0] == [0, 1]
    way, at = graph.astar(target, tie, np.array([[15.0, 40.0, 25.0, 60.0]]))
    assert len(way) >= 3 and np.sqrt((np.diff(at[way], axis=0) ** 2).sum(axis=1)).sum() > 40
    assert graph.astar(target, tie, np.array([[35.0, 40.0, 45.0, 60.0]])) is None  # inside


def test_groups_and_cycles(spark):
    nodes = spark.range(30).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (21, 22), (20, 22)], "a long, b long")
    got = {r.root: (r.nodes, r.links, r.cyclic) for r in graph.cycles(nodes, links).collect()}
    assert got[0] == (10, 9, False) and got[20] == (3, 3, True) and got[15] == (1, 0, False) and len(got) == 19


def test_long_groups(spark):
    r = np.random.default_rng(5)
    order = [int(x) for x in r.permutation(700)]
    zigzag = [*range(1001, 1300, 2), *range(1298, 1000, -2)]
    links = [*zip(order, order[1:], strict=False), *zip(zigzag, zigzag[1:], strict=False)]
    nodes = spark.createDataFrame([(x,) for x in [*order, *zigzag, 5000]], "node long")
    got = {x.root: (x.nodes, x.links, x.cyclic) for x in graph.cycles(nodes, spark.createDataFrame([links[i] for i in r.permutation(len(links))], "a long, b long")).collect()}
    assert got == {0: (700, 699, False), 1001: (len(zigzag), len(zigzag) - 1, False), 5000: (1, 0, False)}


def test_features_out(spark):
    atoms = spark.createDataFrame([(1, 0, 50, 0.0, 0.0, 3.0, 4.0), (1, 1, 50, 3.0, 4.0, 6.0, 8.0), (1, 2, 65, 6.0, 8.0, 6.0, 9.0)], "path long, i int, dn int, ax double, ay double, ex double, ey double")
    rows = features.chains(atoms).orderBy("run").withColumn("wkb", features.wkb_line("xs", "ys")).collect()
    assert [(r.dn, r.length_m, r.xs) for r in rows] == [(50, 10.0, [0.0, 3.0, 6.0]), (65, 1.0, [6.0, 6.0])]
    assert rows[1].wkb.hex() == "000000000200000002" + "4018000000000000" "4020000000000000" "4018000000000000" "4022000000000000"
    lines = features.synthetic(spark, 20)
    assert geojson.validate(geojson.decode(lines)).where("error_path IS NOT NULL").count() == 0
