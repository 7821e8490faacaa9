"""Queries on obstacles of any shape, with SQL that works edge by edge and shares no expression with the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeweave.functions import rules
from pipeweave.functions.rules import rule_sql
from pipeweave.operators import polygons
from pipeweave.plans.queries import query
from pipeweave.plans.scenes import _READS, _SIDE, _TYPE, SCENES, scene

# Corners of an L, of a hole in it, of a triangle beside it, and of a bent line, in quarters of width and height.
_CORNERS = """(0, 0, 0, 0.0, 0.0), (0, 0, 1, 4.0, 0.0), (0, 0, 2, 4.0, 2.0), (0, 0, 3, 2.0, 2.0), (0, 0, 4, 2.0, 4.0), (0, 0, 5, 0.0, 4.0), (0, 0, 6, 0.0, 0.0),
    (0, 1, 0, 0.5, 0.5), (0, 1, 1, 1.5, 0.5), (0, 1, 2, 1.5, 1.5), (0, 1, 3, 0.5, 1.5), (0, 1, 4, 0.5, 0.5), (1, 0, 0, 6.0, 1.0), (1, 0, 1, 9.0, 1.5), (1, 0, 2, 7.0, 4.0), (1, 0, 3, 6.0, 1.0),
    (2, 0, 0, -1.0, 0.0), (2, 0, 1, 3.0, 1.0), (2, 0, 2, 4.0, 5.0)"""
_LINES = "('gas_pipeline', 'power_cable')"
SCENES["g_part_edge"] = f"""SELECT ordinal, component, ring, seq, type, component <> 2 AS polygonal, cx, cy, dx, dy FROM (
    SELECT o.ordinal, o.type, v.component, v.ring, v.seq, o.x0 + v.x * o.w AS cx, o.y0 + v.y * o.h AS cy, lead(o.x0 + v.x * o.w) OVER (PARTITION BY o.ordinal, v.component, v.ring ORDER BY v.seq) AS dx,
        lead(o.y0 + v.y * o.h) OVER (PARTITION BY o.ordinal, v.component, v.ring ORDER BY v.seq) AS dy FROM (SELECT p_partkey AS ordinal, {_TYPE} AS type, CAST((p_partkey * 4241) % {_SIDE} AS DOUBLE) AS x0,
        CAST((p_partkey * 3559) % {_SIDE} AS DOUBLE) AS y0, CAST(p_size % 9 + 3 AS DOUBLE) AS w, CAST(p_size % 7 + 3 AS DOUBLE) AS h FROM part WHERE p_partkey % 11 < 10) o
    JOIN (SELECT CAST(component AS BIGINT) AS component, CAST(ring AS BIGINT) AS ring, CAST(seq AS BIGINT) AS seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES {_CORNERS}) AS t(component, ring, seq, x, y)) v
        ON (v.component = 2) = (o.type IN {_LINES}) AND (v.ring = 0 OR o.ordinal % 3 = 0) AND (v.component <> 1 OR o.ordinal % 4 = 0)) q WHERE dx IS NOT NULL"""
_READS["g_part_edge"] = ("part",)
#: Every segment, and for each building one that runs into it from the left.
SCENES["g_way"] = f"""SELECT seg_id, ax, ay, ex, ey, dn, width, CAST(NULL AS BIGINT) AS target, CAST(NULL AS BIGINT) AS tie FROM ({SCENES["g_segment"]}) s
    UNION ALL SELECT -1 - p_partkey AS seg_id, CAST((p_partkey * 4241) % {_SIDE} - 20 AS DOUBLE) AS ax, (p_partkey * 3559) % {_SIDE} + CAST(0.3 AS DOUBLE) + p_partkey % 5 AS ay, (p_partkey * 4241) % {_SIDE} + CAST(0.25 AS DOUBLE) * (p_partkey % 4) AS ex, (p_partkey * 3559) % {_SIDE} + CAST(0.3 AS DOUBLE) + p_partkey % 5 AS ey,
        50 AS dn, CAST(0.4 AS DOUBLE) AS width, p_partkey AS target, CAST(NULL AS BIGINT) AS tie FROM part WHERE p_partkey % 11 = 0"""
_READS["g_way"] = ("orders", "part")


def _pairs(spark, sf_dir, parts="true", ways="true"):
    return polygons.candidates(scene(spark, sf_dir, "g_way").where(ways), polygons.parts(scene(spark, sf_dir, "g_part_edge").where(parts)), rules.rule_table(spark))[0]


def _met(spark, sf_dir, found, parts="true", reach=polygons.REACH):
    return polygons.met(scene(spark, sf_dir, "g_way"), polygons.parts(scene(spark, sf_dir, "g_part_edge").where(parts)), rules.rule_table(spark), found, reach)


# The SQL cuts every edge on its own. u and v are the places on the segment and on the edge where their lines meet.
_NEAR = """near AS (SELECT s.seg_id, s.ax, s.ay, s.ex, s.ey, s.dn, s.width, s.target, e.ordinal, e.component, e.type, e.polygonal, e.cx, e.cy, e.dx, e.dy, sqrt((s.ex - s.ax) ** 2 + (s.ey - s.ay) ** 2) AS len,
        (s.ex - s.ax) * (e.dy - e.cy) - (s.ey - s.ay) * (e.dx - e.cx) AS det FROM g_way s JOIN (SELECT ordinal, component, min(least(cx, dx)) AS x0, max(greatest(cx, dx)) AS x1, min(least(cy, dy)) AS y0, max(greatest(cy, dy)) AS y1 FROM g_part_edge GROUP BY ordinal, component) b
        ON b.x0 <= greatest(s.ax, s.ex) + 12 AND b.x1 >= least(s.ax, s.ex) - 12 AND b.y0 <= greatest(s.ay, s.ey) + 12 AND b.y1 >= least(s.ay, s.ey) - 12 JOIN g_part_edge e ON e.ordinal = b.ordinal AND e.component = b.component),
    met AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif(det, 0) AS u, ((cx - ax) * (ey - ay) - (cy - ay) * (ex - ax)) / nullif(det, 0) AS v FROM near)"""


def _foot(px: str, py: str, a: str, b: str, c: str, d: str) -> str:
    """SQL: distance of a point to the segment from (a, b) to (c, d)."""
    t = f"greatest(0.0, least(1.0, (({px} - {a}) * ({c} - {a}) + ({py} - {b}) * ({d} - {b})) / (({c} - {a}) ** 2 + ({d} - {b}) ** 2)))"
    return f"sqrt(({a} + {t} * ({c} - {a}) - {px}) ** 2 + ({b} + {t} * ({d} - {b}) - {py}) ** 2)"


_TOUCH = "u BETWEEN -1e-12 AND 1 + 1e-12 AND v BETWEEN -1e-12 AND 1 + 1e-12"
_MEASURED = f"""{_NEAR}, measured AS (SELECT seg_id, ordinal, component, any_value(type) AS type, any_value(dn) AS dn, any_value(width) AS width, any_value(target) AS target, any_value(polygonal) AS polygonal, any_value(len) AS len,
        CASE WHEN any_value(polygonal) AND count(*) FILTER (WHERE (cy > ay) <> (dy > ay) AND ax < cx + (ay - cy) / (dy - cy) * (dx - cx)) % 2 = 1 THEN 0.0
        ELSE min(CASE WHEN {_TOUCH} THEN 0.0 ELSE least({_foot("ax", "ay", "cx", "cy", "dx", "dy")}, {_foot("ex", "ey", "cx", "cy", "dx", "dy")}, {_foot("cx", "cy", "ax", "ay", "ex", "ey")}, {_foot("dx", "dy", "ax", "ay", "ex", "ey")}) END) END AS distance_m,
        min({_foot("ex", "ey", "cx", "cy", "dx", "dy")}) AS end_m, count(*) FILTER (WHERE (cy > ey) <> (dy > ey) AND ex < cx + (ey - cy) / (dy - cy) * (dx - cx)) % 2 = 1 AS end_in FROM met GROUP BY seg_id, ordinal, component)"""
_CUT = f"""{_MEASURED}, cuts AS (SELECT DISTINCT seg_id, ordinal, component, m FROM (SELECT seg_id, ordinal, component, round(least(1, greatest(0, u)) * len, 9) AS m FROM met WHERE {_TOUCH}
        UNION ALL SELECT seg_id, ordinal, component, 0 FROM measured UNION ALL SELECT seg_id, ordinal, component, round(len, 9) FROM measured) c),
    steps AS (SELECT *, lead(m) OVER (PARTITION BY seg_id, ordinal, component ORDER BY m) AS till FROM cuts),
    runs AS (SELECT s.seg_id, s.ordinal, s.component, s.m, s.till, count(*) FILTER (WHERE (cy > ay + (m + till) / 2 / len * (ey - ay)) <> (dy > ay + (m + till) / 2 / len * (ey - ay))
        AND ax + (m + till) / 2 / len * (ex - ax) < cx + (ay + (m + till) / 2 / len * (ey - ay) - cy) / (dy - cy) * (dx - cx)) % 2 = 1 AS within
        FROM steps s JOIN near n ON n.seg_id = s.seg_id AND n.ordinal = s.ordinal AND n.component = s.component AND n.polygonal WHERE till - m > 1e-6 GROUP BY s.seg_id, s.ordinal, s.component, s.m, s.till)"""


@query(f"WITH {_MEASURED} SELECT seg_id, ordinal, component, round(distance_m, 5) AS distance_m FROM measured WHERE distance_m <= 12", "g_way", "g_part_edge")
def part_distance(spark, sf_dir):
    """Distances of segments to polygons with holes, second parts and lines."""
    return _met(spark, sf_dir, "distance_m").select("seg_id", "ordinal", "component", F.round("distance_m", 5).alias("distance_m"))


@query(f"WITH {_CUT} SELECT seg_id, ordinal, component, round(sum(till - m), 5) AS inside_m FROM runs WHERE within GROUP BY seg_id, ordinal, component", "g_way", "g_part_edge")
def part_inside(spark, sf_dir):
    """Metres of each segment inside each polygon, holes left out."""
    pairs = _met(spark, sf_dir, "pieces", "polygonal", reach=polygons.EPS).withColumn("inside_m", F.expr("aggregate(pieces, 0.0D, (a, p) -> a + p.t - p.f)"))
    return pairs.where("inside_m > 0").select("seg_id", "ordinal", "component", F.round("inside_m", 5).alias("inside_m"))


@query(
    f"WITH {_CUT}, sums AS (SELECT seg_id, ordinal, component, sum(till - m) AS inside_m, max(till) AS till, count(*) AS runs FROM runs WHERE within GROUP BY seg_id, ordinal, component), "
    "own AS (SELECT m.seg_id, m.ordinal, m.component FROM measured m LEFT JOIN sums s USING (seg_id, ordinal, component) WHERE m.ordinal = m.target AND m.polygonal "
    "AND ((end_m <= 1e-6 AND coalesce(inside_m, 0) <= 1e-6) OR (end_in AND runs = 1 AND abs(till - len) <= 1e-6 AND abs(inside_m - end_m) <= 1e-6))) "
    "SELECT m.seg_id, m.ordinal, m.component, CASE WHEN o.seg_id IS NOT NULL THEN 'own_approach' WHEN a.seg_id IS NOT NULL AND m.distance_m > 0 THEN 'own_part' END AS exempt FROM measured m "
    "LEFT JOIN own o ON o.seg_id = m.seg_id AND o.ordinal = m.ordinal AND o.component = m.component LEFT JOIN (SELECT DISTINCT seg_id, ordinal FROM own) a ON a.seg_id = m.seg_id AND a.ordinal = m.ordinal WHERE m.ordinal = m.target AND m.distance_m <= 12",
    "g_way", "g_part_edge",
)
def own_object_exemptions(spark, sf_dir):
    """Ways into the object that a segment serves: the shortest way in is free, and so are the object's other parts at a distance."""
    return polygons.exempted(_pairs(spark, sf_dir, ways="target is not null").where("ordinal = target")).select("seg_id", "ordinal", "component", "exempt")


@query(
    f"WITH {_MEASURED} SELECT m.seg_id, m.ordinal, count(DISTINCT round(u * len, 6)) AS cuts, round(min(u * len), 5) AS first_m, round(max(u * len), 5) AS last_m, round(min(degrees(acos(least(1.0, abs((ex - ax) * (dx - cx) + (ey - ay) * (dy - cy)) / (len * sqrt((dx - cx) ** 2 + (dy - cy) ** 2)))))), 4) AS angle "
    f"FROM met m JOIN {rule_sql()} r ON r.type = m.type WHERE r.special AND NOT polygonal AND u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 GROUP BY m.seg_id, m.ordinal",
    "g_way", "g_part_edge",
)
def line_events(spark, sf_dir):
    """Crossings of line obstacles: how many, the first and last, and the least angle."""
    found = polygons.events(polygons.exempted(_pairs(spark, sf_dir, "not polygonal")))
    return found.groupBy("seg_id", "ordinal").agg(F.count(F.lit(1)).alias("cuts"), F.round(F.min("from_m"), 5).alias("first_m"), F.round(F.max("to_m"), 5).alias("last_m"), F.round(F.min("angle"), 4).alias("angle"))


@query(None)
def part_status(spark, sf_dir):
    """All decisions: exemptions, passages, what is left beside passages, unknown types. Tests hold it against small scenes."""
    return polygons.decide(scene(spark, sf_dir, "g_way"), polygons.parts(scene(spark, sf_dir, "g_part_edge")), rules.rule_table(spark))


@query(None)
def residual_clearance(spark, sf_dir):
    """Special parts that a segment comes too near to beside its allowed passages through them, each with the reason that part_status has for it."""
    pairs = polygons.exempted(_pairs(spark, sf_dir))
    return polygons.residual(pairs, polygons.events(pairs))


NEW = ("part_distance", "part_inside", "own_object_exemptions", "line_events", "part_status", "residual_clearance")
