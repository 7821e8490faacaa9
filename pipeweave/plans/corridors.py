"""Vertices for searches around obstacles. Their SQL works edge by edge, with shifted lines that are cut, and by recursion over zones that touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipeweave.functions import rules
from pipeweave.functions.rules import dn_sql, rule_sql
from pipeweave.operators import corridor
from pipeweave.plans.planning import rec
from pipeweave.plans.queries import query
from pipeweave.plans.scenes import scene
from pipeweave.plans.shapes import _foot
from pipeweave.storage import Scratch

_TYPES = ", ".join(f"'{t}'" for t in corridor.TYPES)
_FAR = "sqrt((x - {0}x) ** 2 + (y - {0}y) ** 2)"
_PLACE = "greatest(0.0, least(1.0, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) ** 2 + (ey - ay) ** 2)))"
_IN = "count(*) FILTER (WHERE (cy > {y}) <> (dy > {y}) AND {x} < cx + ({y} - cy) / (dy - cy) * (dx - cx)) % 2 = 1"
#: Ways, edges of obstacles, and what lies where: zones of each target, whose part holds it, and corners by cut lines.
_WAYS = f"""way AS MATERIALIZED (SELECT target, x, y, dn, width, ax + f * (ex - ax) AS qx, ay + f * (ey - ay) AS qy FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(sqrt((ax + f * (ex - ax) - x) ** 2 + (ay + f * (ey - ay) - y) ** 2), 9), ordinal, seq) AS n
        FROM (SELECT t.ordinal AS target, t.x, t.y, d.dn, d.width, l.ordinal, l.seq, l.ax, l.ay, l.ex, l.ey, {_PLACE} AS f FROM g_target t JOIN {dn_sql()} d ON d.idx = t.ordinal % 18 CROSS JOIN g_line l) q) q WHERE n = 1),
    e AS MATERIALIZED (SELECT g.ordinal, g.component, g.ring, g.seq, g.type, r.clearance AS base, cx, cy, dx, dy FROM g_part_edge g JOIN {rule_sql()} r ON r.type = g.type WHERE g.type IN ({_TYPES})),
    o AS MATERIALIZED (SELECT ordinal, component, any_value(type) AS type, any_value(base) AS base, min(cx) AS x0, min(cy) AS y0, max(cx) AS x1, max(cy) AS y1 FROM e GROUP BY ordinal, component),
    held AS MATERIALIZED (SELECT target, ordinal, component, x, y FROM (SELECT w.target, w.x, w.y, o.ordinal, o.component FROM way w JOIN o ON w.x BETWEEN o.x0 AND o.x1 AND w.y BETWEEN o.y0 AND o.y1) JOIN e USING (ordinal, component) GROUP BY target, ordinal, component, x, y HAVING {_IN.format(x="x", y="y")})"""
_ZONE = "CASE WHEN type <> 'oks' THEN base WHEN dn < 500 THEN 5 WHEN dn <= 800 THEN 7 ELSE 9 END + width / 2 + 0.01"


def _vertices(captured: str) -> str:
    """SQL from got (target, ordinal, reach) to the vertices."""
    return f"""{captured}, side AS (SELECT *, (dx - cx) / len AS ux, (dy - cy) / len AS uy, CASE WHEN (sum(cx * dy - dx * cy) OVER (PARTITION BY ordinal, component, ring) > 0) = (ring = 0) THEN 1 ELSE -1 END AS s FROM (SELECT *, sqrt((dx - cx) ** 2 + (dy - cy) ** 2) AS len FROM e) q),
    bent AS (SELECT *, coalesce(lag(ux) OVER w, last_value(ux) OVER v) AS px, coalesce(lag(uy) OVER w, last_value(uy) OVER v) AS py FROM side WINDOW w AS (PARTITION BY ordinal, component, ring ORDER BY seq), v AS (PARTITION BY ordinal, component, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    zone AS (SELECT DISTINCT ordinal, reach FROM got),
    cut AS (SELECT b.ordinal, z.reach, b.component, b.ring, b.seq, b.cx AS vx, b.cy AS vy, s, ux, uy, px, py, px * uy - py * ux AS turn, z.reach * ((uy - py) * uy + (ux - px) * ux) / (s * (px * uy - py * ux)) AS t FROM bent b JOIN zone z ON z.ordinal = b.ordinal WHERE abs(px * uy - py * ux) > 1e-9),
    moved AS (SELECT *, vx + reach * s * py + t * px AS mx, vy - reach * s * px + t * py AS my FROM cut),
    made AS (SELECT ordinal, reach, component, ring, seq, 0 AS side, mx AS x, my AS y FROM moved WHERE NOT (s * turn > 0 AND sqrt((mx - vx) ** 2 + (my - vy) ** 2) > 5 * reach)
        UNION ALL SELECT ordinal, reach, component, ring, seq, k, vx + reach * s * CASE k WHEN 1 THEN py ELSE uy END, vy - reach * s * CASE k WHEN 1 THEN px ELSE ux END FROM moved, (VALUES (1), (2)) AS ks(k) WHERE s * turn > 0 AND sqrt((mx - vx) ** 2 + (my - vy) ** 2) > 5 * reach),
    clear AS (SELECT m.ordinal, m.reach, m.component, m.ring, m.seq, m.side, m.x, m.y FROM made m JOIN e ON e.ordinal = m.ordinal AND e.component = m.component GROUP BY ALL HAVING NOT ({_IN.format(x="m.x", y="m.y")}) AND min({_foot("m.x", "m.y", "cx", "cy", "dx", "dy")}) >= m.reach - 1e-6),
    out AS (SELECT DISTINCT h.target, h.ordinal, h.x, h.y, g.reach FROM held h JOIN got g ON g.target = h.target AND g.ordinal = h.ordinal),
    foot AS (SELECT target, ordinal, x, y, reach, component, ring, seq, cx + f * (dx - cx) AS fx, cy + f * (dy - cy) AS fy FROM (SELECT o.*, e.component, e.ring, e.seq, cx, cy, dx, dy, {_PLACE.replace("ax", "cx").replace("ay", "cy").replace("ex", "dx").replace("ey", "dy")} AS f FROM out o JOIN e ON e.ordinal = o.ordinal) q),
    best AS (SELECT * FROM (SELECT *, {_FAR.format("f")} AS m, row_number() OVER (PARTITION BY target, ordinal ORDER BY round({_FAR.format("f")}, 9), component, ring, seq) AS n FROM foot) q WHERE n = 1 AND m > 0)
    SELECT g.target, g.ordinal, c.component, c.ring, c.seq, c.side, round(c.x, 4) AS x, round(c.y, 4) AS y FROM got g JOIN clear c ON c.ordinal = g.ordinal AND c.reach = g.reach
    UNION ALL SELECT target, ordinal, -1, -1, k, 0, round(fx + (fx - x) / m * (reach + k), 4), round(fy + (fy - y) / m * (reach + k), 4) FROM best, (VALUES (0), (2), (4), (6), (8)) AS ks(k)"""


_SIDE_OF = ", ".join(f"(v - s) * ({b} - t) - (w - t) * ({a} - s)" for a in ("-h", "m + h") for b in ("-h", "h"))
_CORRIDOR = f"""{_WAYS}, lane AS (SELECT *, (qx - x) / nullif(m, 0) AS ux, (qy - y) / nullif(m, 0) AS uy, least(1000.0, greatest(100.0, m / 4)) AS h FROM (SELECT *, {_FAR.format("q")} AS m FROM way) q),
    turned AS (SELECT target, dn, width, m, h, e.ordinal, e.type, e.base, (cx - x) * ux + (cy - y) * uy AS s, (cy - y) * ux - (cx - x) * uy AS t, (dx - x) * ux + (dy - y) * uy AS v, (dy - y) * ux - (dx - x) * uy AS w FROM (SELECT target, dn, width, m, h, x, y, coalesce(ux, 1) AS ux, coalesce(uy, 0) AS uy FROM lane) l
        JOIN e ON sqrt((cx - x) ** 2 + (cy - y) ** 2) <= m + 2 * h + 500),
    met AS (SELECT target, ordinal FROM turned WHERE least(s, v) <= m + h AND greatest(s, v) >= -h AND least(t, w) <= h AND greatest(t, w) >= -h AND NOT (least({_SIDE_OF}) > 0 OR greatest({_SIDE_OF}) < 0) UNION SELECT target, ordinal FROM held),
    got AS MATERIALIZED (SELECT m.target, m.ordinal, {_ZONE} AS reach FROM met m JOIN way w ON w.target = m.target JOIN (SELECT DISTINCT ordinal, type, base FROM o) k ON k.ordinal = m.ordinal)"""


def _apart(a: str, b: str) -> str:
    """SQL: distance of the edges (a.cx .. a.dy) and (b.cx .. b.dy), by signs of sides."""
    at = lambda p, i: (f"{p}.{i}x", f"{p}.{i}y")
    of = lambda p: (*at(p, "c"), *at(p, "d"))
    side = lambda p, i, q: f"sign(({q}.dx - {q}.cx) * ({p}.{i}y - {q}.cy) - ({q}.dy - {q}.cy) * ({p}.{i}x - {q}.cx))"
    feet = ", ".join(_foot(*at(p, i), *of(q)) for p, q in ((a, b), (b, a)) for i in "cd")
    return f"CASE WHEN {side(a, 'c', b)} <> {side(a, 'd', b)} AND {side(b, 'c', a)} <> {side(b, 'd', a)} THEN 0.0 ELSE least({feet}) END"


_NEAR_BOX = "b.x0 <= greatest(a.cx, a.dx) + 25 AND b.x1 >= least(a.cx, a.dx) - 25 AND b.y0 <= greatest(a.cy, a.dy) + 25 AND b.y1 >= least(a.cy, a.dy) - 25"
_CHASE = f"""{_WAYS}, box AS (SELECT *, least(cx, dx) AS x0, greatest(cx, dx) AS x1, least(cy, dy) AS y0, greatest(cy, dy) AS y1 FROM e),
    one AS (SELECT a.ordinal AS a, b.ordinal AS b, min({_apart("a", "b")}) AS m FROM e a JOIN box b ON a.ordinal < b.ordinal AND {_NEAR_BOX} GROUP BY a.ordinal, b.ordinal
        UNION ALL SELECT least(c.ordinal, e.ordinal), greatest(c.ordinal, e.ordinal), 0 FROM (SELECT c.ordinal, c.component, c.cx AS x, c.cy AS y, o.ordinal AS other, o.component AS part FROM e c JOIN o ON o.ordinal <> c.ordinal AND c.cx BETWEEN o.x0 AND o.x1 AND c.cy BETWEEN o.y0 AND o.y1) c
            JOIN e ON e.ordinal = c.other AND e.component = c.part GROUP BY c.ordinal, c.component, c.x, c.y, e.ordinal, e.component HAVING {_IN.format(x="c.x", y="c.y")}),
    touch AS MATERIALIZED (SELECT a, b, min(m) AS m FROM (SELECT a, b, m FROM one UNION ALL SELECT b, a, m FROM one) q GROUP BY a, b),
    near AS MATERIALIZED (SELECT w.target, e.ordinal, any_value(type) AS type, any_value(base) AS base, any_value(dn) AS dn, any_value(width) AS width FROM way w JOIN e ON abs(e.cx - w.x) <= 600 AND abs(e.cy - w.y) <= 600 GROUP BY w.target, e.ordinal, w.x, w.y HAVING min({_foot("w.x", "w.y", "cx", "cy", "dx", "dy")}) <= 500),
    win AS MATERIALIZED (SELECT target, ordinal, {_ZONE} AS reach, width FROM near),
    line AS (SELECT target, x AS cx, y AS cy, qx AS dx, qy AS dy FROM way),
    start AS (SELECT a.target, b.ordinal, min({_apart("a", "b")}) AS m FROM line a JOIN box b ON {_NEAR_BOX} GROUP BY a.target, b.ordinal UNION ALL SELECT target, ordinal, 0 FROM held),
    r AS (SELECT w.target, w.ordinal, w.reach FROM start s JOIN win w ON w.target = s.target AND w.ordinal = s.ordinal WHERE s.m <= w.reach + w.width / 2 + 2
        UNION SELECT n.target, n.ordinal, n.reach FROM r JOIN touch t ON t.a = r.ordinal JOIN win n ON n.target = r.target AND n.ordinal = t.b WHERE t.m <= r.reach + n.reach),
    got AS MATERIALIZED (SELECT * FROM r)"""


def _search(spark, sf_dir):
    scratch = Scratch(spark, "corridor")
    size = F.broadcast(rules.dn_table(spark).select("idx", "dn", "width"))  # 18 rows
    targets = scene(spark, sf_dir, "g_target").select(F.col("ordinal").alias("target"), "x", "y", (F.col("ordinal") % 18).alias("idx")).join(size, "idx").drop("idx")
    ways = scratch.keep(corridor.to_network(targets, scene(spark, sf_dir, "g_line"), scratch), "ways")
    return corridor.Search(scene(spark, sf_dir, "g_part_edge"), rules.rule_table(spark), scratch), ways


def _rounded(rows):
    return rows.selectExpr("target", "ordinal", "component", "ring", "seq", "side", "round(x, 4) AS x", "round(y, 4) AS y")


@query(rec(_vertices(_CORRIDOR), "g_target", "g_line", "g_part_edge"))
def corridor_vertices(spark, sf_dir):
    """Corners of the zones of all obstacles in a corridor around the straight way of each target to the network, and ways out of its own."""
    search, ways = _search(spark, sf_dir)
    return _rounded(search.vertices(ways, search.in_corridor(ways)))


@query(rec(_vertices(_CHASE), "g_target", "g_line", "g_part_edge"))
def chase_vertices(spark, sf_dir):
    """Corners of the zones that the straight way of each target touches, and of those that hang on them, within 500 m of the target."""
    search, ways = _search(spark, sf_dir)
    return _rounded(search.vertices(ways, search.in_chase(ways)))
