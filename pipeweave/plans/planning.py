"""Queries on planned networks, their validation and export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pipeweave.functions import geo, rules
from pipeweave.functions.rules import dn_sql
from pipeweave.operators import network, plan, restrict, ties
from pipeweave.operators.cells import per_place
from pipeweave.operators.graph import box_links, groups
from pipeweave.plans.queries import _STEPS, QUERIES, query
from pipeweave.plans.scenes import _READS, SCENES, scene, with_scenes

S, P = restrict.S, ties.P

#: A forest of pipes: runs of four in a row, whose first hangs on an earlier pipe; every fourth ends at a consumer.
SCENES["g_pipe"] = f"""SELECT p.node, p.parent, p.flow, p.length_m, d.dn FROM (SELECT c_custkey AS node, CASE WHEN c_custkey % 64 = 0 THEN -1 WHEN c_custkey % 4 <> 0 THEN c_custkey - 1 ELSE CAST(floor(c_custkey / 8.0) AS BIGINT) END AS parent,
        CAST(CASE WHEN c_custkey % 4 = 3 THEN 1 + c_nationkey % 7 ELSE 0 END AS DOUBLE) AS flow, CAST(20 + (c_custkey * 13) % 180 AS DOUBLE) AS length_m FROM customer) p JOIN {dn_sql()} d ON d.idx = CAST(floor(p.node / 4.0) AS BIGINT) % 5 + 3"""
_READS["g_pipe"] = ("customer",)


def rec(body: str, *scenes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SCENES[n]})" for n in scenes) + ", " + body


_UP = "up AS (SELECT node, node AS above, 0 AS depth FROM g_pipe UNION ALL SELECT up.node, p.parent, depth + 1 FROM up JOIN g_pipe p ON p.node = up.above WHERE p.parent >= 0)"
_CONSUMERS = f"{_UP}, served AS (SELECT above AS node, count(DISTINCT p.node) AS consumers, min(p.node) AS least, max(p.node) AS most, sum(p.flow) AS flow FROM up JOIN g_pipe p ON p.node = up.node WHERE p.flow > 0 GROUP BY above)"


def _pipes(spark, sf_dir):
    return scene(spark, sf_dir, "g_pipe")


@query(rec(f"{_CONSUMERS} SELECT node, consumers, least, most, flow FROM served", "g_pipe"))
def edge_consumers(spark, sf_dir):
    pipes = _pipes(spark, sf_dir)
    return plan.consumers(pipes, plan.tree_paths(pipes))


@query(
    rec(
        f"{_CONSUMERS}, sets AS (SELECT above AS node, string_agg(CAST(p.node AS VARCHAR), ',' ORDER BY p.node) AS s FROM up JOIN g_pipe p ON p.node = up.node WHERE p.flow > 0 GROUP BY above), "
        "heads AS (SELECT u.node, arg_max(u.above, u.depth) AS head FROM up u JOIN sets a ON a.node = u.node JOIN sets b ON b.node = u.above WHERE a.s = b.s GROUP BY u.node) "
        "SELECT head, count(*) AS pipes, sum(p.length_m) AS length_m, max(s.flow) AS flow FROM heads h JOIN g_pipe p ON p.node = h.node JOIN served s ON s.node = h.node GROUP BY head",
        "g_pipe",
    )
)
def equal_consumer_components(spark, sf_dir):
    pipes = _pipes(spark, sf_dir)
    return plan.components(pipes, plan.tree_paths(pipes))


@query(
    rec(
        "walk AS (SELECT node, parent AS next, dn, length_m FROM g_pipe UNION ALL SELECT w.node, p.parent, w.dn, w.length_m + p.length_m FROM walk w JOIN g_pipe p ON p.node = w.next AND p.dn = w.dn) SELECT node, max(length_m) AS length_m FROM walk GROUP BY node",
        "g_pipe",
    )
)
def same_dn_from_root(spark, sf_dir):
    pipes = _pipes(spark, sf_dir)
    return plan.same_dn_length(pipes, plan.tree_paths(pipes))


@query(None)
def sized_tree(spark, sf_dir):
    """Diameters of the forest by the fixpoint of flow, order and length. Tests hold its invariants."""
    pipes = _pipes(spark, sf_dir)
    return plan.sized(pipes, plan.tree_paths(pipes), rules.dn_table(spark))


@query(
    "WITH c AS (SELECT p.*, (SELECT count(*) FROM g_pipe q WHERE q.parent = p.node) AS n, (SELECT max(dn) FROM g_pipe q WHERE q.parent = p.node) AS hi, (SELECT count(*) FROM g_pipe q WHERE q.parent = p.node AND q.dn <> p.dn) AS other FROM g_pipe p) "
    "SELECT node, 1 + n AS degree, CASE WHEN hi > dn THEN hi ELSE dn END AS dn, CASE WHEN parent = -1 OR n >= 2 THEN 'chamber' WHEN flow > 0 THEN 'oks' WHEN other > 0 THEN 'technical' ELSE 'joint' END AS kind FROM c",
    "g_pipe",
)
def plan_nodes(spark, sf_dir):
    return plan.node_kinds(_pipes(spark, sf_dir))


@query(rec(f"{_UP} SELECT node, parent FROM g_pipe WHERE node NOT IN (SELECT node FROM up WHERE above % 37 = 5)", "g_pipe"))
def stranded_removal(spark, sf_dir):
    pipes = _pipes(spark, sf_dir)
    return plan.stranded(pipes, pipes.where("node % 37 = 5"), plan.tree_paths(pipes)).select("node", "parent")


_TREES = f"{_UP}, tops AS (SELECT u.node, u.above AS tree FROM up u JOIN g_pipe p ON p.node = u.above WHERE p.parent = -1)"


def _trees(spark, sf_dir):
    pipes = _pipes(spark, sf_dir)
    return plan.tree_paths(pipes).join(pipes.where("parent = -1").select(F.col("node").alias("above")), "above").select("node", F.col("above").alias("tree")), pipes


@query(
    rec(
        f"{_TREES} SELECT tree, count(*) FILTER (WHERE flow > 0) AS targets, count(*) FILTER (WHERE flow > 0 AND flow <= 5) AS connected, CASE WHEN count(*) FILTER (WHERE flow > 0 AND flow <= 5) = 0 THEN 'NO_FEASIBLE_NETWORK' "
        "WHEN count(*) FILTER (WHERE flow > 5) > 0 THEN 'PARTIAL' ELSE 'PLANNED' END AS status FROM tops JOIN g_pipe USING (node) GROUP BY tree",
        "g_pipe",
    )
)
def plan_status(spark, sf_dir):
    """A tree whose consumers of up to 5 t/h count as connected."""
    top, pipes = _trees(spark, sf_dir)
    per = top.join(pipes, "node").groupBy("tree").agg(F.count_if(F.expr("flow > 0")).alias("targets"), F.count_if(F.expr("flow > 0 and flow <= 5")).alias("connected"))
    return per.withColumn("status", F.expr("CASE WHEN connected = 0 THEN 'NO_FEASIBLE_NETWORK' WHEN connected < targets THEN 'PARTIAL' ELSE 'PLANNED' END"))


@query(
    rec(
        f"{_TREES}, plans AS (SELECT tree AS plan, tree % 5 AS area, count(*) FILTER (WHERE flow > 0) AS connected, count(*) FILTER (WHERE length_m > 190) AS problems, sum(length_m) AS length_m FROM tops JOIN g_pipe USING (node) GROUP BY tree) "
        "SELECT area, plan, connected, problems, length_m FROM plans p WHERE NOT EXISTS (SELECT 1 FROM plans q WHERE q.area = p.area AND (q.problems > 0, -q.connected, q.problems, q.length_m, q.plan) < (p.problems > 0, -p.connected, p.problems, p.length_m, p.plan))",
        "g_pipe",
    )
)
def plan_choice(spark, sf_dir):
    top, pipes = _trees(spark, sf_dir)
    plans = top.join(pipes, "node").groupBy("tree").agg(F.count_if(F.expr("flow > 0")).alias("connected"), F.count_if(F.expr("length_m > 190")).alias("problems"), F.sum("length_m").alias("length_m"))
    return plan.best_plan(plans.select(F.col("tree").alias("plan"), F.expr("tree % 5").alias("area"), "connected", "problems", "length_m"), "area")


@query(
    f"SELECT c.ordinal AS chamber, l.ordinal, l.seq FROM g_chamber c, g_line l WHERE {geo.point_segment(('c.x', 'c.y'), S)} <= 0.05 AND {geo.distance(('c.x', 'c.y'), ('ax', 'ay'))} > 0.05 AND {geo.distance(('c.x', 'c.y'), ('ex', 'ey'))} > 0.05",
    "g_chamber", "g_line",
)
def node_on_line(spark, sf_dir):
    """Chambers that lie on a line which does not end there."""
    near = ties.near_lines(scene(spark, sf_dir, "g_chamber").select(F.col("ordinal").alias("chamber"), "x", "y"), scene(spark, sf_dir, "g_line"), 0.05)
    return near.where(f"{geo.distance(P, ('ax', 'ay'))} > 0.05 AND {geo.distance(P, ('ex', 'ey'))} > 0.05").select("chamber", "ordinal", "seq")


@query(
    f"WITH t AS (SELECT ordinal, CASE WHEN ordinal % 41 = 0 THEN NULL WHEN ordinal % 43 = 0 THEN flow * 1000 ELSE flow END AS flow, CAST(100 + (ordinal * 37) % 15000 AS DOUBLE) AS length_m FROM g_target) SELECT ordinal, (SELECT min(dn) FROM {dn_sql()} d WHERE d.capacity + 1e-9 >= t.flow AND d.max_length + 1e-6 >= t.length_m) AS dn, "
    f"CASE WHEN flow IS NULL OR flow < 0 THEN 'MISSING_OR_INVALID_FLOW' WHEN flow > 22501.9 + 1e-9 THEN 'FLOW_EXCEEDS_TABLE' WHEN NOT EXISTS (SELECT 1 FROM {dn_sql()} d WHERE d.capacity + 1e-9 >= t.flow AND d.max_length + 1e-6 >= t.length_m) THEN 'ROUTE_EXCEEDS_MAXIMUM_LENGTH' END AS reason FROM t",
    "g_target",
)
def target_diameters(spark, sf_dir):
    """The least DN for each target's flow and length of way, or why there is none."""
    t = scene(spark, sf_dir, "g_target").select("ordinal", F.expr("CASE WHEN ordinal % 41 = 0 THEN NULL WHEN ordinal % 43 = 0 THEN flow * 1000 ELSE flow END").alias("flow"), F.expr("100 + (ordinal * 37) % 15000").cast("double").alias("length_m"))
    out = network.minimum_dn(t, rules.dn_table(spark))
    most = rules.dn_table(spark).agg(F.max("capacity")).first()[0]
    reason = F.when(F.col("flow").isNull() | (F.col("flow") < 0), "MISSING_OR_INVALID_FLOW").when(F.col("flow") > most + 1e-9, "FLOW_EXCEEDS_TABLE").when(F.col("dn").isNull(), "ROUTE_EXCEEDS_MAXIMUM_LENGTH")
    return out.select("ordinal", "dn", reason.alias("reason"))


def _with_reasons(spark, sf_dir):
    return QUERIES["target_diameters"](spark, sf_dir).where("reason is not null")


_REASONS = f"r AS (SELECT ordinal, CASE WHEN ordinal % 41 = 0 THEN 'MISSING_OR_INVALID_FLOW' WHEN ordinal % 43 = 0 AND flow * 1000 > 22501.9 + 1e-9 THEN 'FLOW_EXCEEDS_TABLE' WHEN NOT EXISTS (SELECT 1 FROM {dn_sql()} d WHERE d.capacity + 1e-9 >= flow * (CASE WHEN ordinal % 43 = 0 THEN 1000 ELSE 1 END) AND d.max_length + 1e-6 >= 100 + (ordinal * 37) % 15000) THEN 'ROUTE_EXCEEDS_MAXIMUM_LENGTH' END AS reason FROM g_target)"


@query(f"WITH {_REASONS} SELECT reason, count(*) AS problems, min(ordinal) AS first_target FROM r WHERE reason IS NOT NULL GROUP BY reason", "g_target")
def problem_histogram(spark, sf_dir):
    return _with_reasons(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("problems"), F.min("ordinal").alias("first_target"))


@query(f"WITH {_REASONS} SELECT ordinal, reason FROM r WHERE reason IS NOT NULL ORDER BY reason, ordinal LIMIT 60", "g_target")
def findings_report(spark, sf_dir):
    """The first sixty findings: a report is cut on purpose."""
    return _with_reasons(spark, sf_dir).orderBy("reason", "ordinal").limit(60).select("ordinal", "reason")


@query(f"WITH {_REASONS} SELECT ordinal FROM r WHERE reason = 'ROUTE_EXCEEDS_MAXIMUM_LENGTH' ORDER BY ordinal LIMIT 10", "g_target")
def wider_search_targets(spark, sf_dir):
    """The ten first targets that get a wider search."""
    return _with_reasons(spark, sf_dir).where("reason = 'ROUTE_EXCEEDS_MAXIMUM_LENGTH'").orderBy("ordinal").limit(10).select("ordinal")


@query(
    f"SELECT * FROM (SELECT target, ordinal, round(distance_m, 6) AS distance_m, row_number() OVER (PARTITION BY target ORDER BY distance_m, ordinal) AS rank FROM (SELECT t.ordinal AS target, l.ordinal, min({geo.point_segment(P, S)}) AS distance_m FROM g_target t, g_line l GROUP BY t.ordinal, l.ordinal) q WHERE distance_m <= 700) q WHERE rank <= 60",
    "g_target", "g_line",
)
def reattach_candidates(spark, sf_dir):
    near = ties.near_lines(scene(spark, sf_dir, "g_target").select(F.col("ordinal").alias("target"), "x", "y"), scene(spark, sf_dir, "g_line"), 700.0, cell=256.0)
    per = near.groupBy("target", "ordinal").agg(F.min("distance_m").alias("distance_m"))
    return ties.nearest_k(per, "target", 60, "distance_m", "ordinal").select("target", "ordinal", F.round("distance_m", 6).alias("distance_m"), "rank")


@query("SELECT r.pos, r.ordinal, CASE WHEN r.ordinal < 0 THEN 'NEGATIVE' WHEN r.n > 1 THEN 'DUPLICATE' WHEN t.ordinal IS NULL THEN 'MISSING' ELSE 'FOUND' END AS status FROM (SELECT pos, ordinal, row_number() OVER (PARTITION BY ordinal ORDER BY pos) AS n FROM (VALUES (0, 5), (1, 3), (2, 9999999), (3, 3), (4, -7), (5, 11)) v(pos, ordinal)) r LEFT JOIN g_target t ON t.ordinal = r.ordinal", "g_target")
def target_selection(spark, sf_dir):
    """Asked-for targets in the order asked, and what is wrong with which."""
    asked = spark.sql("SELECT posexplode(array(5L, 3L, 9999999L, 3L, -7L, 11L)) AS (pos, ordinal)")
    again = asked.withColumn("_n", F.row_number().over(Window.partitionBy("ordinal").orderBy("pos")))
    found = again.join(scene(spark, sf_dir, "g_target").select("ordinal", F.lit(True).alias("_known")), "ordinal", "left")
    return found.select("pos", "ordinal", F.when(F.col("ordinal") < 0, "NEGATIVE").when(F.col("_n") > 1, "DUPLICATE").when(F.col("_known").isNull(), "MISSING").otherwise("FOUND").alias("status"))


@query(
    f"WITH s AS (SELECT seg_id, ax, CASE WHEN seg_id % 97 = 0 THEN ax ELSE ex END AS ex, ay, CASE WHEN seg_id % 97 = 0 THEN ay WHEN seg_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN seg_id % 83 = 0 THEN ey + 200000 ELSE ey END AS ey, CASE WHEN seg_id % 79 = 0 THEN 77 ELSE dn END AS dn FROM g_segment) "
    f"SELECT seg_id, CASE WHEN dn NOT IN (SELECT dn FROM {dn_sql()} d) THEN 'UNKNOWN_DIAMETER' WHEN isinf(ey) THEN 'NOT_FINITE' WHEN {geo.length(S)} <= 1e-6 THEN 'TOO_SHORT' WHEN {geo.length(S)} > 100000 THEN 'TOO_LONG' END AS error FROM s WHERE dn = 77 OR isinf(ey) OR {geo.length(S)} <= 1e-6 OR {geo.length(S)} > 100000",
    "g_segment",
)
def segment_guards(spark, sf_dir):
    """Segments that no decision is made on."""
    ey = F.expr("CASE WHEN seg_id % 97 = 0 THEN ay WHEN seg_id % 89 = 0 THEN double('Infinity') WHEN seg_id % 83 = 0 THEN ey + 200000 ELSE ey END")
    s = scene(spark, sf_dir, "g_segment").withColumns({"ex": F.expr("CASE WHEN seg_id % 97 = 0 THEN ax ELSE ex END"), "ey": ey, "dn": F.expr("CASE WHEN seg_id % 79 = 0 THEN 77 ELSE dn END")})
    known = s.join(F.broadcast(rules.dn_table(spark).select("dn", F.lit(True).alias("_known"))), "dn", "left").withColumn("_len", F.expr(geo.length(S)))
    odd = F.array_max(F.array(*[F.abs(c) for c in S])) == float("inf")
    error = F.when(F.col("_known").isNull(), "UNKNOWN_DIAMETER").when(odd, "NOT_FINITE").when(F.col("_len") <= 1e-6, "TOO_SHORT").when(F.col("_len") > 100_000, "TOO_LONG")
    return known.select("seg_id", error.alias("error")).where("error is not null")


@query("WITH RECURSIVE t AS (SELECT a.ordinal AS a, b.ordinal AS b FROM g_obstacle a JOIN g_obstacle b ON a.ordinal <> b.ordinal AND greatest(b.x0 - a.x1, a.x0 - b.x1) <= 3 AND greatest(b.y0 - a.y1, a.y0 - b.y1) <= 3), r AS (SELECT ordinal AS node, ordinal AS root FROM g_obstacle UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.node) SELECT node AS ordinal, min(root) AS root FROM r GROUP BY node".replace("WITH RECURSIVE ", "WITH RECURSIVE g_obstacle AS (" + SCENES["g_obstacle"] + "), ", 1))
def touching_obstacles(spark, sf_dir):
    """Obstacles that hang together when each is widened by a step of 3 m."""
    boxes = scene(spark, sf_dir, "g_obstacle").select(F.col("ordinal").alias("node"), *restrict.B)
    links = box_links(boxes, 3.0, 64.0)
    return groups(boxes.select("node"), links).withColumnRenamed("node", "ordinal")


_CELLS = "cells AS (SELECT DISTINCT nation % 6 AS variant, CAST(floor(x / 250) AS BIGINT) * 100000 + CAST(floor(y / 250) AS BIGINT) AS cell FROM g_target)"


@query(f"WITH {_CELLS}, n AS (SELECT variant, count(*) AS n FROM cells GROUP BY variant), c AS (SELECT x.variant AS a, y.variant AS b, count(*) AS common FROM cells x JOIN cells y ON x.cell = y.cell AND x.variant < y.variant GROUP BY 1, 2) SELECT p.variant AS a, q.variant AS b, coalesce(common, 0) AS common, p.n + q.n - coalesce(common, 0) AS all_, round(coalesce(common, 0) / (p.n + q.n - coalesce(common, 0)), 9) AS share FROM n p JOIN n q ON p.variant < q.variant LEFT JOIN c ON c.a = p.variant AND c.b = q.variant", "g_target")
def variant_likeness(spark, sf_dir):
    """How many cells two variants share, of all that either has."""
    cells = scene(spark, sf_dir, "g_target").select(F.expr("nation % 6").alias("variant"), F.expr("CAST(floor(x / 250) AS BIGINT) * 100000 + CAST(floor(y / 250) AS BIGINT)").alias("cell"))
    return plan.jaccard(cells.groupBy("variant").agg(F.collect_set("cell").alias("cells")), "variant", "cells").withColumn("share", F.round("share", 9))


_KNOTS = "knots AS (SELECT DISTINCT edge_id, CAST(m AS DOUBLE) AS at_m, CAST(2.0 + (edge_id % 7) * 0.3 + m * 0.01 * (edge_id % 3 - 1) + CASE WHEN m = 37 THEN 0.4 ELSE 0 END AS DOUBLE) AS depth_m FROM g_section, (VALUES (0), (37), (74), (110)) v(m))"


def _knots(spark, sf_dir):
    edges = scene(spark, sf_dir, "g_section").select("edge_id").distinct().withColumn("m", F.explode(F.array(*map(F.lit, (0, 37, 74, 110)))))
    return edges.select("edge_id", F.col("m").cast("double").alias("at_m"), F.expr("CAST(2.0 + (edge_id % 7) * 0.3 + m * 0.01 * (edge_id % 3 - 1) + CASE WHEN m = 37 THEN 0.4 ELSE 0 END AS DOUBLE)").alias("depth_m"))


@query(
    f"WITH {_STEPS}, {_KNOTS}, spans AS (SELECT edge_id, at_m AS f, depth_m AS a, lead(at_m) OVER w AS t, lead(depth_m) OVER w AS b FROM knots WINDOW w AS (PARTITION BY edge_id ORDER BY at_m)), "
    "cut AS (SELECT s.edge_id, greatest(s.from_m, f) AS lo, least(s.to_m, t) AS hi, coefficient, a, b, f, t FROM sections s JOIN spans p ON p.edge_id = s.edge_id AND s.from_m < t AND s.to_m > f) "
    "SELECT edge_id, count(*) AS pieces, round(sum(hi - lo), 6) AS length_m, round(sum((hi - lo) * coefficient * (a + ((lo + hi) / 2 - f) / (t - f) * (b - a))) + 1e-6, 2) AS weighted FROM cut WHERE hi - lo > 1e-6 GROUP BY edge_id",
    "g_section",
)
def depth_cut_sections(spark, sf_dir):
    cut = plan.pieces_at_knots(restrict.section_arrays(scene(spark, sf_dir, "g_section")), _knots(spark, sf_dir), "edge_id")
    over = lambda v: F.expr(f"aggregate(pieces, 0.0D, (a, p) -> a + {v})")
    return cut.select("edge_id", F.size("pieces").cast("long").alias("pieces"), F.round(over("p.to_m - p.from_m"), 6).alias("length_m"), F.round(over("(p.to_m - p.from_m) * p.coefficient * p.depth_m") + 1e-6, 2).alias("weighted"))


@query(
    f"WITH {_KNOTS}, k AS (SELECT *, lag(at_m) OVER w AS s, lag(depth_m) OVER w AS h FROM knots WINDOW w AS (PARTITION BY edge_id ORDER BY at_m)) SELECT edge_id, at_m, 'TOO_SHALLOW' AS code FROM k WHERE depth_m < 0.7 - 1e-9 "
    "UNION ALL SELECT edge_id, at_m, 'TOO_STEEP' FROM k WHERE abs(depth_m - h) > 0.1 * (at_m - s) + 1e-9 UNION ALL SELECT edge_id, at_m, 'PAST_NORMAL_DEPTH' FROM k WHERE (depth_m < 3 - 1e-9 AND h > 3 + 1e-9) OR (h < 3 - 1e-9 AND depth_m > 3 + 1e-9)",
    "g_section",
)
def validate_depth(spark, sf_dir):
    return plan.depth_violations(_knots(spark, sf_dir), "edge_id", "at_m", "depth_m")


@query("WITH c AS (SELECT p.node, p.dn, (SELECT max(dn) FROM g_pipe q WHERE q.parent = p.node) AS hi FROM g_pipe p) SELECT node, dn AS declared, CASE WHEN hi > dn THEN hi ELSE dn END AS expected FROM c WHERE hi > dn", "g_pipe")
def validate_chamber_dn(spark, sf_dir):
    """Nodes whose own DN is not the greatest that meets there."""
    pipes = _pipes(spark, sf_dir)
    at = plan.node_kinds(pipes).select("node", F.col("dn").alias("expected")).join(pipes.select("node", F.col("dn").alias("declared")), "node")
    return at.where("declared <> expected").select("node", "declared", "expected")


@query("SELECT s.grp, bool_and(s.ok) AS admissible, count(*) AS edges FROM (SELECT seg_id % 25 AS grp, (seg_id * 31) % 97 <> 0 AS ok FROM g_segment) s GROUP BY s.grp", "g_segment")
def plan_admissible(spark, sf_dir):
    rows = scene(spark, sf_dir, "g_segment").selectExpr("seg_id % 25 AS grp", "(seg_id * 31) % 97 <> 0 AS ok")
    return rows.groupBy("grp").agg(F.bool_and("ok").alias("admissible"), F.count(F.lit(1)).alias("edges"))


@query("SELECT 'id/' || ordinal AS given, 'id_' || ordinal AS safe, sha256('s:id/' || ordinal) AS key FROM g_target WHERE ordinal < 50", "g_target")
def safe_ids(spark, sf_dir):
    ids = scene(spark, sf_dir, "g_target").where("ordinal < 50").select(F.concat(F.lit("id/"), "ordinal").alias("given"))
    return ids.select("given", F.substring(F.regexp_replace("given", "[^A-Za-z0-9_.:-]", "_"), 1, 160).alias("safe"), F.sha2(F.concat(F.lit("s:"), "given"), 256).alias("key"))


@query("SELECT count(*) AS unproven, string_agg(CASE WHEN n <= 50 THEN CAST(ordinal AS VARCHAR) END, ',' ORDER BY ordinal) || CASE WHEN count(*) > 50 THEN ',...' ELSE '' END AS header FROM (SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS n FROM g_target WHERE ordinal % 7 = 0) q", "g_target")
def result_headers(spark, sf_dir):
    """How many ids are unproven, and the first fifty of them."""
    some = scene(spark, sf_dir, "g_target").where("ordinal % 7 = 0").select("ordinal")
    first = some.orderBy("ordinal").limit(50).agg(F.array_join(F.array_sort(F.collect_list("ordinal")).cast("array<string>"), ",").alias("header"))
    n = some.count()
    return first.select(F.lit(n).cast("long").alias("unproven"), F.concat("header", F.lit(",..." if n > 50 else "")).alias("header"))


@query("SELECT name, lower(name) IN ('epsg:4326', 'urn:ogc:def:crs:epsg::4326', 'urn:ogc:def:crs:ogc:1.3:crs84', 'crs84') AS accepted FROM (VALUES ('EPSG:4326'), ('urn:ogc:def:crs:OGC:1.3:CRS84'), ('EPSG:3857'), ('CRS84'), ('')) v(name)")
def crs_names(spark, sf_dir):
    """Coordinate systems by name that an import may give."""
    given = [(f'{{"crs": {{"type": "name", "properties": {{"name": "{n}"}}}}}}',) for n in ("EPSG:4326", "urn:ogc:def:crs:OGC:1.3:CRS84", "EPSG:3857", "CRS84", "")]
    name = F.get_json_object("doc", "$.crs.properties.name")
    return spark.createDataFrame(given, "doc string").select(name.alias("name"), F.lower(name).isin("epsg:4326", "urn:ogc:def:crs:epsg::4326", "urn:ogc:def:crs:ogc:1.3:crs84", "crs84").alias("accepted"))


@query(
    "WITH v AS (SELECT nation AS variant, sum(flow) AS cost, count(*) AS features, bool_and(flow < 24.9) AS valid FROM g_target GROUP BY nation) SELECT variant, features, row_number() OVER (ORDER BY cost, variant) AS rank, features AS read_back FROM v WHERE valid",
    "g_target",
)
def export_documents(spark, sf_dir):
    """One JSON document a variant, invalid variants left out and ranks given anew, read back and counted."""
    t = scene(spark, sf_dir, "g_target")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("ordinal", "flow").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"))
    v = t.groupBy(F.col("nation").alias("variant")).agg(F.sum("flow").alias("cost"), F.bool_and(F.col("flow") < 24.9).alias("valid"), F.sort_array(F.collect_list(feature)).alias("features")).where("valid")
    ranked = v.withColumn("rank", F.row_number().over(Window.orderBy("cost", "variant")))  # a few variants
    doc = ranked.select("variant", "rank", F.size("features").cast("long").alias("features"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("doc"))
    back = F.from_json("doc", "features array<struct<type:string,properties:struct<ordinal:bigint,flow:double>,geometry:struct<type:string,coordinates:array<double>>>>")
    return doc.select("variant", "features", "rank", F.size(F.filter(back["features"], lambda x: (x["type"] == "Feature") & (F.size(x["geometry"]["coordinates"]) == 2))).cast("long").alias("read_back"))


@query(
    "WITH c AS (SELECT p.node, (SELECT count(*) FROM g_pipe q WHERE q.parent = p.node) AS n, p.parent FROM g_pipe p) SELECT node, CASE WHEN parent = -1 THEN 'joins the existing network' ELSE 'branches into ' || n || ' pipes' END AS why FROM c WHERE parent = -1 OR n >= 2",
    "g_pipe",
)
def explain_chambers(spark, sf_dir):
    pipes = _pipes(spark, sf_dir)
    at = plan.node_kinds(pipes).where("kind = 'chamber'").join(pipes.select("node", "parent"), "node")
    return at.select("node", F.when(F.col("parent") == plan.ROOT, "joins the existing network").otherwise(F.concat(F.lit("branches into "), F.col("degree") - 1, F.lit(" pipes"))).alias("why"))


@query("SELECT ordinal, round(2 * (x1 - x0) + 2 * (y1 - y0), 6) AS perimeter_m, 4 AS sides FROM g_obstacle", "g_obstacle")
def ring_sides(spark, sf_dir):
    """Sides of rings from their corners in order, the last joined to the first."""
    corners = scene(spark, sf_dir, "g_obstacle").select("ordinal", F.posexplode(F.expr("array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 AS y), struct(x1 AS x, y1 AS y), struct(x0 AS x, y1 AS y))")).alias("seq", "p"))
    w = Window.partitionBy("ordinal").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = corners.withColumn("q", F.coalesce(F.lead("p").over(w), F.first("p").over(whole)))
    return sides.groupBy("ordinal").agg(F.round(F.sum(F.expr("sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))")), 6).alias("perimeter_m"), F.count(F.lit(1)).cast("int").alias("sides"))


NEW = (
    "edge_consumers", "equal_consumer_components", "same_dn_from_root", "sized_tree", "plan_nodes", "stranded_removal", "plan_status", "plan_choice", "node_on_line", "target_diameters", "problem_histogram",
    "findings_report", "wider_search_targets", "reattach_candidates", "target_selection", "segment_guards", "touching_obstacles", "variant_likeness", "depth_cut_sections", "validate_depth", "validate_chamber_dn",
    "plan_admissible", "safe_ids", "result_headers", "crs_names", "export_documents", "explain_chambers", "ring_sides",
)
__all__ = ["NEW", "with_scenes"]


# Depths

#: Which type a passage of a scene is, by its coefficient.
_BY_K = "CASE k WHEN 1.05 THEN 'heat_network' WHEN 1.15 THEN 'power_cable' WHEN 1.25 THEN 'gas_pipeline' WHEN 1.60 THEN 'road' ELSE 'tram_tracks' END"


@query(None)
def tree_depths(spark, sf_dir):
    """Least-cost depths of the whole forest, under and over the passages of the order lines of each pipe's number. Each tree has a tie of its own."""
    from pipeweave.operators import tree_depth

    over = scene(spark, sf_dir, "g_section").withColumn("node", F.col("edge_id")).withColumn("types", F.expr(f"array({_BY_K})")).withColumn("heights", F.expr("array(0.315D)"))
    section = F.struct("from_m", "to_m", F.col("k").alias("coefficient"), F.lit(True).alias("special"), "types", "heights")
    sections = over.groupBy("node").agg(F.sort_array(F.collect_list(section)).alias("sections"))  # an order has seven lines at most
    sizes = rules.dn_table(spark).select("dn", "height", "rate")
    pipes = _pipes(spark, sf_dir).withColumn("parent", F.when(F.col("parent") == -1, -1 - F.col("node")).otherwise(F.col("parent"))).join(F.broadcast(sizes), "dn").join(sections, "node", "left")
    return tree_depth.tree_depths(pipes).select("node", "feasible", F.round("cost", 2).alias("cost"), F.round("from_depth", 6).alias("from_depth"), F.round("to_depth", 6).alias("to_depth"), F.size("knots").cast("long").alias("n_knots"))


@query(None)
def exact_enclosure(spark, sf_dir):
    """Whether a way for the smallest pipe leads out from each target, or to a line, by overlapping zones."""
    from pipeweave.operators import enclosure

    dn, width = rules.DN_ROWS[0][:2]
    walls = enclosure.blockers(scene(spark, sf_dir, "g_part_edge"), rules.rule_table(spark), dn, width)
    targets = scene(spark, sf_dir, "g_target").select(F.col("ordinal").alias("target"), "x", "y")
    return per_place(targets, lambda at: enclosure.enclosures(at, walls, scene(spark, sf_dir, "g_line")))


@query(None)
def route_outcomes(spark, sf_dir):
    """Each target's way to the network by ever wider searches, or the proof that there is none, for the smallest pipe."""
    from pipeweave.operators import escalation

    dn, width = rules.DN_ROWS[0][:2]
    targets = scene(spark, sf_dir, "g_target").select(F.col("ordinal").alias("target"), "x", "y")
    found = escalation.outcomes(targets, scene(spark, sf_dir, "g_obstacle"), scene(spark, sf_dir, "g_line"), rules.rule_table(spark), dn, width)
    return found.select("target", "status", "stage", F.round("length_m", 6).alias("length_m"), F.size("points").cast("long").alias("vertices"))
