"""Queries on what is decided in order. Their SQL is the loop itself, a step a row, by recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pipeweave.functions import geo
from pipeweave.operators import cost, order, ties
from pipeweave.plans.planning import rec
from pipeweave.plans.queries import _TOUCH, S, query, r6
from pipeweave.plans.scenes import scene
from pipeweave.storage import Scratch

#: Radius of a cluster; pipes that may meet at a chamber; how far a target looks for one.
CLUSTER_M, ROOM, LOOK_M = 80.0, 4, 400.0


def _apart(p: str, q: str) -> str:
    return geo.distance((f"{p}.x", f"{p}.y"), (f"{q}.x", f"{q}.y"))


@query(
    rec(
        f"spot AS (SELECT ordinal, x, y, row_number() OVER (ORDER BY ordinal) AS n FROM g_target), smaller AS MATERIALIZED (SELECT b.n, b.ordinal, list(a.ordinal) FILTER (WHERE a.ordinal IS NOT NULL) AS near FROM spot b LEFT JOIN spot a ON a.ordinal < b.ordinal AND {_apart('a', 'b')} <= {CLUSTER_M} GROUP BY b.n, b.ordinal), "
        "walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS heads UNION ALL SELECT s.n, CASE WHEN coalesce(list_has_any(heads, s.near), false) THEN heads ELSE list_append(heads, s.ordinal) END FROM walk JOIN smaller s ON s.n = walk.n + 1), "
        "head AS (SELECT unnest(heads) AS head FROM (SELECT heads FROM walk ORDER BY n DESC LIMIT 1) q) "
        f"SELECT t.ordinal, CASE WHEN t.ordinal IN (SELECT head FROM head) THEN t.ordinal ELSE (SELECT min(h.head) FROM head h JOIN spot a ON a.ordinal = h.head WHERE {_apart('a', 't')} <= {CLUSTER_M}) END AS cluster FROM g_target t",
        "g_target",
    )
)
def target_clusters(spark, sf_dir):
    """In order, each target that is in no cluster begins one and takes all others within its radius that are in none."""
    targets = scene(spark, sf_dir, "g_target")
    near = ties.within(targets.select(F.col("ordinal").alias("a"), "x", "y"), targets.select(F.col("ordinal").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy")), CLUSTER_M)
    member = order.greedy(near.where("a < b").select("a", "b"), Scratch(spark, "clusters"))
    return targets.select("ordinal").join(member.withColumnsRenamed({"b": "ordinal"}), "ordinal", "left").select("ordinal", F.coalesce("a", "ordinal").alias("cluster"))


def _wishes(spark, sf_dir):
    """Chambers within reach of each target, nearest first, and the room in each."""
    chambers = scene(spark, sf_dir, "g_chamber")
    near = ties.within(scene(spark, sf_dir, "g_target").select(F.col("ordinal").alias("who"), "x", "y"), chambers.select(F.col("ordinal").alias("place"), F.col("x").alias("ox"), F.col("y").alias("oy")), LOOK_M)
    ranked = near.select("who", "place", "distance_m", F.row_number().over(Window.partitionBy("who").orderBy("distance_m", "place")).alias("rank"))
    met = ties.attachments(chambers.select(F.col("ordinal").alias("chamber"), "x", "y"), scene(spark, sf_dir, "g_line"), 0.01)
    return ranked, met.select(F.col("chamber").alias("place"), F.greatest(F.lit(0), ROOM - F.col("attachments")).alias("free"))


_WISHES = (
    f"{_TOUCH}, free AS (SELECT c.ordinal AS place, c.x, c.y, greatest(0, {ROOM} - coalesce(attachments, 0)) AS free FROM g_chamber c LEFT JOIN per ON per.chamber = c.ordinal), "
    f"wish AS (SELECT t.ordinal AS who, f.place, f.free, {_apart('t', 'f')} AS distance_m, row_number() OVER (PARTITION BY t.ordinal ORDER BY {_apart('t', 'f')}, f.place) AS rank FROM g_target t JOIN free f ON {_apart('t', 'f')} <= {LOOK_M})"
)


_PICK = (
    f"{_WISHES}, asks AS MATERIALIZED (SELECT who, row_number() OVER (ORDER BY who) AS n, list({{'place': place, 'free': free, 'rank': rank}} ORDER BY rank) AS w FROM wish GROUP BY who), "
    "pick AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS who, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS rank UNION ALL "
    "SELECT n, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got.place) END, who, got.place, got.rank FROM "
    "(SELECT a.n, p.taken, a.who, list_filter(a.w, lambda c: len(list_filter(p.taken, lambda t: t = c.place)) < c.free)[1] AS got FROM pick p JOIN asks a ON a.n = p.n + 1) q) "
)


@query(
    rec(
        f"{_PICK} "
        "SELECT p.who, p.place, p.rank, round(w.distance_m, 6) AS distance_m FROM pick p JOIN wish w ON w.who = p.who AND w.place = p.place",
        "g_target", "g_line", "g_chamber",
    )
)
def chamber_places(spark, sf_dir):
    """Which chamber each target gets when in order of ordinals each takes the nearest that still has room for a pipe."""
    wishes, free = _wishes(spark, sf_dir)
    got = order.places(wishes, free, ROOM, Scratch(spark, "places"))
    return got.join(wishes, ["who", "place", "rank"]).selectExpr("who", "place", "rank", *r6("distance_m"))


@query(
    rec(
        f"{_PICK}, near AS (SELECT who, min(distance_m) AS nearest_m FROM wish WHERE free > 0 GROUP BY who) "
        "SELECT p.who, round(w.distance_m, 6) AS length_m, round(nearest_m, 6) AS nearest_m, w.distance_m - 30 > nearest_m + nearest_m / 2 AS heavy FROM pick p JOIN wish w ON w.who = p.who AND w.place = p.place JOIN near n ON n.who = p.who",
        "g_target", "g_line", "g_chamber",
    )
)
def heavy_detour(spark, sf_dir):
    """Ways to the chambers that targets got, against the nearest one that had room at first."""
    wishes, free = _wishes(spark, sf_dir)
    offered = wishes.join(free.where("free > 0"), "place")
    routes = order.places(wishes, free, ROOM, Scratch(spark, "places")).join(wishes, ["who", "place", "rank"]).select("who", F.col("distance_m").alias("length_m"))
    return ties.detours(routes, offered).selectExpr("who", *r6("length_m", "nearest_m"), "heavy")


@query(rec(f"{_WISHES}, first AS (SELECT who, place, free, row_number() OVER (PARTITION BY place ORDER BY who) AS n FROM wish WHERE rank = 1) SELECT who, place, free, n <= free AS keeps FROM first", "g_target", "g_line", "g_chamber"))
def chamber_capacity(spark, sf_dir):
    """Of all targets whose nearest chamber is the same, the first keep it, as many as it has room for beside the pipes that meet there."""
    wishes, free = _wishes(spark, sf_dir)
    first = wishes.where("rank = 1").select("who", "place")
    w = Window.partitionBy("place").orderBy("who")
    keeping = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= ROOM)  # no more of a place ever come together
    keeps = keeping.join(free, "place").where("n <= free").select("who", F.lit(True).alias("keeps"))
    return first.join(free, "place").join(keeps, "who", "left").select("who", "place", "free", F.coalesce("keeps", F.lit(False)).alias("keeps"))


_PLACE = "CAST(floor({0} / 400) AS BIGINT) * 100000 + CAST(floor({1} / 400) AS BIGINT)"


@query(
    rec(
        f"edges AS (SELECT ordinal * 2 + seq AS edge, {_PLACE.format('ax', 'ay')} AS u, {_PLACE.format('ex', 'ey')} AS v FROM g_line), twice AS (SELECT edge, u, v FROM edges UNION ALL SELECT edge, v, u FROM edges), "
        "reach AS (SELECT edge AS e, u AS node FROM edges UNION SELECT r.e, b.v FROM reach r JOIN twice b ON b.u = r.node AND b.edge < r.e), "
        "part AS (SELECT edge AS e, u AS node FROM edges UNION SELECT p.e, b.v FROM part p JOIN twice b ON b.u = p.node) "
        "SELECT e AS edge, (SELECT min(b.edge) FROM part p JOIN twice b ON b.u = p.node WHERE p.e = r.e) AS component FROM reach r JOIN edges d ON d.edge = r.e AND d.v = r.node",
        "g_line",
    )
)
def cycle_edges(spark, sf_dir):
    """Lines between places of 400 m: which of them close a cycle when laid in order. The least of a component is its first cycle."""
    lines = scene(spark, sf_dir, "g_line").selectExpr("CAST(ordinal * 2 + seq AS BIGINT) AS edge", f"{_PLACE.format('ax', 'ay')} AS u", f"{_PLACE.format('ex', 'ey')} AS v")
    return order.closing_edges(lines, Scratch(spark, "cycles"))


#: Three variants of each request of twelve pipes: each leaves out some tenth of them; a sixth of the pipes are tied to one of five networks.
_CELL = "CAST(floor({0} / 25 + 0.5) AS BIGINT) || ':' || CAST(floor({1} / 25 + 0.5) AS BIGINT)"
_HAS = "(seg_id * 7 + v * 3) % 10 <> 0"
_ROOT = "CASE WHEN seg_id % 6 = 0 THEN seg_id % 5 END"


@query(
    f"WITH e AS (SELECT CAST(floor(seg_id / 12.0) AS BIGINT) AS request, v, {geo.length(S)} AS m, {_ROOT} AS root, {_CELL.format('ax', 'ay')} AS p, {_CELL.format('ex', 'ey')} AS q FROM g_segment, (VALUES (0), (1), (2)) t(v) WHERE {_HAS}), "
    "tot AS (SELECT request, v, sum(m) AS m FROM e GROUP BY request, v), cell AS (SELECT DISTINCT request, v, CASE WHEN p <= q THEN p || '|' || q ELSE q || '|' || p END AS c FROM e), root AS (SELECT DISTINCT request, v, root FROM e WHERE root IS NOT NULL), "
    "two AS (SELECT a.request, a.v AS a, b.v AS b, a.m AS ma, b.m AS mb FROM tot a JOIN tot b ON a.request = b.request AND a.v < b.v), "
    "odd AS (SELECT DISTINCT t.request, t.a, t.b FROM two t JOIN root r ON r.request = t.request AND r.v IN (t.a, t.b) GROUP BY t.request, t.a, t.b, r.root HAVING count(*) = 1), "
    "share AS (SELECT request, a, b, count(*) FILTER (WHERE n = 2) AS common, count(*) AS whole FROM (SELECT t.request, t.a, t.b, c.c, count(*) AS n FROM two t JOIN cell c ON c.request = t.request AND c.v IN (t.a, t.b) GROUP BY t.request, t.a, t.b, c.c) q GROUP BY request, a, b), "
    "alike AS (SELECT t.request, t.a, t.b FROM two t JOIN share s ON s.request = t.request AND s.a = t.a AND s.b = t.b WHERE common >= 0.65 * whole AND abs(ma - mb) < greatest(25, least(ma, mb) / 10) AND NOT EXISTS (SELECT 1 FROM odd o WHERE o.request = t.request AND o.a = t.a AND o.b = t.b)), "
    "seen AS (SELECT t.request, t.v, bool_or(k.a = 0 AND k.b = 1) AS l01, bool_or(k.a = 0 AND k.b = 2) AS l02, bool_or(k.a = 1 AND k.b = 2) AS l12 FROM tot t LEFT JOIN alike k ON k.request = t.request GROUP BY t.request, t.v) "
    "SELECT request, v AS variant, CASE WHEN v = 1 AND l01 THEN 0 WHEN v = 2 AND l02 THEN 0 WHEN v = 2 AND l12 AND NOT l01 THEN 1 END AS like_ FROM seen",
    "g_segment",
)
def variant_distinct(spark, sf_dir):
    """Variants in order: each is taken unless it is like one that was, which is then named."""
    pipes = scene(spark, sf_dir, "g_segment").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(_HAS)
    named = pipes.selectExpr("CAST(floor(seg_id / 12) AS BIGINT) AS request", "v AS variant", f"{geo.length(S)} AS m", f"{_ROOT} AS root", f"{_CELL.format('ax', 'ay')} AS p", f"{_CELL.format('ex', 'ey')} AS q")
    place = F.concat_ws("|", F.least("p", "q"), F.greatest("p", "q"))
    variants = named.groupBy("request", "variant").agg(F.sum("m").alias("length_m"), F.sort_array(F.collect_set("root")).alias("roots"), F.collect_set(place).alias("shape"))
    near = cost.alike(variants).selectExpr("request * 10 + a AS a", "request * 10 + b AS b")
    out = order.greedy(near, Scratch(spark, "variants")).selectExpr("b AS id", "a % 10 AS like_")
    return variants.selectExpr("request", "variant", "request * 10 + variant AS id").join(out, "id", "left").select("request", "variant", "like_")
