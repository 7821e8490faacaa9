"""Ways of targets to a network in stages: each stage gets only the targets that those before left open.

1. STRAIGHT: the straight way to the nearest line. 2. and on, ROUTED: the shortest way around boxes to one of the nearest ties, in
ever wider windows. Ways found are checked in one batch against all boxes, also those outside of the window of
their search, and stay open if they touch one. Last, ENCLOSED: the exact proof that no way exists. What is still open is
SEARCH_INCOMPLETE. So nothing is called impossible without proof, and every target has one row.

Targets with null or non-finite coordinates, and all where there are no lines, end as SEARCH_INCOMPLETE or ENCLOSED. Rows of one target are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.functions import geo, rules
from pipeweave.operators import enclosure, graph, ties
from pipeweave.operators.cells import near_join
from pipeweave.operators.restrict import B
from pipeweave.storage import Scratch

#: Stages of the search: how many ties within what distance, and how far around the target boxes are seen.
SEARCHES = ((4, 120.0, 120.0), (8, 250.0, 250.0))
STRAIGHT_M = 400.0
_W = ("ax", "ay", "ex", "ey")
_OUT = ("target", "status", "stage", "length_m", "points")


def wide_boxes(boxes: DataFrame, rule_rows: DataFrame, dn: int, width: float) -> DataFrame:
    """Boxes widened by the clearance of the pipe's axis, of types that it cannot pass. Square corners contain the round zones of the proof."""
    keep = F.expr(rules.axis_clearance("type", str(dn), "clearance", str(width), "obstacle_width"))
    known = boxes.join(F.broadcast(rule_rows), "type").withColumn("_keep", keep).where("not special or _keep > margin + 1e-9")  # one row a type
    return known.selectExpr("ordinal", "type", "_keep", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1", "x0 - _keep AS x0", "y0 - _keep AS y0", "x1 + _keep AS x1", "y1 + _keep AS y1")


def box_edges(boxes: DataFrame) -> DataFrame:
    """The sides of boxes, as edges of polygons."""
    sides = "array(struct(x0 AS cx, y0 AS cy, x1 AS dx, y0 AS dy), struct(x1 AS cx, y0 AS cy, x1 AS dx, y1 AS dy), struct(x1 AS cx, y1 AS cy, x0 AS dx, y1 AS dy), struct(x0 AS cx, y1 AS cy, x0 AS dx, y0 AS dy))"
    return boxes.select("ordinal", "type", F.posexplode(F.expr(sides)).alias("seq", "e")).select("ordinal", F.lit(0).cast("long").alias("component"), "type", F.lit(True).alias("polygonal"), "e.*")


def touched(segments: DataFrame, wide: DataFrame) -> DataFrame:
    """target of the segments (target, ax, ay, ex, ey) that run through a widened box. Along its side is not through."""
    wide = wide.selectExpr("x0 + 1e-6 AS x0", "y0 + 1e-6 AS y0", "x1 - 1e-6 AS x1", "y1 - 1e-6 AS y1")
    boxed = segments.withColumns({"_u0": F.least("ax", "ex"), "_v0": F.least("ay", "ey"), "_u1": F.greatest("ax", "ex"), "_v1": F.greatest("ay", "ey")})
    pairs = near_join(boxed, wide, ("_u0", "_v0", "_u1", "_v1"), B, 0.0, 128.0)
    return pairs.where(f"{geo.leaves(_W, B)} - {geo.enters(_W, B)} > 1e-9").select("target").distinct()


def _legs(found: DataFrame) -> DataFrame:
    legs = found.select("target", F.posexplode("points").alias("i", "p"), "points").where("i > 0")
    return legs.select("target", F.expr("points[i - 1].x").alias("ax"), F.expr("points[i - 1].y").alias("ay"), F.col("p.x").alias("ex"), F.col("p.y").alias("ey"))


def outcomes(targets: DataFrame, boxes: DataFrame, lines: DataFrame, rule_rows: DataFrame, dn: int, width: float, searches: tuple = SEARCHES) -> DataFrame:
    """target, status, stage, length_m and points (from the tie on) of every target. boxes: ordinal, type, x0, y0, x1, y1; lines as in scenes."""
    scratch = Scratch(targets.sparkSession, "outcomes")
    every = scratch.keep(targets.select("target", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropDuplicates(["target"]), "targets")
    known = every.where("abs(x) < 1e9 and abs(y) < 1e9")
    wide = scratch.keep(wide_boxes(boxes, rule_rows, dn, width), "boxes")

    near = ties.nearest_k(ties.near_lines(known, lines, STRAIGHT_M), "target", 1, "distance_m", "ordinal", "seq")
    ways = near.select("target", F.array(F.struct(F.col("tx").alias("x"), F.col("ty").alias("y")), F.struct("x", "y")).alias("points"), F.col("distance_m").alias("length_m"))
    done = [_kept(scratch, ways, wide, "STRAIGHT", 1)]
    open_ = scratch.keep(known.join(done[-1], "target", "left_anti"), "open")
    for stage, (k, reach, around) in enumerate(searches, 2):
        some = ties.nearest_k(ties.near_lines(open_, lines, reach), "target", k, "distance_m", "ordinal", "seq")
        tie = some.select("target", "x", "y", F.lit("tie").alias("kind"), F.col("tx").alias("x0"), F.col("ty").alias("y0"), F.col("tx").alias("x1"), F.col("ty").alias("y1"))
        tie = scratch.keep(tie, "ties")
        at = tie.select("target", "x", "y").distinct()
        box = near_join(at, wide.select(*B), ("x", "y", "x", "y"), B, around, 128.0).select("target", "x", "y", F.lit("box").alias("kind"), *B)
        ways = graph.routes(tie.unionByName(box)).where("status = 'ROUTED'").select("target", "points", "length_m")
        done.append(_kept(scratch, ways, wide, "ROUTED", stage))
        open_ = scratch.keep(open_.join(done[-1], "target", "left_anti"), "open")
    walls = enclosure.blockers(box_edges(boxes), rule_rows, dn, width)
    proved = enclosure.enclosures(open_, walls, lines).where(F.col("status") == enclosure.ENCLOSED)
    last = F.lit(len(searches) + 2)
    done.append(scratch.keep(proved.select("target", F.lit("ENCLOSED").alias("status"), last.alias("stage"), F.lit(None).cast("double").alias("length_m"), F.lit(None).cast("array<struct<x: double, y: double>>").alias("points")), "proved"))
    found = reduce(DataFrame.unionByName, done)
    return every.select("target").join(found, "target", "left").select("target", F.coalesce("status", F.lit("SEARCH_INCOMPLETE")).alias("status"), F.coalesce("stage", last).alias("stage"), "length_m", "points")


def _kept(scratch: Scratch, ways: DataFrame, wide: DataFrame, status: str, stage: int) -> DataFrame:
    """Ways that no box touches."""
    ways = scratch.keep(ways.select("target", F.lit(status).alias("status"), F.lit(stage).alias("stage"), "length_m", "points"), "ways")
    return scratch.keep(ways.join(touched(_legs(ways), wide), "target", "left_anti").select(*_OUT), "kept")
