"""Where new pipes may join existing lines, and who is near whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.functions import geo
from pipeweave.operators.cells import near_join
from pipeweave.operators.restrict import S, boxed
from pipeweave.storage import Scratch

P = ("x", "y")


def within(points: DataFrame, others: DataFrame, radius: float, cell: float = 128.0) -> DataFrame:
    """Pairs of (x, y) and (ox, oy) rows within a radius, with distance_m."""
    pairs = near_join(points, others, ("x", "y", "x", "y"), ("ox", "oy", "ox", "oy"), radius, cell)
    return pairs.withColumn("distance_m", F.expr(geo.distance(P, ("ox", "oy")))).where(F.col("distance_m") <= radius)


def near_lines(points: DataFrame, lines: DataFrame, radius: float, cell: float = 128.0) -> DataFrame:
    """Pairs of points and line segments within a radius, with distance_m, fraction and the nearest point (tx, ty)."""
    pairs = near_join(points, boxed(lines), ("x", "y", "x", "y"), ("_x0", "_y0", "_x1", "_y1"), radius, cell).drop("_x0", "_y0", "_x1", "_y1")
    out = pairs.withColumns({"distance_m": F.expr(geo.point_segment(P, S)), "fraction": F.expr(geo.locate(P, S))}).where(F.col("distance_m") <= radius)
    return out.withColumns({"tx": F.expr("ax + fraction * (ex - ax)"), "ty": F.expr("ay + fraction * (ey - ay)")})


def samples(lines: DataFrame, spacing: float) -> DataFrame:
    """Both ends of each segment and points at equal steps of at most `spacing`, once each."""
    n = F.greatest(F.lit(1.0), F.ceil(F.expr(geo.length(S)) / spacing))
    steps = lines.withColumn("n", n.cast("bigint")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))))
    out = steps.select("ordinal", "seq", (F.col("i") / F.col("n")).alias("fraction"), "ax", "ay", "ex", "ey", "dn")
    return out.select("ordinal", "seq", "fraction", F.expr("ax + fraction * (ex - ax)").alias("x"), F.expr("ay + fraction * (ey - ay)").alias("y"), "dn")


def first_per_place(rows: DataFrame) -> DataFrame:
    """The row of the smallest place along the line of all that share a position, rounded to 1e-6."""
    w = Window.partitionBy("ordinal", F.round("x", 6), F.round("y", 6)).orderBy("seq", "fraction")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prefer_chambers(rows: DataFrame, free: DataFrame, radius: float) -> DataFrame:
    """Samples near a free chamber give way to it; each such chamber goes with its nearest sample's line."""
    near = within(rows, free.select(F.col("ordinal").alias("chamber"), F.col("x").alias("ox"), F.col("y").alias("oy")), radius)
    w = Window.partitionBy("chamber").orderBy("distance_m", "ordinal", "seq", "fraction")
    best = near.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    taken = best.select("ordinal", "seq", "fraction", F.col("ox").alias("x"), F.col("oy").alias("y"), "dn", "chamber")
    left = rows.join(near.select("ordinal", "seq", "fraction").distinct(), ["ordinal", "seq", "fraction"], "left_anti")
    return left.withColumn("chamber", F.lit(None).cast("bigint")).unionByName(taken)


def nearest_k(pairs: DataFrame, key: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each key; k bounds what is kept while the rows are still where they were made."""
    w = Window.partitionBy(key).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(points: DataFrame, k: int, cell: float) -> DataFrame:
    """ordinal, neighbour, distance_m, rank: the exact k nearest others, ties by ordinal; all others where there are fewer.

    Rings of cells grow until no unfinished point is left: a point is finished when its k-th neighbour is
    nearer than the cells not yet looked at. Only unfinished points go on to the next ring. Points with a null or
    non-finite coordinate are near nobody and have no rows.
    """
    at = points.select("ordinal", "x", "y").where("abs(x) < 1e300D and abs(y) < 1e300D")
    others = at.select(F.col("ordinal").alias("neighbour"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    scratch, todo, done, radius = Scratch(points.sparkSession, "knn"), at, None, cell
    k = min(k, max(at.count() - 1, 0))
    while True:
        found = within(todo, others, radius, cell=max(cell, radius)).where("ordinal <> neighbour")
        ranked = nearest_k(found, "ordinal", k, "distance_m", "neighbour").select("ordinal", "neighbour", "distance_m", "rank")
        ranked = scratch.keep(ranked, "ranked")
        full = ranked.groupBy("ordinal").agg(F.max("rank").alias("n")).where(F.col("n") >= k).select("ordinal")
        part = ranked.join(full, "ordinal", "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = scratch.keep(todo.join(full, "ordinal", "left_anti"), "todo")
        if k == 0 or todo.isEmpty():
            break
        radius *= 2
    return done


def attachments(points: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """For each point (chamber, x, y): how many pipe ends meet there (an end counts 1, a passing line 2) and the largest DN."""
    near = near_lines(points, lines, tolerance)
    end = f"least({geo.distance(P, ('ax', 'ay'))}, {geo.distance(P, ('ex', 'ey'))}) <= {tolerance}"
    counted = near.groupBy("chamber").agg(F.sum(F.expr(f"CASE WHEN {end} THEN 1 ELSE 2 END")).alias("attachments"), F.max("dn").alias("dn"))
    return points.select("chamber").join(counted, "chamber", "left").select("chamber", F.coalesce("attachments", F.lit(0)).alias("attachments"), "dn")


def detours(routes: DataFrame, offered: DataFrame) -> DataFrame:
    """routes with nearest_m, the straight distance to the nearest tie that was offered, and heavy: longer than 1.5 times that and 30 m (fixed values).

    routes: who, length_m; offered: who, distance_m. A route without offered ties has null in both.
    """
    nearest = offered.groupBy("who").agg(F.min("distance_m").alias("nearest_m"))
    return routes.join(nearest, "who", "left").withColumn("heavy", F.expr("length_m > 1.5 * nearest_m + 30"))
