"""Decisions that are made in order, in rounds over all rows: greedy selection, places for few, edges that close cycles.

Each gives what a loop over the rows in their order gives, but decides in every round all rows that no
earlier open row can change any more. Rounds grow with the longest chain of rows that wait for each other,
which for places in the plane and ids that do not follow them is short; a round is a few joins on keys.
Tables of a round are written and dropped by the next; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.operators.components import components
from pipeweave.storage import Scratch


def greedy(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(b, a): what the loop "in order of ids, take a row unless one that is near it was taken" leaves out, and the first row taken that is near it.

    pairs: a, b for each two rows that are near each other, in any order and number. Null ends and pairs of
    a row with itself are ignored. What is not in the answer is taken, rows without pairs too.
    """
    ordered = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = scratch.keep(ordered.distinct(), "near")
    open_, out = near, []
    while not open_.isEmpty():
        waiting = open_.select(F.col("b").alias("a")).distinct()
        first = open_.join(waiting, "a", "left_anti")  # nothing smaller is open: these are taken
        out.append(scratch.keep(first.select("b").distinct(), "out"))
        left = open_.join(out[-1], "b", "left_anti").join(out[-1].withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b")
        last, open_ = open_, scratch.keep(left, "open")
        if last is not near:
            scratch.drop(last)
    if not out:
        return near.select("b", "a")
    gone = out[0]
    for some in out[1:]:
        gone = gone.unionByName(some)
    gone = scratch.keep(gone, "gone")
    taken = near.join(gone.withColumnRenamed("b", "a"), "a", "left_anti")
    return taken.groupBy("b").agg(F.min("a").alias("a"))


def places(wishes: DataFrame, free: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(who, place, rank): who gets which place, when in order of who each takes the best of its wishes that has room.

    wishes: who, place, rank (distinct for each who; lower is better). free: place, free, never above most.
    Every who asks for its best wish; a full place turns away all that come after its last holder, for good,
    and they ask for the next. Who finds no room has no row. Null who, place or rank is no wish; places
    without a row in free have no room. No place ever gathers more than its first few askers of each task.
    """
    room = free.groupBy("place").agg(F.min("free").alias("free")).where("free > 0")
    wish = wishes.select("who", "place", "rank").where("who IS NOT NULL AND rank IS NOT NULL").join(room, "place")
    wish = scratch.keep(wish.groupBy("who", "place").agg(F.min("rank").alias("rank"), F.first("free").alias("free")), "wishes")
    n = wish.count()
    while True:
        best = wish.groupBy("who").agg(F.min(F.struct("rank", "place", "free")).alias("w")).select("who", "w.*")
        held = best.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("who"))).where(F.col("n") <= most).where("n <= free")
        full = held.where("n = free").select("place", F.col("who").alias("last"))
        left = scratch.keep(wish.join(full, "place", "left").where("last IS NULL OR who <= last").drop("last").select("who", "place", "rank", "free"), "wishes")
        scratch.drop(wish)
        wish, was, n = left, n, left.count()
        if n == was:
            return wish.groupBy("who").agg(F.min(F.struct("rank", "place")).alias("w")).select("who", "w.place", "w.rank")


def closing_edges(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(edge, component): the edges that close a cycle when edges are laid in order, and the least edge of what they belong to.

    edges: edge (distinct, gives the order), u, v (of one type). Each round every group of nodes takes the
    first edge that leaves it; groups joined so are one in the next, at most half as many. An edge within a
    group that was never taken closes a cycle, and so does a second edge between two groups. Edges with a
    null end are ignored; an edge from a node to itself closes.
    """
    whole = scratch.keep(edges.where("edge IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL").select("edge", "u", "v"), "edges")
    between, taken = scratch.keep(_between(whole), "between"), []
    while not between.isEmpty():
        ends = between.select("u", "edge").unionByName(between.select(F.col("v").alias("u"), "edge"))
        first = ends.groupBy("u").agg(F.min("edge").alias("edge")).select("edge").distinct()
        chosen = scratch.keep(between.join(first, "edge", "left_semi"), "chosen")
        taken.append(chosen.select("edge"))
        of = scratch.keep(components(chosen.select(F.col("u").alias("a"), F.col("v").alias("b")), scratch), "groups")
        at = lambda c: of.select(F.col("node").alias(c), F.col("component_id").alias("to_" + c))  # noqa: E731, B023
        moved = between.join(at("u"), "u", "left").join(at("v"), "v", "left").select("edge", F.coalesce("to_u", "u").alias("u"), F.coalesce("to_v", "v").alias("v"))
        last, between = between, scratch.keep(_between(moved), "between")
        scratch.drop(last)
    forest = whole.select("edge").limit(0)
    for some in taken:
        forest = forest.unionByName(some)
    rest = whole.join(forest, "edge", "left_anti")
    of = scratch.keep(components(whole.select(F.col("u").alias("a"), F.col("v").alias("b")), scratch), "parts").withColumnsRenamed({"node": "u"})
    parted = whole.join(of, "u", "left").select("edge", F.coalesce("component_id", "u").alias("part"))
    least = parted.groupBy("part").agg(F.min("edge").alias("component"))
    return rest.select("edge").join(parted, "edge").join(least, "part").select("edge", "component")


def _between(edges: DataFrame) -> DataFrame:
    """The first edge between each two groups."""
    two = edges.where("u <> v").select("edge", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return two.groupBy("u", "v").agg(F.min("edge").alias("edge"))
