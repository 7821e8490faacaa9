"""Connected groups, cycles and routes on graphs."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.operators.cells import dealt, near_join
from pipeweave.operators.components import components
from pipeweave.storage import Scratch


def groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each hangs together with. nodes: node; links: a, b.

    By alternating stars, until nothing changes; rounds grow with the logarithm of a path's length. Only a
    count and a sum of hashes reach the driver. Links with an end that is no node are ignored.
    """
    own = nodes.select("node")
    known = links.select("a", "b").join(own.select(F.col("node").alias("a")).distinct(), "a", "left_semi").join(own.select(F.col("node").alias("b")).distinct(), "b", "left_semi")
    found = components(known, Scratch(nodes.sparkSession, "groups"))
    return own.join(found, "node", "left").select("node", F.coalesce("component_id", "node").alias("root"))


def box_links(boxes: DataFrame, reach: float, size: float) -> DataFrame:
    """a, b: links by which the same boxes (node, x0, y0, x1, y1) hang together as by all pairs within reach of each other on both axes.

    Boxes with one lower corner have it in common, so each is linked with the least node there, and what reaches no further than another
    of them both ways meets nothing that the other does not: it is left out of the join. Links grow with the boxes, not with the square of a stack.
    """
    proper = F.coalesce(F.expr("x0 <= x1 AND y0 <= y1"), F.lit(False))
    odd, corner = boxes.where(~proper), Window.partitionBy("x0", "y0")
    before = corner.orderBy(F.desc("x1"), F.desc("y1"), "node").rowsBetween(Window.unboundedPreceding, -1)
    placed = boxes.where(proper).withColumns({"_first": F.min("node").over(corner), "_top": F.max("y1").over(before)})
    placed = Scratch(boxes.sparkSession, "boxes").keep(placed, "placed")
    outer = placed.where("_top IS NULL OR y1 > _top").select(boxes.columns).unionByName(odd).select(F.col("node").alias("a"), "x0", "y0", "x1", "y1")
    other = outer.select(F.col("a").alias("b"), F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"))
    pairs = near_join(outer, other, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), reach, size).where("a < b").select("a", "b")
    return pairs.unionByName(placed.where("node <> _first").select(F.col("_first").alias("a"), F.col("node").alias("b")))


def cycles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """root, nodes, links, cyclic: a group has a cycle if it has as many links as nodes or more. links: distinct a, b."""
    label = groups(nodes, links)
    n = label.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))
    m = links.join(label.select(F.col("node").alias("a"), "root"), "a").groupBy("root").agg(F.count(F.lit(1)).alias("links"))
    return n.join(m, "root", "left").select("root", "nodes", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("links", F.lit(0)) >= F.col("nodes")).alias("cyclic"))


#: Pairs of a node and a box that are looked at together.
_PAIRS = 1 << 18


def _clear(p: np.ndarray, to: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """For each place in `to` whether no open box meets the segment from p to it."""
    if not len(boxes) or not len(to):
        return np.ones(len(to), dtype=bool)
    if len(to) > 1 and len(to) * len(boxes) > _PAIRS:
        return np.concatenate([_clear(p, some, boxes) for some in np.array_split(to, 2)])
    d = (to - p)[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        one, two = (boxes[:, :2] - p) / d, (boxes[:, 2:] - p) / d
    lo, hi = np.minimum(one, two), np.maximum(one, two)
    still = np.broadcast_to(d == 0, lo.shape)
    inside = np.broadcast_to((p > boxes[:, :2]) & (p < boxes[:, 2:]), lo.shape)
    lo = np.where(still, np.where(inside, -np.inf, np.inf), lo)
    hi = np.where(still, np.where(inside, np.inf, -np.inf), hi)
    enter, leave = np.maximum(lo.max(axis=2), 0.0), np.minimum(hi.min(axis=2), 1.0)
    return ~(enter < leave - 1e-12).any(axis=1)


def _outer(boxes: np.ndarray) -> np.ndarray:
    """The boxes that lie in no other one, equal ones once, in order: what they leave clear is clear of all."""
    boxes = boxes[np.sort(np.unique(boxes, axis=0, return_index=True)[1])]
    within = [(np.all(boxes[:, :2] <= b[:2], axis=1) & np.all(boxes[:, 2:] >= b[2:], axis=1)).sum() > 1 for b in boxes]
    return boxes[~np.array(within, dtype=bool)]


def _corners(boxes: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Corners of the boxes, each place once, in order; those within a box are left out, as no way leads there."""
    at = boxes[:, [[0, 1], [0, 3], [2, 1], [2, 3]]].reshape(-1, 2)
    at = at[np.sort(np.unique(np.round(at, 9), axis=0, return_index=True)[1])]
    held = np.zeros(len(at), dtype=bool)
    for b in outer:
        held |= np.all(at > b[:2] + 1e-6, axis=1) & np.all(at < b[2:] - 1e-6, axis=1)
    return at[~held]


class Inconclusive(Exception):
    """A search has used up its states without an answer."""


def astar(target: np.ndarray, ties: np.ndarray, boxes: np.ndarray, most: int = 40_000) -> tuple[list[int], np.ndarray] | None:
    """The shortest way from one of the ties to the target around the boxes, turning by 90 degrees at most.

    Nodes are the ties, the boxes' corners and the target; a state is the node before and the node. The
    straight distance to the target guides the search. None if there is no way; Inconclusive after `most` states.
    """
    outer = _outer(boxes) if len(boxes) else boxes
    corners = _corners(boxes, outer) if len(boxes) else np.zeros((0, 2))
    at = np.concatenate((ties, corners, target[None]))
    goal, n = len(at) - 1, len(ties)
    ahead = np.sqrt(((at - target) ** 2).sum(axis=1))
    queue = [(ahead[i], i, -1, i) for i in range(n)]
    heapq.heapify(queue)
    best, back, seen, count = {(-1, i): 0.0 for i in range(n)}, {}, {}, n
    for _ in range(most):
        if not queue:
            return None
        f, _, before, i = heapq.heappop(queue)
        g = best[before, i]
        if f > g + ahead[i] + 1e-9:
            continue
        if i == goal:
            way, state = [i], (before, i)
            while state in back:
                state = back[state]
                way.append(state[1])
            return way[::-1], at
        if i not in seen:
            seen[i] = np.concatenate((np.zeros(n, dtype=bool), _clear(at[i], at[n:], outer)))
            seen[i][i] = False
        step = at - at[i]
        some = seen[i] if before < 0 else seen[i] & (step @ (at[i] - at[before]) >= -1e-9)
        for j in np.flatnonzero(some).tolist():
            new = g + float(np.sqrt((step[j] ** 2).sum()))
            if new >= best.get((i, j), np.inf) - 1e-6:
                continue
            best[i, j], back[i, j] = new, (before, i)
            count += 1
            heapq.heappush(queue, (new + ahead[j], count, i, j))
    raise Inconclusive


def routes(scenes: DataFrame) -> DataFrame:
    """target, status, length_m, vertices of each target's way. scenes: target, x, y, kind ('tie' or 'box'), x0, y0, x1, y1, kept bounded by the caller's radius and number of ties. Status: ROUTED, or SEARCH_INCOMPLETE, as what was searched is a part of the plane; points: the way from the tie on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "x0", "y0", "x1", "y1"])
        target = rows[["x", "y"]].iloc[0].to_numpy(dtype=float)
        ties = rows.loc[rows["kind"] == "tie", ["x0", "y0"]].to_numpy(dtype=float)
        boxes = rows.loc[rows["kind"] == "box", ["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        try:
            found, status = (astar(target, ties, boxes) if len(ties) else None), "SEARCH_INCOMPLETE"
        except Inconclusive:
            found, status = None, "SEARCH_INCOMPLETE"
        if found is None:
            return pd.DataFrame({"target": [rows["target"].iloc[0]], "status": [status], "length_m": [None], "vertices": [0], "points": [None]})
        way, at = found
        length = float(np.sqrt((np.diff(at[way], axis=0) ** 2).sum(axis=1)).sum())
        return pd.DataFrame({"target": [rows["target"].iloc[0]], "status": ["ROUTED"], "length_m": [length], "vertices": [len(way)], "points": [[{"x": float(x), "y": float(y)} for x, y in at[way]]]})

    return dealt(scenes, "target").groupBy("target").applyInPandas(run, "target long, status string, length_m double, vertices long, points array<struct<x: double, y: double>>")
