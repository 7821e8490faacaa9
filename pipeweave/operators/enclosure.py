"""Proof that a target is enclosed: no way of the pipe's axis leads from it out of the zones around it, nor to a network line.

A zone is all that lies within a clearance of an obstacle's edge: a segment with round ends, which is convex. A point
outside all zones is cut off from far away exactly if some closed way within the zones winds around it, and two
points are cut off from each other exactly if some closed way winds around them differently. Zones that overlap are joined
in a graph; the angle swept about the point along a step from zone to zone does not depend on the way within them, so summing
along a spanning forest gives each zone an angle, and a closed way that winds shows as an overlap whose two ends disagree by whole turns.
Nothing is rastered or offset: a gap of a millimetre decides.

One group is one target with the edges and lines near it, bounded by the window. Zones that reach out of the window are taken
whole; a way around through what lies outside is not seen, so a target far from its walls counts as open. That is the limit of the proof.

Targets with null or non-finite coordinates are unclear. Every target has one row. Edges without length are points; null ones are
left out. No obstacles: all are open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.functions import rules
from pipeweave.operators.cells import dealt, near_join

# Half of the window, what zones are smaller by, how far an approach goes beyond its own building, metres.
WINDOW, SHRINK, APPROACH = 400.0, 0.05, 7.5
OPEN, ENCLOSED, NETWORK, UNCLEAR = "OPEN", "ENCLOSED", "REACHES_NETWORK", "UNCLEAR"
_EDGE = ["cx", "cy", "dx", "dy"]


def _nearest(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The point of each segment nearest to each point, row by row."""
    d = s[:, 2:] - s[:, :2]
    t = np.clip(((p - s[:, :2]) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
    return s[:, :2] + t[:, None] * d


def _contacts(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance of segments, row by row, and the points on either that are so far apart."""
    ds, dt, w = s[:, 2:] - s[:, :2], t[:, 2:] - t[:, :2], t[:, :2] - s[:, :2]
    det = ds[:, 0] * dt[:, 1] - ds[:, 1] * dt[:, 0]
    safe = np.where(det == 0, 1.0, det)
    u, v = (w[:, 0] * dt[:, 1] - w[:, 1] * dt[:, 0]) / safe, (w[:, 0] * ds[:, 1] - w[:, 1] * ds[:, 0]) / safe
    cut = (det != 0) & (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
    ends = [(s[:, :2], _nearest(s[:, :2], t)), (s[:, 2:], _nearest(s[:, 2:], t)), (_nearest(t[:, :2], s), t[:, :2]), (_nearest(t[:, 2:], s), t[:, 2:])]
    far = np.array([np.hypot(*(a - b).T) for a, b in ends])
    k, rows = far.argmin(axis=0), np.arange(len(s))
    p, q = np.array([a for a, _ in ends])[k, rows], np.array([b for _, b in ends])[k, rows]
    x = s[:, :2] + u[:, None] * ds
    return np.where(cut, 0.0, far[k, rows]), np.where(cut[:, None], x, p), np.where(cut[:, None], x, q)


class Zones:
    """Zones of edges (n, 4) with radii (n), and how they overlap."""

    def __init__(self, edges: np.ndarray, radius: np.ndarray) -> None:
        self.edges, self.radius = edges, radius
        lo, hi = np.minimum(edges[:, :2], edges[:, 2:]) - radius[:, None], np.maximum(edges[:, :2], edges[:, 2:]) + radius[:, None]
        found = []
        for at in range(0, len(edges), 256):  # bounds the memory of comparing boxes
            a = slice(at, at + 256)
            hit = (lo[a, None] <= hi[None]).all(axis=2) & (hi[a, None] >= lo[None]).all(axis=2)
            i, j = np.nonzero(hit)
            i = i + at
            found.append(np.array([i, j]).T[i < j])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        far, p, q = _contacts(edges[pairs[:, 0]], edges[pairs[:, 1]])
        some = far <= radius[pairs[:, 0]] + radius[pairs[:, 1]]
        self.pairs, self.p, self.q = pairs[some], p[some], q[some]
        self._forest()

    def _forest(self) -> None:
        near: list[list[tuple[int, int, bool]]] = [[] for _ in range(len(self.edges))]
        for k, (i, j) in enumerate(self.pairs.tolist()):
            near[i].append((j, k, True))
            near[j].append((i, k, False))
        self.tree, self.loops, seen, used = [], np.ones(len(self.pairs), dtype=bool), np.zeros(len(self.edges), dtype=bool), []
        for root in range(len(self.edges)):
            if seen[root]:
                continue
            seen[root], todo = True, [root]
            while todo:
                i = todo.pop()
                for j, k, ahead in near[i]:
                    if not seen[j]:
                        seen[j] = True
                        self.tree.append((i, j, k, ahead))
                        used.append(k)
                        todo.append(j)
        self.loops[used] = False

    def covers(self, points: np.ndarray) -> np.ndarray:
        """Whether each point lies in a zone."""
        out = np.zeros(len(points), dtype=bool)
        for i, p in enumerate(points):
            near = _nearest(np.broadcast_to(p, (len(self.edges), 2)), self.edges)
            out[i] = bool((np.hypot(*(near - p).T) <= self.radius).any())
        return out

    def turns(self, points: np.ndarray) -> np.ndarray:
        """How often each basic closed way winds around each point (ways, points). The points lie in no zone."""

        def sweep(a, b):
            u, v = a[:, None] - points[None], b[:, None] - points[None]
            return np.arctan2(u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0], (u * v).sum(axis=2))

        start = self.edges[:, :2]
        i, j = self.pairs.T
        step = sweep(start[i], self.p) + sweep(self.p, self.q) + sweep(self.q, start[j])
        angle = np.zeros((len(self.edges), len(points)))
        for a, b, k, ahead in self.tree:
            angle[b] = angle[a] + (step[k] if ahead else -step[k])
        return np.rint((angle[i] + step - angle[j])[self.loops] / (2 * np.pi)).astype(np.int64)


def _inside(points: np.ndarray, edges: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Whether each point lies within each part (points, parts), by the parity of edges to its right."""
    x, y = points[:, None, 0], points[:, None, 1]
    cx, cy, dx, dy = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((cy > y) != (dy > y)) & (x < cx + (y - cy) / (dy - cy) * (dx - cx))
    out = np.zeros((len(points), int(part.max(initial=-1)) + 1), dtype=np.int64)
    for i in range(len(points)):
        out[i] = np.bincount(part[hit[i]], minlength=out.shape[1])
    return out % 2 == 1


def _free_parts(line: np.ndarray, zones: Zones) -> list[np.ndarray]:
    """A point of each part of a line that is in no zone. A zone is convex, so it covers one stretch of the line."""
    a, d = line[:2], line[2:] - line[:2]
    cuts = [0.0, 1.0]
    c, e, r = zones.edges[:, :2], zones.edges[:, 2:], zones.radius
    for centre in (c, e):
        w = a - centre
        p, q, s = float(d @ d), (w * d).sum(axis=1), (w * w).sum(axis=1) - r * r
        root = q * q - p * s
        if p > 0:
            ok = root >= 0
            cuts += ((-q[ok] - np.sqrt(root[ok])) / p).tolist() + ((-q[ok] + np.sqrt(root[ok])) / p).tolist()
    v = e - c
    long = np.maximum(np.hypot(*v.T), 1e-300)
    n = np.stack([-v[:, 1], v[:, 0]], axis=1) / long[:, None]
    for side in (1.0, -1.0):
        slope = (n * d).sum(axis=1)
        ok = np.abs(slope) > 1e-12
        cuts += ((side * r[ok] - ((a - c[ok]) * n[ok]).sum(axis=1)) / slope[ok]).tolist()
    at = np.unique(np.clip(cuts, 0, 1))
    mids = a + ((at[1:] + at[:-1]) / 2)[:, None] * d if len(at) > 1 else line[None, :2]
    return [m for m, covered in zip(mids, zones.covers(mids), strict=True) if not covered]


def enclosure(x: float, y: float, rows: pd.DataFrame, lines: np.ndarray) -> str:
    """rows: edges of obstacles with radius, part (number from 0 on), polygonal and building. lines: network segments (n, 4)."""
    target = np.array([[x, y]])
    if not np.isfinite(target).all():
        return UNCLEAR
    if not len(rows):
        return OPEN
    edges, radius, part = rows[_EDGE].to_numpy(dtype=float), rows["radius"].to_numpy(dtype=float), rows["part"].to_numpy()
    area = rows["polygonal"].to_numpy(dtype=bool)
    polygons = np.unique(part[area])
    within = _inside(target, edges[area], part[area])[0] if area.any() else np.zeros(0, dtype=bool)
    own = [p for p in polygons if within[p] and rows["building"].to_numpy()[part == p][0]][:1]
    foreign = ~np.isin(part, own)
    start = target
    if own:  # out of the own building along the shortest way, as far as its zone goes
        mine = edges[~foreign]
        near = _nearest(np.broadcast_to(target[0], (len(mine), 2)), mine)
        far = np.hypot(*(near - target).T)
        q, reach = near[far.argmin()], float(far.min())
        if reach < 1e-9:
            return UNCLEAR
        u, keep = (q - target[0]) / reach, float(radius[~foreign].max())
        if keep + 1e-6 >= APPROACH:
            return ENCLOSED  # the approach ends within the building's own zone
        start = (q + (keep + 1e-6) * u)[None]
        way = np.array([[x, y, *start[0]]])
        crossed = _contacts(np.repeat(way, int(foreign.sum()), axis=0), edges[foreign])[0] <= radius[foreign]
        if not Zones(edges[foreign], radius[foreign]).covers(target)[0] and crossed.any():
            return UNCLEAR
        if Zones(mine, radius[~foreign]).covers(start)[0]:
            return UNCLEAR  # the building bends round its own approach
    zones = Zones(edges, radius)
    others = [p for p in polygons if p not in own]
    if (area.any() and _inside(start, edges[area], part[area])[0][others].any()) or zones.covers(start)[0]:
        return ENCLOSED  # within another's zone
    turns = zones.turns(start)
    if not turns.any():
        return OPEN
    free = [p for line in lines for p in _free_parts(line, zones)]
    if free:
        points = np.array(free)
        if area.any():
            points = points[~_inside(points, edges[area], part[area])[:, polygons].any(axis=1)]
        if len(points) and (zones.turns(points) == turns).all(axis=0).any():
            return NETWORK
    return ENCLOSED


def blockers(edges: DataFrame, rule_rows: DataFrame, dn: int, width: float) -> DataFrame:
    """Edges of obstacles that a pipe of this size cannot pass, with the radius of their zones. Passages block where the zone that may be crossed is no longer than the clearance."""
    known = edges.join(F.broadcast(rule_rows), "type")  # one row a type
    keep = F.expr(rules.axis_clearance("type", str(dn), "clearance", str(width), "obstacle_width"))
    blocked = known.withColumn("_keep", keep).where("not special or _keep > margin + 1e-9").withColumn("radius", F.col("_keep") - SHRINK).where("radius > 0")
    return blocked.select("ordinal", "component", "polygonal", (F.col("type") == "oks").alias("building"), *_EDGE, "radius").dropna(subset=_EDGE)


def enclosures(targets: DataFrame, blocking: DataFrame, lines: DataFrame, window: float = WINDOW) -> DataFrame:
    """target, status. targets: target, x, y; blocking: from blockers(); lines: ax, ay, ex, ey."""

    def ends(a: str, b: str, f) -> Column:
        return f(F.col(a), F.col(b))

    box = ("_x0", "_y0", "_x1", "_y1")
    walls = blocking.select(F.lit(False).alias("line"), "ordinal", "component", "polygonal", "building", *_EDGE, "radius")
    pipes = lines.select(F.lit(True).alias("line"), F.lit(None).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("component"), F.lit(False).alias("polygonal"), F.lit(False).alias("building"), *[F.col(a).alias(b) for a, b in zip(("ax", "ay", "ex", "ey"), _EDGE, strict=True)], F.lit(0.0).alias("radius"))
    around = walls.unionByName(pipes.dropna(subset=_EDGE)).withColumns({"_x0": ends("cx", "dx", F.least), "_y0": ends("cy", "dy", F.least), "_x1": ends("cx", "dx", F.greatest), "_y1": ends("cy", "dy", F.greatest)})
    finite = targets.select("target", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("abs(x) < 1e9 and abs(y) < 1e9")
    near = near_join(finite, around, ("x", "y", "x", "y"), box, window, 256.0).drop(*box)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        walls = rows[~rows["line"]].copy()
        walls["part"] = walls.groupby(["ordinal", "component"], dropna=False).ngroup()
        lines = rows.loc[rows["line"], _EDGE].to_numpy(dtype=float)
        found = enclosure(float(rows["x"].iloc[0]), float(rows["y"].iloc[0]), walls, lines)
        return pd.DataFrame({"target": [rows["target"].iloc[0]], "status": [found]})

    decided = dealt(near, "target").groupBy("target").applyInPandas(run, "target long, status string")
    ids = targets.select("target", (F.coalesce(F.abs("x") < 1e9, F.lit(False)) & F.coalesce(F.abs("y") < 1e9, F.lit(False))).alias("_ok")).groupBy("target").agg(F.max("_ok").alias("_ok"))
    return ids.join(decided, "target", "left").select("target", F.when(~F.col("_ok"), UNCLEAR).otherwise(F.coalesce("status", F.lit(OPEN))).alias("status"))
