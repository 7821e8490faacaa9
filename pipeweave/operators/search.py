"""Grid searches around one target at a time.

Targets are the unit of parallel work: each group holds one target and the obstacles near it, which the
window of the search bounds. A target in a dense quarter costs more, never the others' results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pipeweave.operators.cells import dealt, near_join
from pipeweave.operators.graph import Inconclusive
from pipeweave.operators.restrict import B

#: Clearances are this much less on the raster, so that a cell is never closed that a way could use.
SHRINK = 0.75

STEPS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def scenes_of(targets: DataFrame, obstacles: DataFrame, reach: float) -> DataFrame:
    """One row for each target and each obstacle box near it; one without a box for a target without any. obstacles: x0, y0, x1, y1, keep (clearance)."""
    near = near_join(targets.select("target", "x", "y"), obstacles.select(*B, "keep"), ("x", "y", "x", "y"), B, reach + 12.0, 128.0).select("target", *B, "keep")
    return targets.select("target", "x", "y").join(near, "target", "left")


def _free(x: float, y: float, boxes: list[dict], reach: float, cell: float) -> np.ndarray:
    """Which cells of the window around the target have their middle outside of all boxes, widened by their clearance less SHRINK; the target's own is free."""
    n = int(2 * reach / cell) + 1
    free = np.ones((n, n), dtype=bool)
    at = lambda v: int(min(max(v, 0), n))
    for r in boxes:
        wide = max(0.0, r["keep"] - SHRINK)
        i0, j0 = (at(math.ceil((v - wide - o) / cell - 0.5)) for v, o in ((r["x0"], x - reach), (r["y0"], y - reach)))
        i1, j1 = (at(math.floor((v + wide - o) / cell - 0.5) + 1) for v, o in ((r["x1"], x - reach), (r["y1"], y - reach)))
        free[i0:i1, j0:j1] = False
    free[n // 2, n // 2] = True
    return free


def _each(scenes: DataFrame, more: list[str], find, schema: str) -> DataFrame:
    """What find makes of each target: a row with x, y, the columns of more and the list of its boxes, which the window bounds."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    box = F.when(F.col("x0").isNotNull(), F.struct(*B, "keep"))
    whole = scenes.groupBy("target").agg(*[F.first(c).alias(c) for c in ("x", "y", *more)], F.collect_list(box).alias("boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"target": r["target"], **find(r)} for r in batch.to_pylist()], arrow)

    return dealt(whole, "target").mapInArrow(run, schema)


def flood(free: np.ndarray) -> np.ndarray:
    """The free cells that hang together with the middle, over eight neighbours. Cells are the bits of one number, with a closed column beside each row, so that a step is a few shifts."""
    n, m = free.shape
    wide = m + 1
    bits = np.zeros((n, wide), dtype=bool)
    bits[:, :m] = free
    open_ = int.from_bytes(np.packbits(bits, axis=None, bitorder="little").tobytes(), "little")
    seen = 1 << (n // 2 * wide + m // 2)
    while True:
        row = seen | seen << 1 | seen >> 1
        new = (row | row << wide | row >> wide) & open_ | seen
        if new == seen:
            break
        seen = new
    out = np.unpackbits(np.frombuffer(seen.to_bytes((n * wide + 7) // 8, "little"), dtype=np.uint8), bitorder="little")[: n * wide]
    return out.reshape(n, wide)[:, :m].astype(bool)


def walk(free: np.ndarray, goals: np.ndarray, most: int = 300_000, guided: bool = False) -> list[tuple[int, int]] | None:
    """The shortest way from the middle to a goal cell, turning by 90 degrees at most and cutting no corner; None if there is none.

    Among equal ways the one whose states were queued first wins. Inconclusive after `most` states. A guided search looks at the states first whose way so far and least way on
    to the goals are shortest: ways have the same length, and as many steps, since no two numbers of straight and of diagonal steps have one length.
    """
    n = free.shape[0] // 2
    ahead = np.zeros(free.shape)
    if guided and goals.any():
        i, j = np.nonzero(goals)
        u, v = (np.maximum(0, np.maximum(a.min() - np.arange(size), np.arange(size) - a.max())) for a, size in zip((i, j), free.shape, strict=True))
        ahead = np.maximum(u[:, None], v[None]) + 0.4142135623730951 * np.minimum(u[:, None], v[None])
    ahead, free, goals = ahead.tolist(), free.tolist(), goals.tolist()
    rows, columns = len(free), len(free[0])
    queue: list[tuple[float, float, int, int, int, int]] = [(ahead[n][n], 0.0, 0, n, n, -1)]
    best, back, count = {(n, n, -1): 0.0}, {}, 0
    while queue and count < most:
        _, d, _, i, j, way = heapq.heappop(queue)
        d = -d if guided else d
        if d > best[i, j, way]:
            continue
        count += 1
        if goals[i][j]:
            out, at = [(i, j)], (i, j, way)
            while at in back:
                at = back[at]
                out.append(at[:2])
            return out[::-1]
        for k, (a, b) in enumerate(STEPS):
            if way >= 0 and min((k - way) % 8, (way - k) % 8) > 2:
                continue
            u, v = i + a, j + b
            if not (0 <= u < rows and 0 <= v < columns) or not free[u][v] or a and b and not (free[i][v] and free[u][j]):
                continue
            new = d + (1.4142135623730951 if a and b else 1.0)
            if new < best.get((u, v, k), np.inf) - 1e-9:
                best[u, v, k] = new
                back[u, v, k] = (i, j, way)
                heapq.heappush(queue, (round(new + ahead[u][v], 9) if guided else new, -new if guided else new, len(best), u, v, k))
    if queue:
        raise Inconclusive
    return None


def enclosures(scenes: DataFrame, reach: float = 60.0, cell: float = 1.0) -> DataFrame:
    """target, enclosed (the flood does not reach the edge of the window), cells it reached."""

    def find(r: dict) -> dict:
        seen = flood(_free(r["x"], r["y"], r["boxes"], reach, cell))
        open_ = seen[0].any() or seen[-1].any() or seen[:, 0].any() or seen[:, -1].any()
        return {"enclosed": not open_, "cells": int(seen.sum())}

    return _each(scenes, [], find, "target long, enclosed boolean, cells long")


def walks(scenes: DataFrame, ties: DataFrame, reach: float = 60.0, cell: float = 2.0) -> DataFrame:
    """target, status, length_m, steps of the grid way to the tie (target, tx, ty) of every target: FOUND, or SEARCH_INCOMPLETE, as the window is no proof that there is no way."""

    def find(r: dict) -> dict:
        none = {"status": "SEARCH_INCOMPLETE", "length_m": None, "steps": 0}
        if r["tx"] is None or r["ty"] is None:
            return none
        free = _free(r["x"], r["y"], r["boxes"], reach, cell)
        goals = np.zeros_like(free)
        i, j = (math.floor((r[t] - r[c] + reach) / cell) for t, c in (("tx", "x"), ("ty", "y")))
        if 0 <= i < len(free) and 0 <= j < len(free):
            goals[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2] = True
        try:
            goals &= flood(free)  # what the flood does not reach needs no search
            way = walk(free, goals, guided=True) if goals.any() else None
        except Inconclusive:
            way = None
        if way is None:
            return none
        return {"status": "FOUND", "length_m": sum(math.hypot(a - c, b - d) for (a, b), (c, d) in zip(way, way[1:], strict=False)) * cell, "steps": len(way) - 1}

    return _each(scenes.join(ties.select("target", "tx", "ty"), "target", "left"), ["tx", "ty"], find, "target long, status string, length_m double, steps long")


def turns_ok(points: DataFrame) -> DataFrame:
    """route, ok: no vertex of the polyline turns by more than 90 degrees. points: route, i, x, y."""
    from pyspark.sql import Window

    w = Window.partitionBy("route").orderBy("i")
    at = points.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    return at.groupBy("route").agg(F.coalesce(F.bool_and(F.expr("(x - px) * (nx - x) + (y - py) * (ny - y) >= -1e-9")), F.lit(True)).alias("ok"))
