"""Least-cost depth along a pipe: dynamic programming over stations and depth levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.functions.rules import LEAST_DEPTH, NORMAL_DEPTH, SLOPE
from pipeweave.operators import restrict
from pipeweave.operators.cells import dealt


def factor(h: np.ndarray) -> np.ndarray:
    return np.where(h <= NORMAL_DEPTH, 1.0, 1.0 + 0.1 * (h - NORMAL_DEPTH))


def ramp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean depth coefficient of a ramp, split where it passes the normal depth."""
    hi, lo = np.maximum(a, b), np.minimum(a, b)
    split = ((NORMAL_DEPTH - lo) + (hi - NORMAL_DEPTH) * (1 + factor(hi)) / 2) / np.maximum(hi - lo, 1e-12)
    return np.where(hi <= NORMAL_DEPTH, 1.0, np.where(lo >= NORMAL_DEPTH, (factor(a) + factor(b)) / 2, split))


def profile(at: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: float = 0.1, bias: float = 1e-7) -> np.ndarray | None:
    """The depth at each station, within its bounds and the slope, of the least cost; None if there is none.

    Cost of a part: its length x weight x depth coefficient, and a small pull to the normal depth. Of
    equal depths the shallower is taken.
    """
    top = max(float(np.max(np.where(np.isfinite(hi), hi, lo))), NORMAL_DEPTH) + step
    levels = np.unique(np.round(np.concatenate((np.arange(LEAST_DEPTH, top + step / 2, step), lo, hi[np.isfinite(hi)], [NORMAL_DEPTH])), 6))
    fits = (levels[None] >= lo[:, None] - 1e-9) & (levels[None] <= hi[:, None] + 1e-9)
    cost = np.where(fits[0], 0.0, np.inf)
    back = np.zeros((len(at), len(levels)), dtype=np.int64)
    mean = ramp(levels[:, None], levels[None])
    pull = (np.abs(levels[:, None] - NORMAL_DEPTH) + np.abs(levels[None] - NORMAL_DEPTH)) / 2
    rise = np.abs(levels[:, None] - levels[None])
    for i in range(1, len(at)):
        d = at[i] - at[i - 1]
        move = np.where(rise <= SLOPE * d + 1e-9, cost[:, None] + d * weight[i] * (mean + bias * pull), np.inf)
        back[i] = move.argmin(axis=0)
        cost = np.where(fits[i], move.min(axis=0), np.inf)
    if not np.isfinite(cost).any():
        return None
    k = int(cost.argmin())
    out = np.empty(len(at))
    for i in range(len(at) - 1, -1, -1):
        out[i] = levels[k]
        k = int(back[i, k])
    return out


def profile_all(at: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: float = 0.1, bias: float = 1e-7) -> np.ndarray:
    """profile() of many pipes of as many stations, a pipe in a row, whose levels are the same; a row of NaN where there is none. Only levels that one part's slope can reach are compared."""
    top = max(float(np.max(np.where(np.isfinite(hi), hi, lo))), NORMAL_DEPTH) + step
    levels = np.unique(np.round(np.concatenate((np.arange(LEAST_DEPTH, top + step / 2, step), lo.ravel(), hi[np.isfinite(hi)], [NORMAL_DEPTH])), 6))
    n, (pipes, stations) = len(levels), at.shape
    # A level in a row, a pipe in a column: levels next to each other are one piece of memory.
    fits = lambda i: (levels[:, None] >= lo[:, i] - 1e-9) & (levels[:, None] <= hi[:, i] + 1e-9)
    mean = ramp(levels[:, None], levels[None])
    pull = (np.abs(levels[:, None] - NORMAL_DEPTH) + np.abs(levels[None] - NORMAL_DEPTH)) / 2
    rise, unit = np.abs(levels[:, None] - levels[None]), mean + bias * pull
    each, moves = np.arange(n, dtype=np.int16)[:, None], {}
    cost, back = np.where(fits(0), 0.0, np.inf), np.zeros((stations, n, pipes), dtype=np.int16)
    for i in range(1, stations):
        d = at[:, i] - at[:, i - 1]
        reach, worth, far = SLOPE * d + 1e-9, d * weight[:, i], d.max(initial=0.0)
        if far not in moves:
            near = np.nonzero(rise <= SLOPE * far + 1e-9)
            moves[far] = [(k, np.diagonal(rise, -k)[:, None], np.diagonal(unit, -k)[:, None]) for k in np.unique(near[0] - near[1]).tolist()]  # from the shallowest level on, as argmin takes the first of equal ones
        best, least = np.full((n, pipes), np.inf), reach.min(initial=np.inf)
        for k, risen, costs in moves[far]:
            to, come = slice(max(0, -k), min(n, n - k)), slice(max(0, k), min(n, n + k))
            new = worth * costs
            new += cost[come]
            if risen.max(initial=0.0) > least:
                new[risen > reach] = np.inf
            less = new < best[to]
            np.copyto(best[to], new, where=less)
            np.copyto(back[i, to], each[come], where=less)
        cost = np.where(fits(i), best, np.inf)
    k, rows, out = cost.argmin(axis=0), np.arange(pipes), np.empty(at.shape)
    none = ~np.isfinite(cost).any(axis=0)
    for i in range(stations - 1, -1, -1):
        out[:, i] = levels[k]
        k = back[i][k, rows]
    out[none] = np.nan
    return out


def profiles(stations: DataFrame) -> DataFrame:
    """edge_id, at_m, depth. stations: edge_id, at_m, weight, lo, hi (infinity where open), of some hundred to a pipe. Pipes of as many stations and of the same bounds are computed side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, kinds = batch.column(1).value_lengths().to_numpy(), {}
            columns = [batch.column(1).flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at_m", "weight", "lo", "hi")]
            starts, depth = np.cumsum(many) - many, np.empty(len(columns[0]))
            for row, (a, n) in enumerate(zip(starts.tolist(), many.tolist(), strict=True)):
                bounds = np.concatenate([np.unique(c[a : a + n]) for c in columns[2:]])
                kinds.setdefault((n, bounds.tobytes()), []).append(row)
            for (n, _), alike in kinds.items():
                for part in (alike[i : i + 256] for i in range(0, len(alike), 256)):  # bounds what is held
                    each = starts[part][:, None] + np.arange(n)
                    depth[each] = profile_all(*(c[each] for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), many)), pa.array(columns[0]), pa.array(depth)], ["edge_id", "at_m", "depth"])

    one = F.struct(*[F.col(c).cast("double").alias(c) for c in ("at_m", "weight", "lo", "hi")])
    whole = stations.groupBy("edge_id").agg(F.sort_array(F.collect_list(one)).alias("s"))
    return dealt(whole, "edge_id").mapInArrow(run, "edge_id long, at_m double, depth double")


def _stations(edge: np.ndarray, lo: np.ndarray, hi: np.ndarray, coefficient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which edge, at_m and the greatest coefficient of the stations of sections: their ends and the whole metres between, each place of an edge once, in order."""
    first = np.ceil(lo)
    whole = np.maximum(0, np.floor(hi) - first + 1).astype(np.int64)
    section = np.repeat(np.arange(len(edge)), whole)
    metre = first[section] + np.arange(len(section)) - np.repeat(np.cumsum(whole) - whole, whole)
    of, at, weight = np.concatenate((edge, edge, edge[section])), np.concatenate((lo, hi, metre)), np.concatenate((coefficient, coefficient, coefficient[section]))
    order = np.lexsort((at, of))
    of, at, weight = of[order], at[order], weight[order]
    start = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])))[: len(of)])
    return of[start], at[start], np.maximum.reduceat(weight, start) if len(start) else weight


def section_profiles(passages: DataFrame, bounded: float, most: float, least: float = LEAST_DEPTH, key: str = "edge_id") -> DataFrame:
    """key, at_m, depth at the stations of each edge's sections (restrict.section_arrays): where the coefficient is `bounded`, the pipe is at most `most` deep.

    One shuffle of the passages, sorted by edge; sections, stations and depths are made of them in Arrow batches, and none of these is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in restrict._edges(batches):
            keys, edge, lo, hi, coefficient, *_ = restrict._cut(rows)
            of, at, weight = _stations(edge, lo, hi, coefficient)
            depth, start = np.empty(len(at)), np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))[: len(of)])
            many, under = np.diff(np.append(start, len(of))), weight == bounded
            some, open_ = (np.bincount(of[x], minlength=len(keys))[of[start]] > 0 for x in (under, ~under))
            # Edges whose bounds are the same side by side, the shorter ones with their last station again: a step of no length moves nothing.
            order = np.lexsort((many, open_, some))
            for one in np.unique(2 * some + open_).tolist():
                alike = order[(2 * some + open_)[order] == one]
                for part in (alike[i : i + 256] for i in range(0, len(alike), 256)):  # bounds what is held
                    each = start[part][:, None] + np.minimum(np.arange(many[part].max()), many[part][:, None] - 1)
                    depth[each] = profile_all(at[each], weight[each], np.full(each.shape, least), np.where(under[each], most, np.inf))
            if len(at):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(at), pa.array(depth)], [key, "at_m", "depth"])

    return restrict._by_edge(passages, key).mapInArrow(run, f"{key} {dict(passages.dtypes)[key]}, at_m double, depth double")
