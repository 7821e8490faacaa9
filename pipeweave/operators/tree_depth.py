"""Least-cost depths of whole forests of pipes: dynamic programming from the leaves, recovery from the roots.

Pipes between branchings are a run; runs are cut into pieces of at most RUN pipes. Pieces are dealt by their distance from the root. Going up,
each level's pieces are costed at once, a piece in a row: an array with the least cost of all below for each depth of its upper
end. Arrays of pieces that meet in a node are added element by element, so that a node of many branches is no large
group. Going down, each piece gets the depth of its upper end from the level above and is walked. So jobs grow with the
height of the tree in pieces, and what a task holds is some pieces, whose pipes it takes side by side.

Depths at a station are levels: a grid of one centimetre for plans of any size, and every bound that a passage sets. A passage laid
specially is one straight ramp within one allowed interval. Slopes are at most SLOPE; cost is length x rate x coefficient x mean
depth coefficient, and a very small pull to the normal depth. A tree that no depths fit is infeasible, and all its pipes with it.

Rows: one a pipe. Sections outside the pipe are clipped. A pipe that does not hang on a root (a cycle) is
infeasible. Null or empty sections are none. An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeweave.functions.rules import LEAST_DEPTH, NORMAL_DEPTH, SLOPE, allowed_depths
from pipeweave.operators.depth import factor, ramp
from pipeweave.operators.network import chains
from pipeweave.storage import Scratch

#: Pipes in a row at most.
RUN = 64
#: Metres of pipe that a task costs (fewer, but no less than so many, where cores would be idle), pieces that it takes side by side, and stations whose costs it keeps to walk by.
AT_ONCE, AT_LEAST, SIDE_BY_SIDE, KEPT = 100_000, 10_000, 256, 100_000
#: Metres between two levels.
GRID = 0.01
PULL = 1e-7
_NEAR = 60.0  # from a passage on, where fine stations end

SECTION = "struct<from_m: double, to_m: double, coefficient: double, special: boolean, types: array<string>, heights: array<double>>"
_OUT = "node long, feasible boolean, cost double, from_depth double, to_depth double, knots array<struct<at_m: double, depth_m: double>>, bottom long, level int"


class Edge:
    """Stations of one pipe from its upper end on, and what lies between them."""

    def __init__(self, row: dict, step: float, fine: float) -> None:
        length = float(row["length_m"])
        self.length, self.rate = length, float(row["rate"])
        clip = lambda v: min(max(float(v), 0.0), length)
        self.sections = []
        for s in row["sections"] or []:
            sets = [allowed_depths(t, float(row["height"]), h) for t, h in zip(s["types"] or [], s["heights"] or [None] * len(s["types"] or []), strict=True)]
            if clip(s["to_m"]) > clip(s["from_m"]):
                self.sections.append((clip(s["from_m"]), clip(s["to_m"]), float(s["coefficient"]), bool(s["special"]), sets))
        self.cuts = sorted({0.0, length, *[x for s in self.sections for x in s[:2]]})
        bound = {x: self._bounds(x) for s in self.sections if s[4] for x in s[:2]}
        reached = {b + d for b, levels in bound.items() for v in levels for d in (abs(v - NORMAL_DEPTH) / SLOPE, -abs(v - NORMAL_DEPTH) / SLOPE)}
        anchors = sorted([*bound, *reached])
        near = lambda x: (i := bisect_left(anchors, x - 1e-6)) < len(anchors) and anchors[i] - x < 1e-6
        ordered = sorted(reached)
        at, special = [self.cuts[0]], []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            if any(f <= a and b <= t and s for f, t, _, s, _ in self.sections):
                at.append(b)
                special.append(True)
                continue
            inner = [a, *(x for x in ordered[bisect_left(ordered, a + 1e-6) :] if a + 1e-6 < x < b - 1e-6), b]
            for p, q in zip(inner[:-1], inner[1:], strict=True):
                if q - p < 1e-6 and q != b:
                    continue
                p = at[-1]
                ramped = q - p <= _NEAR and (near(p) or near(q))
                new = np.append(np.arange(p + fine, q - 1e-6, fine), q) if ramped else np.linspace(p, q, max(1, int(np.ceil((q - p) / step - 1e-9))) + 1)[1:]
                at += new.tolist()
                special += [False] * len(new)
        self.at, self.special = np.array(at), np.array(special, dtype=bool)
        mid = (self.at[1:] + self.at[:-1]) / 2
        f, to, k = (np.array([s[i] for s in self.sections], dtype=float)[:, None] for i in range(3))
        on = (f < mid) & (mid < to)  # sections by steps
        self.weight = self.rate * np.where(on, k, 1.0).max(axis=0, initial=1.0)
        self.within = defaultdict(list)
        for s, steps in zip(self.sections, on, strict=True):
            for i in np.flatnonzero(steps).tolist() if s[4] else ():
                self.within[i] += s[4]

    def items(self, levels: Levels) -> list[tuple[int, int, bool, np.ndarray | None]]:
        """From the lower end on: runs of steps between two stations that nothing bounds within, and passages, as first and last station, what names the moves of a passage (None: a run), and the levels at the first (None: all)."""
        bound, weights = {}, np.flatnonzero(np.diff(self.weight)) + 1
        for f, t, _, _, sets in self.sections:
            if sets:
                fits = levels.allowed(tuple(map(tuple, sets)))
                for k in range(*np.searchsorted(self.at, [f - 1e-9, np.nextafter(t + 1e-9, np.inf)]).tolist()):
                    bound[k] = bound[k] & fits if k in bound else fits
        passages = np.flatnonzero(self.special).tolist()
        ends = sorted({0, len(self.at) - 1, *bound, *passages, *(k + 1 for k in passages), *weights.tolist()})
        self.bottom = bound.get(len(self.at) - 1)
        return [(i, j, (int(levels.reach(self.at[j] - self.at[i])), self.sets(i)) if self.special[i] else None, bound.get(i)) for i, j in pairwise(ends)][::-1]

    def _bounds(self, x: float) -> set[float]:
        """Levels that the passages at x set."""
        return {v for f, t, _, _, sets in self.sections if f - 1e-9 <= x <= t + 1e-9 for s in sets for i in s for v in i if np.isfinite(v) and v >= LEAST_DEPTH}

    def critical(self) -> set[float]:
        return {v for x in self.cuts for v in self._bounds(x)}

    def sets(self, k: int) -> tuple:
        """Of a passage, the intervals that a straight ramp stays in one of each of."""
        return tuple(map(tuple, self.within[k])) if self.special[k] else ()

    def masks(self, levels: np.ndarray) -> np.ndarray:
        out = np.ones((len(self.at), len(levels)), dtype=bool)
        for f, t, _, _, sets in self.sections:
            here = (self.at >= f - 1e-9) & (self.at <= t + 1e-9)
            for s in sets:
                out[here] &= np.any([_inside(levels, i) for i in s], axis=0)
        return out


def _inside(levels: np.ndarray, interval: tuple[float, float]) -> np.ndarray:
    return (levels >= interval[0] - 1e-9) & (levels <= interval[1] + 1e-9)


class Levels:
    """Depth levels, with the moves between them by how far a step may go."""

    def __init__(self, values: np.ndarray) -> None:
        self.h, self._moves, self._steps, self._starts, self._windows, self._allowed = values, {}, {}, {}, {}, {}
        self.factor, self.off = factor(values), np.abs(values - NORMAL_DEPTH)
        self.apart = np.unique(np.round(values[:, None] - values, 9))
        self.apart = self.apart[self.apart >= 0]
        self.kept, self.used = np.empty((0, len(values) + 1)), 0

    def moves(self, reach: float):
        """For each level the levels within reach, with the mean depth coefficient and the mean distance from the normal depth of the ramp there."""
        key = round(reach, 9)
        if key not in self._moves:
            if len(self._moves) > 64:
                self._moves.clear()
            lo, hi = np.searchsorted(self.h, self.h - reach - 1e-9), np.searchsorted(self.h, self.h + reach + 1e-9, side="right")
            to = lo[:, None] + np.arange(int((hi - lo).max()))
            fits = to < hi[:, None]
            to = np.minimum(to, len(self.h) - 1)
            a, b = self.h[:, None], self.h[to]
            self._moves[key] = to, fits, ramp(np.broadcast_to(a, b.shape), b), (np.abs(a - NORMAL_DEPTH) + np.abs(b - NORMAL_DEPTH)) / 2
        return self._moves[key]

    def step(self, d: float, weight: float, rate: float, sets: tuple) -> tuple[np.ndarray, np.ndarray]:
        """For each level the levels that a step of d metres leads to, and what it costs; infinite where it leads nowhere. sets: intervals, a straight ramp stays in one of each."""
        key = d, weight, rate, sets
        if key not in self._steps:
            if len(self._steps) > 4096:
                self._steps.clear()
            to, fits, mean, pull = self.moves(SLOPE * d)
            cost = np.where(fits, d * (weight * mean + rate * PULL * pull), np.inf)
            for s in sets:
                cost = np.where(np.any([_inside(self.h, i)[:, None] & _inside(self.h, i)[to] for i in s], axis=0), cost, np.inf)
            self._steps[key] = to, cost
        return self._steps[key]

    def allowed(self, sets: tuple) -> np.ndarray:
        if sets not in self._allowed:
            if len(self._allowed) > 4096:
                self._allowed.clear()
            self._allowed[sets] = np.all([np.any([_inside(self.h, i) for i in s], axis=0) for s in sets], axis=0) if sets else np.ones(len(self.h), dtype=bool)
        return self._allowed[sets]

    def reach(self, d: np.ndarray) -> np.ndarray:
        """How far steps of d metres lead: the number of distances between levels that fit. Steps of one number have the same moves."""
        return np.searchsorted(self.apart, SLOPE * d + 1e-9, side="right") - 1

    def windows(self, reach: int, sets: tuple = ()) -> Windows:
        """The moves of steps that reach so far, as windows of levels."""
        key = int(reach), sets
        if key not in self._windows:
            if len(self._windows) > 1024:
                self._windows.clear()
            self._windows[key] = Windows(self, float(self.apart[reach]), sets)
        return self._windows[key]

    def keep(self, costs: np.ndarray) -> np.ndarray:
        """A copy of some rows, in memory that is taken once and given back by setting `used` to 0."""
        end = self.used + len(costs)
        if end > len(self.kept):
            if end > KEPT:
                return costs.copy()
            self.kept, self.used, end = np.empty((KEPT, len(self.h) + 1)), 0, len(costs)
        out, self.used = self.kept[self.used : end], end
        out[:] = costs
        return out

    def starts(self, shape: tuple[int, int]) -> np.ndarray:
        """Where the rows of an array of this shape begin in its values."""
        if shape not in self._starts:
            self._starts[shape] = np.arange(shape[0]) * shape[1]
        return self._starts[shape]


class Windows:
    """Which levels a step leads to from each level, all next to each other.

    On one side of the normal depth a ramp costs the mean of its ends, so that the least cost of a move is a least value in a window, which two
    spans of a power of two cover. Ramps through the normal depth are compared one by one.
    """

    def __init__(self, levels: Levels, reach: float, sets: tuple) -> None:
        h = levels.h
        n, shallow, deep = len(h), h <= NORMAL_DEPTH, h >= NORMAL_DEPTH
        lo, hi = np.searchsorted(h, h - reach - 1e-9), np.searchsorted(h, h + reach + 1e-9, side="right")
        for s in sets:
            # A level's interval is the one that holds it: passages name none that overlap.
            on = [np.flatnonzero(_inside(h, i)) for i in s]
            first, past = np.full(n, n), np.zeros(n, dtype=int)
            for i in on:
                first[i], past[i] = i[0] if len(i) else n, i[-1] + 1 if len(i) else 0
            if sum(map(len, on)) > (past > 0).sum():
                raise ValueError("intervals of a passage overlap")
            lo, hi = np.maximum(lo, first), np.minimum(hi, past)
        self.lo, self.hi = lo, np.maximum(hi, lo)
        side_lo, side_hi = np.where(shallow, lo, np.maximum(lo, int(np.argmax(deep)) if deep.any() else n)), np.where(deep, hi, np.minimum(hi, int(shallow.sum())))
        width = side_hi - side_lo
        self.none, self.wide = np.flatnonzero(width <= 0), np.flatnonzero(width > 1)
        self.power = np.array([int(w).bit_length() - 1 for w in np.maximum(width, 1).tolist()])
        self.one, self.two = np.where(width > 0, side_lo, 0), np.where(width > 0, side_hi - (1 << self.power), 0)
        a, b = np.flatnonzero(~deep & (hi > shallow.sum()) & (hi > lo)), np.flatnonzero(~shallow & (lo < np.argmax(deep)) & (hi > lo))
        self.through, self.seen = None, {}
        if len(a) and len(b):
            a, b = slice(a[0], a[-1] + 1), slice(b[0], b[-1] + 1)
            over = (np.arange(b.start, b.stop) < hi[a][:, None]) & (np.arange(b.start, b.stop) >= lo[a][:, None])
            mean = ramp(np.broadcast_to(h[a][:, None], over.shape), np.broadcast_to(h[b], over.shape))
            self.through = a, b, np.where(over, mean, np.inf), (levels.off[a][:, None] + levels.off[b]) / 2

    def least(self, levels: Levels, below: np.ndarray, d: np.ndarray, weight: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """The least cost for each level after a step of d metres, a pipe in a row."""
        half = (d * weight / 2)[:, None] * levels.factor + (d * rate * (PULL / 2))[:, None] * levels.off
        span = below + half
        out = span + half
        # Rows one after another: a span that leaves its row is never asked for. Few levels with others in reach are taken alone.
        at = self.wide if len(self.wide) < len(levels.h) // 4 else slice(None)
        power, many = self.power[at], below.size
        spans = np.empty((int(power.max(initial=0)) + 1, many))
        spans[0] = span.ravel()
        for j in range(1, len(spans)):
            w = 1 << j - 1
            np.minimum(spans[j - 1, :-w], spans[j - 1, w:], out=spans[j, :-w])
        rows, power = (np.arange(len(below)) * below.shape[1])[:, None], power * many
        if len(power):
            out[:, at] = np.minimum(spans.take(rows + (power + self.one[at])), spans.take(rows + (power + self.two[at]))) + half[:, at]
        if len(self.none):
            out[:, self.none] = np.inf
        if self.through:
            a, b, mean, pull = self.through
            if mean.size * len(below) < 10_000:
                ways = (d * weight)[:, None, None] * mean + (d * rate * PULL)[:, None, None] * pull
                out[:, a] = np.minimum(out[:, a], (ways + below[:, None, b]).min(axis=2))
                out[:, b] = np.minimum(out[:, b], (ways + below[:, a, None]).min(axis=1))
            else:
                for row, cost in enumerate(below):
                    ways = self._ways(float(d[row]), float(weight[row]), float(rate[row]))
                    out[row, a] = np.minimum(out[row, a], (ways + cost[b]).min(axis=1))
                    out[row, b] = np.minimum(out[row, b], (ways + cost[a, None]).min(axis=0))
        return out

    def _ways(self, d: float, weight: float, rate: float) -> np.ndarray:
        """What the ramps through the normal depth cost."""
        if (d, weight, rate) not in self.seen:
            if len(self.seen) > 31:
                self.seen.clear()
            _, _, mean, pull = self.through
            self.seen[d, weight, rate] = d * weight * mean + d * rate * PULL * pull
        return self.seen[d, weight, rate]

    def choice(self, levels: Levels, at: np.ndarray, below: np.ndarray, d: np.ndarray, weight: np.ndarray, rate: np.ndarray) -> np.ndarray:
        """The level to go to from level `at` of each row of below at the least cost, the shallowest of equal ones."""
        lo, hi = self.lo[at], self.hi[at]
        to = lo[:, None] + np.arange(int((hi - lo).max()))
        fits = to < hi[:, None]
        to = np.minimum(to, len(levels.h) - 1)
        a, b = np.broadcast_to(levels.h[at][:, None], to.shape), levels.h[to]
        cost = (d * weight)[:, None] * ramp(a, b) + (d * rate * (PULL / 2))[:, None] * (levels.off[at][:, None] + levels.off[to])
        best = np.where(fits, np.take_along_axis(below, to, axis=1) + cost, np.inf).argmin(axis=1)
        return lo + best


class Run:
    """Runs of steps of many pipes side by side, the longest first: one step of all is some operations on whole arrays.

    Most steps are `fine` metres, of one level; other ones, where stations do not fit, take windows of their own.
    """

    def __init__(self, edges: list[Edge], spans: list[tuple[int, int]], levels: Levels, fine: float) -> None:
        self.levels, self.fine, self.many = levels, fine, np.array([j - i for i, j in spans])
        self.active = (self.many[:, None] > np.arange(self.many[0])).sum(axis=0).tolist()
        self.d = np.zeros((len(edges), self.many[0]))
        for row, e, (i, j) in zip(self.d, edges, spans, strict=True):
            row[: j - i] = np.diff(e.at[i : j + 1])[::-1]
        self.weight, self.rate = np.array([e.weight[i] for e, (i, _) in zip(edges, spans, strict=True)]), np.array([e.rate for e in edges])
        reach, one = levels.reach(self.d), int(levels.reach(np.array(fine)))
        self.windows = levels.windows(one)
        h, lo, hi = levels.h, self.windows.lo, self.windows.hi
        each = np.arange(len(h))
        # The next levels are in reach of all, and none beyond the normal depth: then windows are shifts of whole rows.
        self.even = not self.windows.through and NORMAL_DEPTH in h and bool((hi[:-1] > each[1:]).all() and (lo[1:] < each[1:]).all())
        # Steps a little off are of the same reach, but cost less.
        odd = (reach != one) | (np.abs(self.d - fine) > 1e-9) if self.even else np.ones(self.d.shape, dtype=bool)
        odd[np.arange(self.d.shape[1]) >= self.many[:, None]] = False
        self.odd = defaultdict(list)
        for k, r, row in sorted(zip(np.nonzero(odd)[1].tolist(), reach[odd].tolist(), np.nonzero(odd)[0].tolist(), strict=True)):
            if self.odd[k] and self.odd[k][-1][0] == r:
                self.odd[k][-1][1].append(row)
            else:
                self.odd[k].append((r, [row]))
        self.more = [(o, each[hi - each > o], each[each - lo >= o]) for o in range(2, int(max((hi - each).max() - 1, (each - lo).max())) + 1)] if self.even else []

    def up(self, below: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The least costs at the upper ends; kept gets those before each step, with half of what a fine step costs at its ends.

        Rows lie one after another, with an infinite level between them, so that a shift of all is one of each.
        """
        levels, n, out = self.levels, below.shape[1], np.empty_like(below)
        self.half = half = (self.fine * self.weight / 2)[:, None] * levels.factor + (self.fine * self.rate * (PULL / 2))[:, None] * levels.off
        whole, now, then = (np.full((len(below), n + 1), np.inf) for _ in range(3))
        whole[:, :n] = 2 * half
        now[:, :n] = below + half
        for k, many in enumerate(self.active):
            u, new = now[:many], then[:many]
            if kept is not None:
                kept.append(levels.keep(u))
            if self.even:
                flat, least = u.reshape(-1), new.reshape(-1)
                np.minimum(flat[:-1], flat[1:], out=least[:-1])
                np.minimum(least[1:], flat[:-1], out=least[1:])
                least[0] = min(flat[0], flat[1])
                for o, far, back in self.more:
                    new[:, far] = np.minimum(new.take(far, axis=1), u.take(far + o, axis=1))
                    new[:, back] = np.minimum(new.take(back, axis=1), u.take(back - o, axis=1))
                new += whole[:many]
            for reach, rows in self.odd.get(k, ()):
                new[rows, :n] = levels.windows(reach).least(levels, u[rows, :n] - half[rows], self.d[rows, k], self.weight[rows], self.rate[rows]) + half[rows]
            left = self.active[k + 1] if k + 1 < len(self.active) else 0
            out[left:many] = new[left:, :n] - half[left:many]
            now, then = then, now
        return out

    def down(self, level: np.ndarray, kept: list) -> np.ndarray:
        """The levels after each step from the upper ends on, a pipe in a row, whose last step is first in it."""
        levels, path, now = self.levels, np.zeros(self.d.shape, dtype=int), level.copy()
        if self.even:
            o = self.more[-1][0] if self.more else 1
            each = np.arange(len(levels.h))[:, None] + np.arange(-o, o + 1)
            fits = (each >= self.windows.lo[:, None]) & (each < self.windows.hi[:, None])
            each = np.clip(each, 0, len(levels.h) - 1)
            none, each_row = np.where(fits, 0.0, np.inf), np.arange(len(level))
        for k in range(len(self.active) - 1, -1, -1):
            n = self.active[k]
            at = now[:n].copy()
            if self.even:
                to = each[at]
                now[:n] = to[each_row[:n], (kept[k][each_row[:n, None], to] + none[at]).argmin(axis=1)]
            for reach, rows in self.odd.get(k, ()):
                w, here = levels.windows(reach), at[rows]
                now[rows] = here
                if (w.hi[here] - w.lo[here] > 1).any():
                    now[rows] = w.choice(levels, here, kept[k][rows, :-1] - self.half[rows], self.d[rows, k], self.weight[rows], self.rate[rows])
            path[:n, k] = now[:n]
        return path


def climb(edges: list[Edge], below: np.ndarray, levels: Levels, fine: float, way: list | None = None) -> np.ndarray:
    """backward() of many pipes, one in a row of below. way gets what descend() goes by."""
    cost, items = below.copy(), [e.items(levels) for e in edges]
    for row, e in zip(cost, edges, strict=True):
        if e.bottom is not None:
            row[~e.bottom] = np.inf
    at, some = [0] * len(edges), list(range(len(edges)))
    while some:
        kinds = True
        while kinds:
            kinds = defaultdict(list)
            for p in some:
                if at[p] < len(items[p]) and items[p][at[p]][2]:
                    kinds[items[p][at[p]][2]].append(p)
            for key, alike in kinds.items():
                first = [items[p][at[p]][0] for p in alike]
                d, weight, rate = (np.array(x) for x in zip(*((edges[p].at[k + 1] - edges[p].at[k], edges[p].weight[k], edges[p].rate) for p, k in zip(alike, first, strict=True)), strict=True))
                before = cost[alike]
                if way is not None:
                    way.append((levels.windows(*key), alike, first, before, d, weight, rate))
                cost[alike] = levels.windows(*key).least(levels, before, d, weight, rate)
                for p in alike:
                    fits = items[p][at[p]][3]
                    if fits is not None:
                        cost[p][~fits] = np.inf
                    at[p] += 1
        some = sorted((p for p in some if at[p] < len(items[p])), key=lambda p: items[p][at[p]][0] - items[p][at[p]][1])
        if some:
            spans = [items[p][at[p]][:2] for p in some]
            run, kept = Run([edges[p] for p in some], spans, levels, fine), None if way is None else []
            cost[some] = run.up(cost[some], kept)
            if way is not None:
                way.append((run, some, spans, kept))
            for p in some:
                fits = items[p][at[p]][3]
                if fits is not None:
                    cost[p][~fits] = np.inf
                at[p] += 1
    return cost


def descend(edges: list[Edge], level: list[int], levels: Levels, way: list) -> list[np.ndarray]:
    """The level at each station of each pipe from that of its upper end on."""
    path = [np.full(len(e.at), i) for e, i in zip(edges, level, strict=True)]
    for entry in reversed(way):
        if len(entry) > 4:
            windows, some, first, cost, *step = entry
            for p, k, i in zip(some, first, windows.choice(levels, np.array([path[p][k] for p, k in zip(some, first, strict=True)]), cost, *step).tolist(), strict=True):
                path[p][k + 1] = i
        else:
            run, some, spans, kept = entry
            found = run.down(np.array([path[p][i] for p, (i, _) in zip(some, spans, strict=True)]), kept)
            for p, (i, j), row in zip(some, spans, found, strict=True):
                path[p][i + 1 : j + 1] = row[: j - i][::-1]
    return path


def backward(edge: Edge, below: np.ndarray, levels: Levels) -> tuple[np.ndarray, list[np.ndarray]]:
    """The least cost of the pipe and all below for each level of its upper end, and the level to go to from each level of each station."""
    masks = edge.masks(levels.h)
    free, d, weight = masks.all(axis=1).tolist(), np.diff(edge.at).tolist(), edge.weight.tolist()
    cost, choice = np.where(masks[-1], below, np.inf), []
    for k in range(len(d) - 1, -1, -1):
        to, step = levels.step(d[k], weight[k], edge.rate, tuple(map(tuple, edge.within[k])) if edge.special[k] else ())
        total = cost[to] + step
        best = total.argmin(axis=1) + levels.starts(total.shape)
        cost = total.ravel()[best]
        if not free[k]:
            cost = np.where(masks[k], cost, np.inf)
        choice.append(to.ravel()[best])
    return cost, choice[::-1]


def knots(edge: Edge, depth: np.ndarray) -> list[tuple[float, float]]:
    """Where the slope changes or the normal depth is passed. Between sections, where depth costs nothing, the plain profile of equal ends."""
    at, h = edge.at, depth
    out: list[tuple[float, float]] = [(0.0, float(h[0]))]
    for a, b in zip(edge.cuts[:-1], edge.cuts[1:], strict=True):
        i, j = (int(np.searchsorted(at, x - 1e-9)) for x in (a, b))
        free = not edge.special[i] and not edge.within[i] and h[i : j + 1].max() <= NORMAL_DEPTH + 1e-9
        if free:
            up, down = (NORMAL_DEPTH - h[i]) / SLOPE, (NORMAL_DEPTH - h[j]) / SLOPE
            if up + down <= b - a + 1e-9:
                out += [(a + up, NORMAL_DEPTH), (b - down, NORMAL_DEPTH)]
        else:
            for k in range(i, j):
                if (h[k] - NORMAL_DEPTH) * (h[k + 1] - NORMAL_DEPTH) < -1e-12:
                    out.append((float(at[k] + (NORMAL_DEPTH - h[k]) / (h[k + 1] - h[k]) * (at[k + 1] - at[k])), NORMAL_DEPTH))
                if k + 1 < j:
                    out.append((float(at[k + 1]), float(h[k + 1])))
        out.append((float(b), float(h[j])))
    kept = [out[0]]
    for now, then in zip(out[1:], [*out[2:], None], strict=True):
        if now[0] - kept[-1][0] < 1e-9:
            continue
        if then is not None and then[0] - now[0] > 1e-9:
            s, t = (now[1] - kept[-1][1]) / (now[0] - kept[-1][0]), (then[1] - now[1]) / (then[0] - now[0])
            if abs(s - t) < 1e-9 and not (abs(now[1] - NORMAL_DEPTH) < 1e-9 and abs(s) > 1e-12):
                continue
        kept.append(now)
    return kept


def make_levels(critical: set[float], grid: float) -> np.ndarray:
    """From the least depth to a step below the deepest bound; nothing deeper is ever cheaper."""
    top = max([NORMAL_DEPTH, *critical]) + grid
    values = np.unique(np.round([*np.arange(LEAST_DEPTH, top + 1e-9, grid), *critical, LEAST_DEPTH, NORMAL_DEPTH], 9))
    return values[np.concatenate(([True], np.diff(values) > 1e-7))]


def oriented(pipes: DataFrame, ties: DataFrame) -> DataFrame:
    """pipe, parent, node, forward: pipes (pipe, a, b) from the ties (node) outwards, where forward means from a to b.

    A frontier moves one pipe a round; of several ways to a node the one from the smallest node, then of the smallest pipe, is its own. Pipes that
    close a cycle or hang on no tie are left out. Loops and null ends likewise.
    """
    scratch = Scratch(pipes.sparkSession, "oriented")
    both = pipes.where("a <> b").select("pipe", F.col("a").alias("parent"), F.col("b").alias("node"), F.lit(True).alias("forward"))
    both = scratch.keep(both.unionByName(pipes.where("a <> b").select("pipe", F.col("b").alias("parent"), F.col("a").alias("node"), F.lit(False).alias("forward"))), "both")
    seen = scratch.keep(ties.select("node").where("node is not null").distinct(), "seen")
    front, found = seen, []
    while not front.isEmpty():
        new = both.join(front.select(F.col("node").alias("parent")), "parent", "left_semi").join(seen, "node", "left_anti")
        step = scratch.keep(new.groupBy("node").agg(F.min(F.struct("parent", "pipe", "forward")).alias("s")).select("node", "s.*"), "step")
        found.append(step)
        front = step.select("node")
        seen = scratch.keep(seen.unionByName(front), "seen")
    return reduce(DataFrame.unionByName, found, both.limit(0)).select("pipe", "parent", "node", "forward")


def _critical(pipes: DataFrame) -> set[float]:
    """The bounds that the passages set: each kind of passage under or over each size of pipe once."""
    within = pipes.select("height", "length_m", F.inline("sections")).where("least(greatest(to_m, 0), length_m) > least(greatest(from_m, 0), length_m)")
    kinds = within.select("height", "heights", F.posexplode("types").alias("_at", "type")).select("height", "type", F.expr("get(heights, _at)").alias("other")).distinct().collect()
    return {v for r in kinds for i in allowed_depths(r["type"], r["height"], r["other"]) for v in i if np.isfinite(v) and v >= LEAST_DEPTH}


@lru_cache(maxsize=1)
def _levels(values: tuple[float, ...]) -> Levels:
    """The same for all tasks of a worker, with the moves that are known already."""
    return Levels(np.array(values))


def _waves(rows: list[dict], levels: Levels, step: float, fine: float, whole: bool) -> Iterator[tuple[list[int], list[Edge], np.ndarray, np.ndarray]]:
    """The pipes of pieces side by side, from the lowest of each on: which pieces, their pipes, the costs below, and at the upper end of all pieces, of the uppermost pipe only if whole."""
    cost = np.array([r["below"] or np.zeros(len(levels.h)) for r in rows], dtype=float).reshape(len(rows), len(levels.h))
    for j in range(max(len(r["pipes"]) for r in rows)):
        some = [i for i, r in enumerate(rows) if len(r["pipes"]) > j]
        some.sort(key=lambda i: -len(rows[i]["pipes"]))
        edges, below = [Edge(rows[i]["pipes"][-1 - j], step, fine) for i in some], cost[some]
        n = len(some) if whole else sum(len(rows[i]["pipes"]) > j + 1 for i in some)
        if n:
            cost[some[:n]] = climb(edges[:n], below[:n], levels, fine)
        yield some, edges, below, cost


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _upward(values: list[float], step: float, fine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _levels(tuple(values))
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                rows = batch.slice(at, SIDE_BY_SIDE).to_pylist()
                *_, (_, _, _, cost) = _waves(rows, levels, step, fine, True)
                yield pa.RecordBatch.from_arrays([pa.array([r["top"] for r in rows], pa.int64()), _lists(cost)], ["top", "cost"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of each node, from rows in order of nodes: of a node with many branches no more than a batch is held."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        top, cost = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
        top, cost = top[first], np.add.reduceat(cost, first, axis=0)
        if last is not None and last[0][0] == top[0]:
            cost[0] += last[1][0]
        elif last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), _lists(last[1])], ["top", "cost"])
        if len(top) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(top[:-1]), _lists(cost[:-1])], ["top", "cost"])
        last = top[-1:], cost[-1:].copy()
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), _lists(last[1])], ["top", "cost"])


def _walked(rows: list[dict], levels: Levels, step: float, fine: float) -> list[list[tuple]]:
    """feasible, cost, from_depth, to_depth and knots of the pipes of pieces, from the upper end of each on, and as the last the level of its lower end."""
    level, found = [-1 if r["level"] is None else r["level"] for r in rows], [[] for _ in rows]
    for i, r in enumerate(rows):
        if level[i] < 0:
            found[i] = [(False, None, None, None, None)] * len(r["pipes"])
    some = [i for i in range(len(rows)) if level[i] >= 0]
    waves = list(_waves([rows[i] for i in some], levels, step, fine, False)) if some else []
    for which, edges, below, _ in reversed(waves):
        while which:
            # As many as their costs can be kept of.
            ends = np.cumsum([len(e.at) for e in edges])
            n = max(1, int(np.searchsorted(ends, KEPT, side="right")))
            way, levels.used = [], 0
            above = climb(edges[:n], below[:n], levels, fine, way)
            paths = descend(edges[:n], [level[some[w]] for w in which[:n]], levels, way)
            for w, e, path, up, low in zip(which[:n], edges[:n], paths, above, below[:n], strict=True):
                depth = levels.h[path]
                found[some[w]].append((True, float(up[path[0]] - low[path[-1]]), float(depth[0]), float(depth[-1]), [{"at_m": a, "depth_m": h} for a, h in knots(e, depth)]))
                level[some[w]] = int(path[-1])
            which, edges, below = which[n:], edges[n:], below[n:]
    return [[*f, i] for f, i in zip(found, level, strict=True)]


def _downward(values: list[float], step: float, fine: float):
    kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("at_m", pa.float64()), ("depth_m", pa.float64())])), pa.int64(), pa.int32()]
    names = ["node", "feasible", "cost", "from_depth", "to_depth", "knots", "bottom", "level"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _levels(tuple(values))
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE_BY_SIDE):
                given = batch.slice(at, SIDE_BY_SIDE).to_pylist()
                out = [(e["node"], *f, r["bottom"], level) for r, (*found, level) in zip(given, _walked(given, levels, step, fine), strict=True) for e, f in zip(r["pipes"], found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def tree_depths(pipes: DataFrame, step: float = 1.0, grid: float = GRID, run: int = RUN) -> DataFrame:
    """node, feasible, cost, from_depth, to_depth (at the upper and the lower end) and knots (at_m from the upper end) of each pipe.

    pipes: node, parent (long; a parent that is no node is a tie), length_m, rate, height (double) and sections (array of SECTION).
    The levels are the same for all of a plan, and their grid does not depend on its size. The driver sees the kinds of passages by sizes of pipes
    and how many metres there are.
    """
    scratch = Scratch(pipes.sparkSession, "depths")
    pipes = pipes.select("node", "parent", F.col("length_m").cast("double").alias("length_m"), F.col("rate").cast("double").alias("rate"), F.col("height").cast("double").alias("height"), F.col("sections").cast(f"array<{SECTION}>").alias("sections"))
    pipes = scratch.keep(pipes, "pipes")
    values, fine = make_levels(_critical(pipes), grid).tolist(), min(step, grid / SLOPE)
    metres = pipes.agg(F.sum("length_m")).first()[0] or 0

    ranked = chains(pipes).withColumn("_piece", F.floor(F.col("rank") / run))
    pipe = F.struct("rank", "node", "parent", "length_m", "rate", "height", "sections")
    pieces = ranked.groupBy("head", "_piece").agg(F.sort_array(F.collect_list(pipe)).alias("pipes"))  # `run` pipes at most
    pieces = scratch.keep(pieces.select(F.col("pipes")[0]["parent"].alias("top"), F.element_at("pipes", -1)["node"].alias("bottom"), "pipes"), "pieces")

    most = pieces.count()
    tiers, sizes = [scratch.keep(pieces.join(pieces.select(F.col("bottom").alias("top")), "top", "left_anti"), "tier")], []
    while n := tiers[-1].count():
        sizes.append(n)
        if sum(sizes) > most:
            raise ValueError("a node has two parents")
        tiers.append(scratch.keep(pieces.join(tiers[-1].select(F.col("bottom").alias("top")), "top", "left_semi"), "tier"))
    tiers = tiers[:-1]
    # Small in bytes, large in work: dealt by metres, which coalescing by size does not see.
    cores = pipes.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df, i: df.repartition(1 + int(max(metres * sizes[i] / most / AT_ONCE, min(cores, metres * sizes[i] / most / AT_LEAST))))

    sums: list[DataFrame | None] = [None] * (len(tiers) + 1)  # what hangs on each node, by level
    with_below = lambda i: tiers[i].withColumn("below", F.lit(None).cast("array<double>")) if sums[i + 1] is None else tiers[i].join(sums[i + 1].withColumnsRenamed({"top": "bottom", "cost": "below"}), "bottom", "left")
    for i in range(len(tiers) - 1, -1, -1):
        costs = dealt(with_below(i).select("top", "below", "pipes"), i).mapInArrow(_upward(values, step, fine), "top long, cost array<double>")
        whole = costs.repartition("top").sortWithinPartitions("top").mapInArrow(_summed, "top long, cost array<double>")
        sums[i] = scratch.keep(whole, "sums")
    found = []
    for i in range(len(tiers)):
        least = F.array_min("cost")
        start = sums[0].select("top", F.when(least < float("inf"), F.array_position("cost", least) - 1).otherwise(-1).cast("int").alias("level")) if i == 0 else found[-1].where("node = bottom").select(F.col("bottom").alias("top"), "level")
        given = dealt(with_below(i).join(start, "top").select("bottom", "below", "pipes", "level"), i)
        found.append(scratch.keep(given.mapInArrow(_downward(values, step, fine), _OUT), "found"))
    done = reduce(DataFrame.unionByName, found).drop("bottom", "level") if found else None
    lost = pipes.join(done.select("node"), "node", "left_anti") if done is not None else pipes
    none = lost.select("node", F.lit(False).alias("feasible"), *[F.lit(None).cast("double").alias(c) for c in ("cost", "from_depth", "to_depth")], F.lit(None).cast("array<struct<at_m: double, depth_m: double>>").alias("knots"))
    return none if done is None else done.unionByName(none)
